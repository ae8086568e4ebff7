"""Resumable filling of answers, workspaces, and refits as transactions."""

import json
import sys
import threading

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quillon import registry
from quillon.operators import filling, products, scorecards, texts
from quillon.plans import looping
from quillon.sources import files
from quillon.sources.workspace import Missing, Workspace

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't have this module

QUESTIONS = {"clear": scorecards.Question("noul", "Is it clear?"), "kind": scorecards.Question("noul", "Is it kind?")}


class Counting:
    """Notes each request in a folder, one file each; dies at an item, or fails."""

    def __init__(self, folder, fails=(), dies=None):
        self.folder, self.fails, self.dies = str(folder), fails, dies

    def __call__(self, key, text, questions):
        import os
        import uuid

        item = key.split(":")[0]
        if item == self.dies:
            raise KeyboardInterrupt("the machine is gone")
        with open(os.path.join(self.folder, uuid.uuid4().hex), "w") as f:
            json.dump([item, sorted(questions)], f)
        if item in self.fails:
            raise ValueError(f"bad item {item}")
        return {"answers": {n: {"noul": 0.25} for n in questions}, "model": "m", "usage": {"input_tokens": 5, "output_tokens": 2}}


def asked(folder):
    return sorted(json.loads(p.read_text())[0] for p in folder.iterdir())


@pytest.fixture
def items(spark):
    return spark.createDataFrame([(str(i), f"text {i}") for i in range(40)], "item_id string, text string")


def test_a_broken_run_goes_on_where_it_stopped(spark, items, tmp_path):
    log, folder = tmp_path / "log", f"file://{tmp_path}/answers"
    log.mkdir()
    waves = {r.item_id: r.w for r in items.select("item_id", F.pmod(F.xxhash64("item_id"), F.lit(4)).cast("int").alias("w")).collect()}
    last = next(i for i, w in waves.items() if w == 2)
    with pytest.raises(Exception):
        filling.fill(items, QUESTIONS, folder, Counting(log, dies=last), "a", waves=4)
    done = {i for i, w in waves.items() if w < 2}
    assert {r.item_id for r in filling.cached(spark, folder).collect()} == done
    before = asked(log)
    report = filling.fill(items, QUESTIONS, folder, Counting(log), "a", waves=4).first()
    again = asked(log)
    for i in before:
        again.remove(i)
    assert sorted(again) == sorted(set(waves) - done)  # whole waves are not asked again
    assert (report.requested, report.failures, report.missing_answers, report.input_tokens, report.errors) == (40, 0, 80, 200, [])
    assert filling.cached(spark, folder).count() == 80
    n = len(asked(log))
    report = filling.fill(items, QUESTIONS, folder, Counting(log), "b").first()
    assert (report.requested, report.already_complete, len(asked(log))) == (0, 40, n)


def test_failures_are_told_and_asked_again_by_the_next_run(spark, items, tmp_path):
    log, folder = tmp_path / "log", f"file://{tmp_path}/answers"
    log.mkdir()
    report = filling.fill(items, QUESTIONS, folder, Counting(log, fails=("1", "2", "3", "4")), "a").first()
    assert (report.requested, report.failures, len(report.errors)) == (36, 4, 3) and report.errors[0].startswith("ValueError: bad item")
    one = {"clear": QUESTIONS["clear"], "kind": scorecards.Question("noul", "Is it kinder?")}
    report = filling.fill(items.where("item_id < 2"), one, folder, Counting(log), "b").first()
    assert report.missing_answers == items.where("item_id < 2").count() + 1  # the new wording of all, and the one that had failed
    assert filling.fill(items.limit(0), QUESTIONS, folder, Counting(log), "c").first().requested == 0


def test_of_two_commits_at_once_one_fails(spark, tmp_path):
    folder, ends = f"file://{tmp_path}/cards", []
    files.commit(spark, folder, "a: 1\n", "seed", 0)

    def commit(text):
        try:
            ends.append(files.commit(spark, folder, text, "fit", 1, expected=1))
        except files.Conflict:
            ends.append("conflict")

    threads = [threading.Thread(target=commit, args=(f"a: {i}\n",)) for i in (2, 3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(map(str, ends)) == ["2", "conflict"] and [r.version for r in files.lineage(spark, folder).collect()] == [1, 2]
    with pytest.raises(files.Conflict):
        files.commit(spark, folder, "a: 4\n", "fit", 1, expected=1)
    assert files.version_of(spark, folder) == 2 and not [p for p in (tmp_path / "cards/versions").iterdir() if "draft" in p.name and not p.name.endswith(".crc")]


def test_workspace(spark, tmp_path):
    card = scorecards.parse(looping.LOOP.replace("WEIGHT", "1.0"))
    rows = spark.createDataFrame([("1", "a", "pool"), ("2", "b", "test")], "item_id string, text string, split string")
    root = f"file://{tmp_path}/w"
    with pytest.raises(Missing):
        Workspace(spark, root).items  # noqa: B018
    loop = Workspace.create(rows, card, root)
    with pytest.raises(FileExistsError):
        Workspace.create(rows, card, root)
    assert loop.version == 1 and loop.item("2").text == "b" and [r.item_id for r in loop.split("pool").collect()] == ["1"]
    with pytest.raises(Missing):
        loop.item("9")
    feedback = "seq long, item_id string, score_name string, initial string, final string, comment string, label_source string, is_invalid boolean, propensity double, at string"
    loop.add_feedback(spark.createDataFrame([(1, "1", "Quality", "positive", "positive", None, "vetted_feedback", False, 0.5, None), (2, "1", "Quality", "positive", "negative", "no", "vetted_feedback", False, 0.5, None), (3, "2", "Quality", None, None, None, "unresolved", False, 0.5, None)], feedback))
    assert [(r.item_id, r.label) for r in loop.labelled("Quality").collect()] == [("1", "negative")] and loop.labelled_ids("Quality").count() == 2
    loop.log_event("note", "Quality", why="x")
    assert [(r.kind, r.n_feedback, r.n_labelled) for r in loop.events().collect()] == [("note", 3, 1)]
    assert loop.refit("Quality").status == "held" and loop.events("fit").count() == 1


def test_a_refit_has_four_ends(spark, data):
    got = {r.case: r for r in registry.queries()["c05_refit"](spark, data).collect()}
    assert {c: r.status for c, r in got.items()} == {"few": "held", "one_kind": "refused", "good_head": "rejected", "bad_head": "promoted"}
    assert {c: r.new_version for c, r in got.items()} == {"few": None, "one_kind": None, "good_head": None, "bad_head": 2}


def test_an_overtaken_refit_commits_nothing(spark, data, monkeypatch):
    loop = looping.loop_of(spark, data, 80, -1.0)
    whole = Workspace._attempt

    def slow(self, card, *rest):
        self.commit(card, "by hand")
        return whole(self, card, *rest)

    monkeypatch.setattr(Workspace, "_attempt", slow)
    assert loop.refit("Quality").status == "overtaken" and loop.version == 2
    monkeypatch.undo()
    done = loop.refit("Quality")
    assert (done.status, done.version, loop.lineage().count()) == ("promoted", 3, 3)
    new = loop.card()["Quality"].decision
    assert new.model == "multinomial_logistic" and set(new.head) == {"positive", "negative"} and new.provenance["tier"] == "shrunk"


def test_items_without_features_and_versions_without_weights(spark):
    items = spark.createDataFrame([(1,), (2,)], "item_id int")
    features = spark.createDataFrame([(1, "q", "p", 2.0)], "item_id int, qhash string, term string, value double")
    heads = spark.createDataFrame([(1, 0, "a", "q", "p", 1.0), (1, 1, "b", "", "intercept", 0.0), (2, 0, "b", "", "intercept", 0.0), (2, 1, "a", "", "intercept", 0.0)], looping.HEAD_TABLE)
    got = {(r.item_id, r.version): (r.value, round(r.confidence, 6), r.coverage) for r in products.served(items, features, heads).collect()}
    assert got == {(1, 1): ("a", 0.880797, 1.0), (2, 1): ("a", 0.5, 0.0), (1, 2): ("b", 0.5, 1.0), (2, 2): ("b", 0.5, 1.0)}


def test_student_learns_words(spark):
    train = spark.createDataFrame([(i, "red apple pie" if i % 2 else "blue steel car", i % 2) for i in range(40)], "id int, text string, y int")
    test = spark.createDataFrame([(1, "an apple", 1), (2, "steel", 0), (3, None, 0)], "id int, text string, y int")
    assert {r.id: r.predicted for r in texts.student(train, test, "id", "y").collect() if r.id < 3} == {1: 1, 2: 0}
