"""Records from people's verdicts, training sets, versions, titles, legends: hand-derived values and edges."""

import pytest
from pyspark.sql import functions as F

from quillon.functions import scalars as S
from quillon.operators import paired, records, sampling


def test_recorded_verdicts(spark):
    rows = spark.createDataFrame([(1, "yes", "agree", None), (2, "yes", "disagree", " NO. "), (3, "yes", "skip", None)], "id int, predicted string, verdict string, correct_label string")
    got = {r.id: (r.final, r.is_agreement, r.label_source) for r in records.recorded(rows, ["Yes", "No"]).collect()}
    assert got == {1: ("yes", True, "regular_final_feedback"), 2: ("No", False, "regular_final_feedback"), 3: (None, None, "unresolved")}
    for bad, message in ((("disagree", None), "needs the correct label"), (("disagree", "maybe"), "not one of the classes"), (("perhaps", None), "unknown verdict"), ((None, None), "unknown verdict")):
        with pytest.raises(Exception, match=message):
            records.recorded(spark.createDataFrame([(1, "yes", *bad)], rows.schema), ["Yes", "No"]).collect()
    assert records.recorded(rows.limit(0), ["Yes", "No"]).count() == 0


def test_training_set_gives_a_twin_its_items_label_and_weight(spark):
    latest = spark.createDataFrame([(1, "yes", 0.5), (2, "no", 0.25), (3, None, 0.5), (4, "other", 0.5), (5, "yes", None), (6, "no", 1.0)], "item_id long, label string, propensity double")
    features = spark.createDataFrame([(i, i / 10) for i in range(1, 6)], "item_id long, f double")
    twins = spark.createDataFrame([(2, 0.9), (6, 0.9)], "item_id long, f double")
    got = {r.item_id: (r.label, r.f, r.weight) for r in sampling.training_set(latest, features, ["yes", "no"], ["f"], twins).collect()}
    assert got.keys() == {"1", "2", "2__twin"}  # 6 has no answers of its own
    assert got["2__twin"][:2] == ("no", 0.9)
    assert got["2"][2] == got["2__twin"][2] == pytest.approx(1.2) and got["1"][2] == pytest.approx(0.6)
    assert sampling.training_set(latest.limit(0), features, ["yes"], ["f"]).count() == 0


def test_weights_of_groups_and_of_many_small_groups_are_the_same(spark):
    rows = spark.range(60).select("id", F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("g"), ((1 + F.col("id") * 37 % 100) / 100).alias("propensity"))
    got, windows = (sorted((r.id, round(r.weight, 9)) for r in w.collect()) for w in (sampling.inverse_propensity(rows, ["g"], 1.5), sampling.inverse_propensity_windows(rows, ["g"], "id", 1.5)))
    assert got == windows and len(got) == 60


def test_feature_rows_want_every_answer_in_its_present_wording(spark):
    questions = spark.createDataFrame([("a", "q-a"), ("b", "q-b")], "name string, qhash string")
    cache = spark.createDataFrame([(1, "a", "q-a", 0.1), (1, "b", "q-b", 0.2), (2, "a", "q-a", 0.3), (3, "a", "q-a", 0.4), (3, "b", "old", 0.5)], "item_id long, name string, qhash string, noul double")
    assert [tuple(r) for r in records.feature_rows(cache, questions, ["a", "b"]).collect()] == [(1, 0.1, 0.2)]
    assert [r.noul for r in records.lookup(cache, questions, 3, "a").collect()] == [0.4] and records.lookup(cache, questions, 3, "b").count() == 0


def test_pairs_arms_and_pairwise_flips(spark):
    items = spark.createDataFrame([(1, 0.9, "y", "y", "f"), (2, 0.1, "n", "y", "m"), (3, 0.5, "y", "y", "m")], "item_id long, p double, predicted string, truth string, gender string")
    twins = spark.createDataFrame([("t1", 1, 0.7, "y"), ("t2", 2, 0.6, "y"), ("t9", 9, 0.5, "y")], "item_id string, source_id long, p double, predicted string")
    got = {r.gender: (r.n, r.accuracy, r.flip_rate, round(r.mean_shift, 9)) for r in paired.arm_rows(paired.pair_up(items, twins), "gender").collect()}
    assert got == {"all": (2, 0.5, 0.5, 0.15), "f": (1, 1.0, 0.0, -0.2), "m": (1, 0.0, 1.0, 0.5)}
    calls = {"white": "ynyy", "black": "yyn"}  # the fourth name is missing
    versions = spark.createDataFrame([(1, g, k, c) for g, row in calls.items() for k, c in enumerate(row, 1)], "source_id long, grp string, k int, predicted string")
    assert {r.grp: (r.n, r.flip_rate) for r in paired.pairwise_flips(versions, ["black"], "white", 4).collect()} == {"white": (2, 0.5), "black": (3, pytest.approx(2 / 3))}
    assert paired.version_rows(items, ["a", "b"], 4).count() == 24


@pytest.mark.parametrize("text", ["  o'neil mc-donald ", "ANNA", "émile ZOLA", "", " \t", "4th x2y"])
def test_titles(spark, text):
    assert spark.range(1).select(S.title(F.lit(text))).first()[0] == text.strip().title()


def test_legends(spark):
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, None)], "id int, legend array<string>")
    assert [r[0] for r in rows.select(S.matching_legend(F.col("legend"), 2)).collect()] == [["a", "b"], None]
    with pytest.raises(Exception, match="legend has 2 levels, the question 3"):
        rows.select(S.matching_legend(F.col("legend"), 3)).collect()
