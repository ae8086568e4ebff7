"""Names, versions, intervals of sums, and proposals."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillon import registry
from quillon.functions import rewrites as R
from quillon.functions import scalars as S
from quillon.operators import names, paired, proposals, resampling, sampling, scorecards
from quillon.plans.streamed import CARD


def test_two_white_names_are_two(spark):
    rows = spark.range(300).select("id", names.three_names(F.when(F.col("id") % 2 == 0, "female").otherwise("male"), "id").alias("n")).select("id", "n.*").collect()
    assert all(r.white_a != r.white_b for r in rows)
    assert all(r.black in R.NAMES["black", "female" if r.id % 2 == 0 else "male"] and r.white_b in R.NAMES["white", "female" if r.id % 2 == 0 else "male"] for r in rows)
    assert len({r.white_b for r in rows}) == 18


def test_pools_and_the_group_that_borrows(spark):
    first = spark.createDataFrame([("ANN", 0.9, 0.0, 0.0, 0.1), ("BOB", 0.8, 0.1, 0.0, 0.0), ("LEE", 0.81, 0.0, 0.0, 0.1), ("TIA", 0.1, 0.85, 0.0, 0.0), (None, 1.0, 0.0, 0.0, 0.0)], "name string, white double, black double, hispanic double, asian double")
    last = spark.createDataFrame([("NGUYEN", 0.0, 0.0, 0.0, 0.95), ("RARE", 0.9, 0.0, 0.0, 0.0), ("SMITH", 0.81, 0.1, 0.0, 0.0)], first.schema)
    births = spark.createDataFrame([("Ann", "F", 19000), ("Ann", "M", 1000), ("Bob", "M", 30000), ("Lee", "F", 20000), ("Lee", "M", 20000), ("Tia", "F", 19999)], "name string, sex string, count long")
    bearers = spark.createDataFrame([("NGUYEN", 9000), ("SMITH", 5000), ("RARE", 4999)], "name string, count long")
    got = {tuple(r) for r in names.pools(first, last, births, bearers).collect()}
    lent = {(g, p, n, True) for g in ("black", "hispanic", "asian") for p, n in (("female", "Ann"), ("male", "Bob"))}
    assert got == {("white", "female", "Ann", False), ("white", "male", "Bob", False), ("asian", "last", "Nguyen", False), ("white", "last", "Smith", False)} | lent


def test_texts_under_names(spark):
    texts = spark.createDataFrame([(1, "In May she met [name]. Smith left."), (2, "Nobody."), (3, None)], "item_id long, text string")
    given = spark.createDataFrame([(i, "white", 1, "Ann", "Lee") for i in (1, 2, 3)], "item_id long, grp string, k int, first string, last string")
    got = {r.item_id: r.text for r in names.under_names(texts, given, ["Smith"]).collect()}
    assert got == {1: "In May Ann Lee met Ann. Lee left.", 2: None, 3: None}


def test_exclusions_and_regeneration(spark):
    texts = ["No one.", "She works since 1998.", "He has 12 years.", "He has 9 years since 2005.", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")
    assert [r.x for r in rows.orderBy("item_id").select(names.exclusion(F.col("text")).alias("x")).collect()][:4] == ["no_pronoun", "year", "duration", None]
    fresh = rows.where("item_id > 0").withColumn("text", F.when(F.col("item_id") == 2, "other").otherwise(F.col("text")))
    assert tuple(names.regenerated(rows, fresh).first()) == (3, 1, 0, 1)


def test_sums_of_resamples(spark):
    rng = random.Random(2)
    values = [(i, rng.gauss(1, 2), float(rng.random() < 0.3)) for i in range(150)]
    df = spark.createDataFrame(values, "id long, x double, flip double")
    for block in (20, 10_000):
        sums = resampling.resampled_sums(df, "id", ["x", "flip"], resamples=1500, block=block)
        got = {r.statistic: r for r in resampling.intervals(sums, {"mean": F.col("x") / F.col("n"), "flips": F.col("flip") / F.col("n"), "never": F.lit(None).cast("double")}).collect()}
        for name, at in (("mean", 1), ("flips", 2)):
            draws = sorted(sum(rng.choices([v[at] for v in values], k=150)) / 150 for _ in range(3000))
            wide = draws[2925] - draws[75]
            assert abs(got[name].low - draws[75]) < 0.12 * wide and abs(got[name].high - draws[2925]) < 0.12 * wide and got[name].used == 1500
        assert got["never"].low is None and got["never"].used == 0


def test_novelty_in_blocks(spark):
    rng = random.Random(4)
    pool = [(i, rng.gauss(0, 3), rng.gauss(0, 1) if i % 9 else None) for i in range(60)]
    known = [(100 + i, rng.gauss(0, 3), rng.gauss(0, 1)) for i in range(25)]
    frame = lambda rows: spark.createDataFrame(rows, "item_id long, a double, b double")
    whole = {r.item_id: r.novelty for r in sampling.novelty(frame(pool), frame(known), ["a", "b"]).collect()}
    cut = {r.item_id: r.novelty for r in sampling.novelty(frame(pool), frame(known), ["a", "b"], block=4).collect()}
    assert whole.keys() == cut.keys() and all(whole[k] == pytest.approx(cut[k]) for k in whole) and sorted(whole.values())[30] >= 0.5 > sorted(whole.values())[28]
    assert {r.novelty for r in sampling.novelty(frame(pool), frame([]), ["a", "b"]).collect()} == {0.5}


def test_stability_and_shifts_per_item(spark):
    asks = spark.createDataFrame([(1, "t", "alone", 0.4), (1, "t", "again", 0.4), (2, "t", "alone", 0.5), (2, "t", "again", 0.45), (3, "t", "again", 0.1)], "item_id int, name string, asked string, p double")
    assert [(r.n, r.identical, round(r.largest, 6), r.flips) for r in paired.stability(asks, "alone").collect()] == [(2, 1, 0.05, 1)]
    versions = spark.createDataFrame([(1, g, k, p) for g, ps in (("white", (0.1, 0.2, 0.3, 0.4)), ("black", (0.5,) * 4)) for k, p in enumerate(ps, 1)], "source_id int, grp string, k int, p double")
    row = paired.source_shifts(versions, ["black"], "white").first()
    assert (round(row.black, 6), round(row.floor_shift, 6)) == (0.25, 0.2)


NEW = {"add_elements": [{"key": "irony", "question_type": "noul", "instructions": "Is it ironic?"}, {"key": "form", "question_type": "choice", "instructions": "What form?", "criteria": ["letter", "list", "verse"]}, {"key": "force", "question_type": "score", "instructions": "How strong?", "criteria": ["weak", "strong"]}]}


def test_proposals():
    card = scorecards.parse(CARD)
    new = proposals.applied(card, "Quality", proposals.parse("Here:\n```json\n" + __import__("json").dumps(NEW | {"retire_elements": ["depth"], "reword_elements": [{"key": "self", "instructions": "Is it fine?"}]}) + "\n```"))
    score = new["Quality"]
    assert [e.key for e in score.elements] == ["clear", "tone", "irony", "form", "force"] and score.question.instructions == "Is it fine?" and score.decision.weights == {}
    assert score.decision.features == ("self.holistic.clr.good", "clear.logit_p", "tone.clr.calm", "shared.pace.is_yes", "irony.logit_p", "form.clr.letter", "form.clr.list", "force.expected_level")
    assert new["Mood"] == card["Mood"] and proposals.parse("{}").noop
    both = proposals.merged([NEW, "no object", {"root_cause": "x", "add_elements": [NEW["add_elements"][0] | {"instructions": "later"}]}])
    assert both.root_cause == "x" and [a.element.question.instructions for a in both.add] == ["Is it ironic?", "What form?", "How strong?"]


BAD = ["nothing", {"add_elements": "x"}, {"add_elements": [{"key": "a"}]}, {"add_elements": [NEW["add_elements"][0]] * 2}, {"add_elements": [{"key": f"k{i}", "question_type": "noul", "instructions": "?"} for i in range(9)]}, {"retire_elements": ["tone"], "reword_elements": [{"key": "tone", "instructions": "?"}]}, {"add_elements": [{"key": "a", "question_type": "choice", "instructions": "?"}]}, {"reword_elements": [{"key": "tone"}]}]


@pytest.mark.parametrize("raw", [*BAD, {"retire_elements": ["self"]}, {"retire_elements": ["gone"]}, {"reword_elements": [{"key": "gone", "instructions": "?"}]}, {"add_elements": [{"key": "tone", "question_type": "noul", "instructions": "?"}]}, {"add_elements": [{"key": "a.b", "question_type": "noul", "instructions": "?"}]}])
def test_unusable_proposals(raw):
    with pytest.raises(proposals.Unusable):
        proposals.applied(scorecards.parse(CARD), "Quality", proposals.parse(raw))


def test_strip_of_long_white_space(spark):
    text = "  a" + " " * 200_000 + "b \x1f "
    assert spark.createDataFrame([(text,)], "t string").select(S.strip(F.col("t")).alias("t")).first()[0] == "a" + " " * 200_000 + "b"


@pytest.mark.parametrize("name", ["t05_swap_gender", "s21_swapped_twins", "s22_regenerated"])
def test_swaps_of_odd_texts_are_their_sqls(spark, tmp_path, name):
    odd = ["", None, "he", "\x01he\x01", "a\x01b", "women's health and men's clinic", "Mens health", "her\x0bfriend", "her\x0cfriend", "her  ", "her\n\x85king", "her  ", "HER friend to her", "1", " he ", "hE Sir.53@"]
    texts = odd * 21  # each under ids of all remainders
    table = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string()), "lang": ["en"] * len(texts)})
    pq.write_table(table, tmp_path / "documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    got = registry.queries()[name](spark, str(tmp_path)).toArrow()
    want = db.execute(f"SELECT {', '.join(got.column_names)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, (r.values() for r in got.to_pylist()))) == sorted(want)
