"""What tasks hold and read grows with the input alone where these look."""

import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from quillon.operators import filling, scorecards, selecting
from quillon.plans import selecting as plans

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't have this module


class Silent:
    def __call__(self, key, text, questions):
        return {"answers": {n: {"noul": 0.5} for n in questions}, "model": "m"}


def test_a_wave_of_the_plan_is_many_tasks(spark, tmp_path):
    items = spark.range(200).select(F.col("id").cast("string").alias("item_id"), F.lit("x").alias("text"))
    filling.fill(items, {"clear": scorecards.Question("noul", "Is it clear?")}, f"file://{tmp_path}", Silent(), "a", waves=2)
    for wave in (0, 1):
        assert len(list((tmp_path / f"plans/a/wave={wave}").glob("part-*.parquet"))) > 1
    assert filling.cached(spark, f"file://{tmp_path}").count() == 200


def test_a_trigger_is_judged_within_its_row(spark, data):
    state = plans.states(spark, data)
    first = selecting.triggers(state, first=True)
    assert first.groupBy("key", "trigger").count().where("count > 1").count() == 0
    assert selecting.fired(first).exceptAll(selecting.fired(selecting.triggers(state))).count() == 0
    assert first.count() == 2 * state.count() == selecting.fired(first.unionByName(first)).count()


def test_novelty_looks_at_the_leaves_that_may_be_nearest(spark, monkeypatch):
    import numpy as np

    from quillon.operators import sampling

    seen = spark.sparkContext.accumulator(0)
    whole = sampling._nearest

    def counting(dims):
        def run(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield from whole(dims)(iter([batch]))

        return run

    monkeypatch.setattr(sampling, "_nearest", counting)
    rng = np.random.default_rng(3)
    pool, known = rng.random((400, 2)), rng.random((300, 2))
    frame = lambda x: spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "item_id long, a double, b double")
    got = {r.item_id: r.novelty for r in sampling.novelty(frame(pool), frame(known), ["a", "b"], block=10).collect()}
    s = pool.std(0)
    d = np.sqrt((((pool[:, None] - known[None]) / s) ** 2).sum(2)).min(1)
    want = d / (d + np.median(d))
    assert len(got) == 400 and np.allclose([got[i] for i in range(400)], want)
    assert seen.value < 64 * 32  # of the pairs of leaves there are


def test_grams_are_counted_within_rows_and_over_repeated_keys(spark):
    from quillon.operators import texts

    docs = spark.createDataFrame([(1, "ab cd ab"), (1, "ab"), (2, None), (3, "cd ab"), (None, "ab"), (None, "ab")], "id long, text string")
    counts = texts.counted(docs, "id")
    got = {(r.id, r.gram): r.n for r in counts.collect()}
    assert got == {(1, "ab"): 3, (1, "cd"): 1, (1, "ab cd"): 1, (1, "cd ab"): 1, (3, "cd"): 1, (3, "ab"): 1, (3, "cd ab"): 1, (None, "ab"): 2}


def test_a_swap_makes_tokens_of_gendered_words_alone(spark):
    """Most words of a text are none: the plan has no expression that makes a token of each."""
    from quillon.functions import rewrites

    given = ["He met her. Her \x01he\x01 women's health, HER the", "she saw her", "", "her\nhe her-x sheep Women", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string").select("i", rewrites.swap_gender(F.col("t")).alias("s"))
    got = {r.i: r.s and (r.s.text, r.s.swapped, r.s.her_resolved) for r in rows.collect()}
    assert got == {0: ("She met him. Him he women's health, HIM the", 4, 3), 1: ("he saw him", 2, 1), 2: ("", 0, 0), 3: ("his\nshe him-x sheep Men", 4, 2), 4: None}
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "[^A-Za-z]+)" not in plan and rewrites.GENDERED[:12] in plan
