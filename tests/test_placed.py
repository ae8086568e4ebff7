"""Streams whose keys are few and large: placed by Spark, restarted, and the same as the folds."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.functions.weights import agreement_of
from quillon.streaming import feedback, ordered


def test_placed_rows_are_what_the_folds_give_after_restarts(spark, tmp_path):
    rng, path, home = random.Random(2), f"file://{tmp_path}/log", f"file://{tmp_path}/home"
    log = [(rng.choice("aab"), i, 1_700_000_000 + 600 * i + rng.randrange(-1500, 1500), rng.choice([0.01, 0.2, 0.5, 1.0]), rng.randrange(2)) for i in range(90)]

    def emit(rows):
        return ordered.aligned(rows, "score", 5, block=7).join(ordered.due(rows.where("fresh"), "score", [(2, "x")], 3).withColumnRenamed("labels", "k"), ["score", "k"], "left")

    for part in (log[:50], log[50:53], log[53:]):
        df = spark.createDataFrame(part, "score string, event_id long, at long, propensity double, ok int")
        df.select("score", "event_id", F.timestamp_seconds("at").alias("ts"), "propensity", "ok").coalesce(1).write.mode("append").parquet(path)
        ordered.placed(feedback.log_stream(spark, path), "score", "ts", "event_id", emit, "2 hours", "x", window=5, home=home)
    upto, want = max(r[2] for r in log) - 7200, []
    for score in "ab":
        rows = sorted((r[2], r[1], r[3], r[4]) for r in log if r[0] == score and r[2] <= upto)
        want += [(score, k, *agreement_of([r[2:] for r in rows[max(0, k - 5) : k]]), "x" if k == 2 else "refit" if k % 3 == 0 else None) for k in range(1, len(rows) + 1)]
    got = sorted(tuple(r) for r in spark.read.parquet(f"{home}/out").select("score", "k", "agreement", "n_effective", "step").collect())
    assert len(got) == len(want) > 50 and all(a[:2] == b[:2] and a[4] == b[4] and a[2:4] == pytest.approx(b[2:4]) for a, b in zip(got, sorted(want), strict=True))
