"""Streams that stop and go on: what they give is what the batch gives."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.functions.weights import agreement_of
from quillon.sources.keyed import KeyedTable
from quillon.streaming import feedback, ordered

SCHEMA = "score string, event_id long, ts timestamp, propensity double, ok int"


@pytest.fixture(scope="module")
def log():
    rng = random.Random(1)
    return [(rng.choice("ab"), i, 1_700_000_000 + 600 * i + rng.randrange(-1500, 1500), rng.choice([0.01, 0.2, 0.5, 1.0]), rng.randrange(2)) for i in range(120)]


def append(spark, rows, path):
    df = spark.createDataFrame(rows, "score string, event_id long, at long, propensity double, ok int")
    df.select("score", "event_id", F.timestamp_seconds("at").alias("ts"), "propensity", "ok").coalesce(1).write.mode("append").parquet(path)


def run(spark, path, home, fold):
    stream = feedback.log_stream(spark, path).select("score", "ts", "event_id", "propensity", "ok")
    feedback.drained(ordered.folded(stream, "score", "ts", "event_id", fold, fold.SCHEMA, "2 hours"), "x", home=home)


def test_alignment_survives_a_restart(spark, log, tmp_path):
    path, home = f"file://{tmp_path}/log", f"file://{tmp_path}/home"
    for part in (log[:50], log[50:55], log[55:]):
        append(spark, part, path)
        run(spark, path, home, ordered.Alignment(5))  # a new query each time, on the same state
    upto = max(r[2] for r in log) - 7200
    want = []
    for score in "ab":
        rows = sorted((r[2], r[1], r[3], r[4]) for r in log if r[0] == score and r[2] <= upto)
        want += [(score, k, *agreement_of([r[2:] for r in rows[max(0, k - 5) : k]])) for k in range(1, len(rows) + 1)]
    got = sorted(tuple(r) for r in spark.read.parquet(f"{home}/out").select("score", "k", "agreement", "n_effective").collect())
    assert len(got) == len(want) > 80 and all(a[:2] == b[:2] and a[2:] == pytest.approx(b[2:]) for a, b in zip(got, sorted(want), strict=True))
    run(spark, path, home, ordered.Alignment(5))
    assert spark.read.parquet(f"{home}/out").count() == len(want)  # nothing new, nothing twice


def test_folds():
    due, value, out = ordered.Due([(2, "x"), (2, "y"), (9, "z")], 3), None, []
    for _ in range(7):
        value, rows = due(value, {})
        out += rows
    assert out == [(2, "x"), (2, "y"), (3, "refit"), (6, "refit")]
    flight, value, out = ordered.InFlight(10), None, []
    for i, at in enumerate((0, 5, 9, 10, 30)):
        value, rows = flight(value, {"at": at, "event_id": i})
        out += rows
    assert out == [(0, 0), (3, 3), (4, 1)]


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    schema = spark.createDataFrame([], "k string, seq long, v string").schema
    open_ = lambda: KeyedTable(spark, f"file://{tmp_path}/t", schema, ["k"], ["seq"], buckets=4)  # noqa: E731  as after a restart
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    assert open_().read().count() == 0
    open_().merge(rows(("a", 1, "x"), ("b", 1, "y"), ("a", 3, "z")), 0)
    open_().merge(rows(("a", 2, "late"), ("c", 1, "w")), 1)
    read = lambda: sorted(tuple(r) for r in open_().read().collect())
    want = [("a", 3, "z"), ("b", 1, "y"), ("c", 1, "w")]
    assert read() == want
    open_().merge(rows(("a", 2, "late"), ("c", 1, "w")), 1)
    open_().merge(rows(), 2)
    assert read() == want
    spark.createDataFrame([("a", 9, "half")], schema).write.parquet(f"file://{tmp_path}/t/data/batch=7/bucket=0")  # died before its manifest
    assert read() == want


def test_merged_stream_goes_on_after_a_restart(spark, log, tmp_path):
    path, home = f"file://{tmp_path}/log", f"file://{tmp_path}/home"
    for part in (log[:40], log[40:]):
        append(spark, part, path)
        stream = feedback.log_stream(spark, path).select("score", "event_id", "ts")
        table = KeyedTable(spark, f"file://{tmp_path}/t", stream.schema, ["score"], ["ts", "event_id"])
        feedback.drained(stream, "x", step=table.merge, home=home)
    want = {s: max((r[2], r[1]) for r in log if r[0] == s)[1] for s in "ab"}
    assert {r.score: r.event_id for r in table.read().collect()} == want


def test_a_sweep_goes_on_with_the_values_of_batches_before(spark, tmp_path):
    """Requests stay in flight from one run to the next, late rows are dropped, and a task folds many keys."""
    import datetime as dt

    log, home = f"file://{tmp_path}/log", f"file://{tmp_path}/home"
    at = lambda hours: dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)
    put = lambda rows: spark.createDataFrame(rows, "request string, event_id long, ts timestamp").coalesce(1).write.mode("append").parquet(log)

    def run():
        stream = feedback.log_stream(spark, log)
        return spark.read.parquet(ordered.swept(stream, "request", "ts", "event_id", ordered.InFlight(12 * 3600 * 1_000_000), ordered.InFlight.SCHEMA, "1 hour", "x", home=home))

    put([("a", 2, at(5)), ("a", 1, at(0)), ("b", 3, at(1)), (None, 4, at(2)), ("a", 5, at(30))])
    assert sorted((r.request or "", r.event_id, r.served) for r in run().collect()) == [("", 4, 0), ("a", 1, 0), ("b", 3, 0)]
    put([("b", 6, at(40)), ("b", 7, at(2)), ("a", 8, at(29.5)), ("b", 9, at(60))])
    assert sorted((r.request or "", r.event_id, r.served) for r in run().collect()) == [("", 4, 0), ("a", 1, 0), ("a", 8, 2), ("b", 3, 0), ("b", 6, 1)]
