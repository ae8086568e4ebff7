"""The alignment curve and the bootstrap against brute force, on all rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillon import registry
from quillon.operators import ordering, paired, resampling, sampling
from quillon.plans import worlds as W


def brute_curve(rows, window):
    """rows: (propensity, ok) in order of time."""
    out = []
    for k in range(1, len(rows) + 1):
        seen = rows[max(0, k - window) : k]
        raw = [1 / p for p, _ in seen]
        cap = 20 * sorted(raw)[len(raw) // 2]
        w = [min(x, cap) for x in raw]
        out.append((k, sum(x * ok for x, (_, ok) in zip(w, seen, strict=True)) / sum(w), sum(w) ** 2 / sum(x * x for x in w)))
    return out


def test_alignment_takes_the_latest_usable_label_of_every_item(spark, data):
    latest = {}
    for r in sorted(W.feedback(spark, data).collect(), key=lambda r: (r.ts, r.event_id)):
        latest[r.item_id] = r
    usable = [r for r in latest.values() if not r.is_invalid and r.label_source in ("vetted_feedback", "regular_final_feedback") and r.propensity]
    usable.sort(key=lambda r: (r.ts, r.event_id))
    want = brute_curve([(r.propensity, r.initial == r.final.lower().rstrip(".")) for r in usable], 20)
    got = sorted(map(tuple, registry.queries()["a54_alignment_latest"](spark, data).collect()))
    assert len(got) == len(want) > 100
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 2e-6 and abs(a[2] - b[2]) < 2e-4 for a, b in zip(got, want, strict=True))


def test_places_over_many_ranges_and_equal_times(spark):
    rows = spark.range(300).select("id", F.timestamp_seconds(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") * 7919 % 101)).alias("ts"))
    want = [r.id for r in sorted(rows.collect(), key=lambda r: (r.ts, r.id))]
    got = ordering.positions(rows, ["ts", "id"], "k").orderBy("k").collect()
    assert [r.id for r in got] == want and [r.k for r in got] == list(range(1, 301))
    down = ordering.positions(rows, [F.desc("ts"), F.desc("id")], "k").orderBy("k").collect()
    assert [r.id for r in down] == want[::-1]
    assert ordering.positions(rows.limit(0), ["ts", "id"], "k").count() == 0


@pytest.mark.parametrize("block", [7, 4096])
def test_cumulative_curve(spark, block):
    rng = random.Random(block)
    rows = [(i, rng.choice([0.01, 0.02, 0.3, 0.5, 0.5, 1.0]), rng.randrange(2)) for i in range(1, 90)]
    df = spark.createDataFrame(rows, "k long, propensity double, ok int")
    got = sorted(map(tuple, sampling._cumulative(df, block=block).collect()))
    want = brute_curve([r[1:] for r in rows], len(rows))
    assert len(got) == len(want) and all(a == pytest.approx(b, abs=1e-9) for a, b in zip(got, want, strict=True))
    assert sampling._cumulative(df.limit(0)).count() == 0


def brute_ratio(pool, cut, rng):
    ids = [rng.randrange(len(pool)) for _ in pool]
    taken = sorted(((-pool[i][1], pool[i][0], k, i) for k, i in enumerate(ids)))[:cut]
    rate = []
    for g in ("female", "male"):
        there = sum(pool[i][2] == g and pool[i][3] for i in ids)
        rate.append(sum(pool[i][2] == g and pool[i][3] for *_, i in taken) / there if there else 0.0)
    return rate[0] / rate[1] if rate[1] else None


@pytest.mark.parametrize("bins", [4, 1024])
def test_ratio_resamples_are_those_of_drawing_applicants(spark, bins):
    rng = random.Random(5)
    pool = [(f"p{i:03d}", rng.randrange(6) / 5, rng.choice(["female", "male"]), rng.random() < 0.7) for i in range(120)]
    df = spark.createDataFrame(pool, "item_id string, score double, gender string, positive boolean")
    got = {}
    for r in resampling.ratio_resamples(df, [30, 60], resamples=2000, bins=bins).collect():
        got.setdefault(r.cut, []).append(r.ratio)
    for cut in (30, 60):
        mine, want = sorted(x for x in got[cut] if x is not None), sorted(x for x in (brute_ratio(pool, cut, rng) for _ in range(4000)) if x is not None)
        assert len(got[cut]) == 2000
        for share in (0.05, 0.25, 0.5, 0.75, 0.95):
            assert abs(mine[int(share * len(mine))] - want[int(share * len(want))]) < 0.12 * want[int(share * len(want))]


def test_ratio_intervals_of_plain_cases(spark):
    schema = "item_id string, score double, gender string, positive boolean"
    women = spark.createDataFrame([(f"{i}", 1.0, "female", True) for i in range(9)], schema)
    assert tuple(resampling.ratio_intervals(women, [3], 50).first()) == (3, None, None, 0)
    both = spark.createDataFrame([(f"{i}", 1.0, "female" if i % 2 else "male", True) for i in range(40)], schema)
    row = resampling.ratio_intervals(both, [40], 50).first()
    assert (row.low, row.high, row.used) == (1.0, 1.0, 50)  # all are in
    assert resampling.ratio_resamples(both.limit(0), [3]).count() == 0


def test_binomial_is_exact():
    for n, k in ((1, 0), (1, 1), (7, 3), (60, 1), (300, 77)):
        ones, upto = paired._binomial(n, k)
        exact = {i: math.comb(n, i) * (k / n) ** i * (1 - k / n) ** (n - i) for i in range(n + 1)}
        assert all(abs(u - sum(v for i, v in exact.items() if i <= o)) < 1e-9 for o, u in zip(ones, upto, strict=True))
    ones, upto = paired._binomial(10**9, 10**8)
    assert abs(upto[10**8 - ones.start] - 0.5) < 1e-3 and abs(sum(1 - u for u in upto) + ones.start - 10**8) < 50


def test_bootstrap_takes_a_thousand_resamples(spark, data):
    flips = [int(r.predicted != r.twin_predicted) for r in W.verdicts(spark, data).collect()]
    draw = random.Random(0)
    means = sorted(sum(draw.choices(flips, k=len(flips))) / len(flips) for _ in range(1000))
    low, high = registry.queries()["a31_bootstrap_1000"](spark, data).first()
    error = 0.35 * math.sqrt(sum(flips) / len(flips) * (1 - sum(flips) / len(flips)) / len(flips)) + 1 / len(flips)  # four errors of a quantile of 1,000
    assert abs(low - means[25]) < error and abs(high - means[975]) < error
    v = spark.createDataFrame(list(enumerate(map(float, flips))), "i long, x double")
    exploded = paired.bootstrap_mean(v, 1000).first()
    assert abs(low - exploded.low) < error and abs(high - exploded.high) < error


def test_bootstrap_of_few_values(spark):
    share = lambda xs: tuple(paired.bootstrap_share(spark.createDataFrame([(float(x),) for x in xs], "x double")).first())
    assert share([]) == (0.0, 0.0) and share([0, 0]) == (0.0, 0.0) and share([1]) == (1.0, 1.0) and share([0, 1] * 2) == (0.0, 1.0)
    with pytest.raises(ValueError):
        share([0, 2])
