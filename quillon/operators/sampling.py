"""Selection with recorded propensities and the weights that undo it."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.files import new_path
from . import ordering

#: Labels of the cumulative curve that one task goes through.
BLOCK_ROWS = 4096


def raw_weight() -> Column:
    """1/propensity; propensities outside (0, 1] are an error."""
    return F.when((F.col("propensity") > 0) & (F.col("propensity") <= 1), 1 / F.col("propensity")).otherwise(F.raise_error(F.lit("a propensity must be over 0 and at most 1")).cast("double"))


def inverse_propensity(rows: DataFrame, by: list[str], max_ratio: float = 20.0) -> DataFrame:
    """weight: 1/propensity, capped at max_ratio times the upper median of its group, scaled so that the group's weights sum to
    its size; without `by` all rows are one group. For groups of any size: each task counts its rows by propensity before a shuffle, and
    a group's two sums are joined back, so that no task sees all of a group."""
    raw = rows.withColumn("_raw", raw_weight())
    capped = F.least("_raw", max_ratio * F.col("_middle"))
    middle = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY _raw DESC)")
    groups = raw.groupBy(*by).agg(middle.alias("_middle"), F.count("*").alias("_n"))
    sums = _beside(raw, groups, by).groupBy(*by).agg(F.first("_middle").alias("_middle"), F.first("_n").alias("_n"), F.sum(capped).alias("_sum"))
    return _beside(raw, sums, by).withColumn("weight", capped * F.col("_n") / F.col("_sum")).drop("_raw", "_middle", "_n", "_sum")


def _beside(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """Rows with their group's figures; null is a group too."""
    if not by:
        return rows.crossJoin(F.broadcast(groups))  # one row
    keys = groups.select(*[F.col(c).alias(f"_by_{c}") for c in by], *[c for c in groups.columns if c not in by])
    return rows.join(keys, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by])).drop(*[f"_by_{c}" for c in by])


def inverse_propensity_windows(rows: DataFrame, by: list[str], tie: str, max_ratio: float = 20.0) -> DataFrame:
    """The same weights for very many small groups, such as the trailing windows of a curve: one shuffle, each group in one task."""
    whole = Window.partitionBy(*by)
    placed = rows.withColumn("_raw", raw_weight()).withColumns({"_n": F.count("*").over(whole), "_r": F.row_number().over(whole.orderBy("_raw", tie))})
    middle = F.max(F.when(F.col("_r") == F.floor(F.col("_n") / 2) + 1, F.col("_raw"))).over(whole)
    capped = placed.withColumn("_capped", F.least(F.col("_raw"), max_ratio * middle))
    return capped.withColumn("weight", F.col("_capped") * F.col("_n") / F.sum("_capped").over(whole)).drop("_raw", "_n", "_r", "_capped")


def alignment_curve(rows: DataFrame, time: str, tie: str, window: int = 20) -> DataFrame:
    """k, agreement, n_effective: weighted agreement (ok, 0/1) over the last `window` labels up to the k-th, weights made anew for each
    k; a window of 0 takes all labels so far. A label meets the `window` curve points that it counts for by number, so the rows grow in
    proportion to the labels."""
    r = ordering.positions(rows.select(time, tie, "propensity", "ok"), [time, tie], "k")
    if not window:
        return _cumulative(r)
    last = rows.agg(F.count("*").alias("last"))
    reach = r.crossJoin(F.broadcast(last)).select(tie, "propensity", "ok", F.explode(F.sequence(F.col("k"), F.least(F.col("k") + window - 1, F.col("last")))).alias("k"))
    w = F.col("weight")
    return inverse_propensity_windows(reach, ["k"], tie).groupBy("k").agg((F.sum(w * F.col("ok")) / F.sum(w)).alias("agreement"), (F.sum(w) * F.sum(w) / F.sum(w * w)).alias("n_effective"))


def _cumulative(numbered: DataFrame, max_ratio: float = 20.0, block: int = BLOCK_ROWS) -> DataFrame:
    """The curve over all labels so far. Labels are counted by distinct propensity and block of numbers; a block gets the counts of what
    lies before it, one row a distinct propensity, and adds its own labels one by one: the cap is a prefix's own upper median, so the
    sums below and above it are made anew at each label, over distinct propensities and not over labels."""
    rows = numbered.select("k", "propensity", "ok", F.floor((F.col("k") - 1) / block).alias("b"))
    counts = rows.groupBy("propensity", "b").agg(F.count("*").alias("n"), F.sum("ok").alias("n_ok"))
    blocks = rows.agg(F.max("b").alias("last"))
    # a count holds in all blocks after its own, up to the propensity's next one
    line = Window.partitionBy("propensity").orderBy("b")
    upto = counts.select("propensity", "b", F.sum("n").over(line).alias("n"), F.sum("n_ok").over(line).alias("n_ok"), F.lead("b").over(line).alias("next"))
    before = upto.crossJoin(F.broadcast(blocks)).withColumn("until", F.coalesce("next", "last")).where(F.col("until") > F.col("b"))
    before = before.select(F.explode(F.sequence(F.col("b") + 1, "until")).alias("later"), F.col("propensity").alias("value"), "n", "n_ok")

    def curve(key: tuple, own: pd.DataFrame, past: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("k")
        values = np.unique(np.concatenate([own["propensity"].to_numpy(), past["value"].to_numpy()]))[::-1]  # from the smallest weight up
        raw, n, hit = 1 / values, np.zeros(len(values)), np.zeros(len(values))
        at = dict(zip(values, range(len(values)), strict=True))
        for p, a, b in zip(past["value"], past["n"], past["n_ok"], strict=True):
            n[at[p]], hit[at[p]] = a, b
        out = []
        for k, p, ok in zip(own["k"], own["propensity"], own["ok"], strict=True):
            n[at[p]] += 1
            hit[at[p]] += ok
            middle = raw[np.searchsorted(n.cumsum(), k // 2, side="right")]
            w = np.minimum(raw, max_ratio * middle)
            total = (w * n).sum()
            out.append((k, (w * hit).sum() / total, total * total / (w * w * n).sum()))
        return pd.DataFrame(out, columns=["k", "agreement", "n_effective"])

    return rows.groupBy("b").cogroup(before.groupBy("later")).applyInPandas(curve, "k long, agreement double, n_effective double")


def selection_distribution(rows: DataFrame, temperature: float = 0.60, explore: float = 0.15) -> DataFrame:
    """probability: (1 - explore) softmax(score / temperature) + explore / n. The totals are one aggregated row."""
    if temperature <= 0 or not 0 <= explore <= 1:
        raise ValueError("temperature must be positive and explore between 0 and 1")
    top = rows.agg(F.max("score").alias("_top"), F.count("*").alias("_n"))
    powers = rows.crossJoin(F.broadcast(top)).withColumn("_e", F.exp((F.col("score") - F.col("_top")) / temperature))
    total = powers.agg(F.sum("_e").alias("_total"))
    p = (1 - explore) * F.col("_e") / F.col("_total") + explore / F.col("_n")
    return powers.crossJoin(F.broadcast(total)).withColumn("probability", p).drop("_top", "_n", "_e", "_total")


def _leaves(x: np.ndarray, at: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Rows `at` in leaves of `most` at most, halved along the side that is widest."""
    if len(at) <= most:
        yield at
        return
    side = int(np.ptp(x[at], axis=0).argmax())
    half = len(at) // 2
    order = np.argpartition(x[at, side], half)
    yield from _leaves(x, at[order[:half]], most)
    yield from _leaves(x, at[order[half:]], most)


def _boxed(dims: int, most: int, key: str):
    """Leaves of a batch's points with their keys, their box, and a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(f"_{i}").to_numpy(zero_copy_only=False) for i in range(dims)])
            for at in _leaves(x, np.arange(len(x)), most) if len(x) else ():
                cells = {f"{key}_no": uuid.uuid4().int >> 65, f"{key}_ids": batch.column("_id").take(pa.array(at)).to_pylist(), f"{key}_low": x[at].min(0).tolist(), f"{key}_high": x[at].max(0).tolist(), f"{key}_points": x[at].tobytes()}
                types = [pa.int64(), pa.list_(batch.schema.field("_id").type), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells.values(), types, strict=True)], list(cells))

    return run


def _nearest(dims: int):
    """The least squared distance of each point of a leaf to those of a leaf of labelled ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, a, b in zip(batch.column("p_ids"), batch.column("p_points"), batch.column("k_points"), strict=True):
                x, y = (np.frombuffer(v.as_buffer()).reshape(-1, dims) for v in (a, b))
                least = np.concatenate([sum((x[s : s + 128, i][:, None] - y[:, i]) ** 2 for i in range(dims)).min(1) for s in range(0, len(x), 128)])
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(least)], ["_id", "_d"])

    return run


def novelty(pool: DataFrame, labelled: DataFrame, features: list[str], key: str = "item_id", block: int = 1000) -> DataFrame:
    """Distance of each pool item (unique key) to its nearest labelled one, features divided by the pool's population deviation (0 counts
    as 1), missing ones 0, squashed by d / (d + median); 0.5 without any labelled one. Both are dealt out by the first feature and cut into
    leaves of `block` points at most, each with the box that holds it. A pair of leaves is looked at unless another labelled leaf is
    nearer for certain: its farthest corner is nearer than this one's nearest. The median is that of the places in the middle."""
    spark, kind, dims = pool.sparkSession, pool.schema[key].dataType.simpleString(), len(features)
    if not labelled.limit(1).count():
        return pool.withColumn("novelty", F.lit(0.5))
    value = lambda f: F.coalesce(F.col(f).cast("double"), F.lit(0.0))
    stats = pool.agg(*[F.coalesce(F.nullif(F.stddev_pop(value(f)), F.lit(0.0)), F.lit(1.0)).alias(f"_s_{f}") for f in features])

    def leaves(rows: DataFrame, side: str, id_: Column) -> DataFrame:
        scaled = rows.crossJoin(F.broadcast(stats)).select(id_.alias("_id"), *[(value(f) / F.col(f"_s_{f}")).alias(f"_{i}") for i, f in enumerate(features)])
        path, own = new_path(spark, f"leaves-{side}"), scaled.schema["_id"].dataType.simpleString()
        ddl = f"{side}_no long, {side}_ids array<{own}>, {side}_low array<double>, {side}_high array<double>, {side}_points binary"
        scaled.repartitionByRange("_0").sortWithinPartitions("_0").mapInArrow(_boxed(dims, block, side), ddl).write.parquet(path)
        return spark.read.schema(ddl).parquet(path)

    ours, known = leaves(pool, "p", F.col(key)), leaves(labelled, "k", F.lit(0))
    squares = lambda a: F.aggregate(a, F.lit(0.0), lambda t, x: t + x * x)
    least = squares(F.zip_with(F.zip_with("k_low", "p_high", lambda a, b: a - b), F.zip_with("p_low", "k_high", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0))))
    most = squares(F.zip_with(F.zip_with("k_high", "p_low", lambda a, b: a - b), F.zip_with("p_high", "k_low", lambda a, b: a - b), lambda a, b: F.greatest(a, b)))
    boxes = ours.select("p_no", "p_low", "p_high").crossJoin(F.broadcast(known.select("k_no", "k_low", "k_high"))).select("p_no", "k_no", least.alias("_least"), most.alias("_most"))
    bound = boxes.groupBy("p_no").agg(F.min("_most").alias("_bound"))
    # a hair's breadth for the rounding of sums
    pairs = boxes.join(bound, "p_no").where(F.col("_least") <= F.col("_bound") * (1 + 1e-9)).select("p_no", "k_no")
    met = pairs.join(ours.select("p_no", "p_ids", "p_points"), "p_no").join(known.select("k_no", "k_points"), "k_no").select("p_ids", "p_points", "k_points")
    near = met.mapInArrow(_nearest(dims), f"_id {kind}, _d double").groupBy(F.col("_id").alias(key)).agg(F.sqrt(F.min("_d")).alias("_d"))
    placed = ordering.positions(near, ["_d", key], "_place")
    ends = placed.agg(F.max("_place").alias("_n"))
    middle = placed.crossJoin(F.broadcast(ends)).where(F.col("_place").isin(F.floor((F.col("_n") + 1) / 2), F.floor((F.col("_n") + 2) / 2))).agg(F.avg("_d").alias("_m"))
    squashed = F.col("_d") / (F.col("_d") + F.when(F.col("_m") == 0, 1.0).otherwise(F.col("_m")))
    return pool.join(placed.crossJoin(F.broadcast(middle)).select(key, squashed.alias("novelty")), key)


def choose(rows: DataFrame, draw: float, order: str, width: int = 1000) -> DataFrame:
    """The first row, by a numeric id, at which the summed probabilities reach the draw; its probability is the propensity.

    Probabilities are summed up by ranges of `width` ids; only the range that holds the draw is looked at row by row."""
    ranges = rows.groupBy(F.floor(F.col(order) / width).alias("_range")).agg(F.sum("probability").alias("_sum"))
    upto = ranges.withColumn("_upto", F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)))
    found = upto.where(F.col("_upto") >= draw).orderBy("_range").limit(1).select("_range", (F.col("_upto") - F.col("_sum")).alias("_before"))
    inside = rows.withColumn("_range", F.floor(F.col(order) / width)).join(F.broadcast(found), "_range")
    upto_row = F.col("_before") + F.sum("probability").over(Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return inside.withColumn("_c", upto_row).where(F.col("_c") >= draw).orderBy(order).limit(1).drop("_c", "_range", "_before")


def training_set(latest: DataFrame, features: DataFrame, classes: list[str], names: Sequence[str], twins: DataFrame | None = None) -> DataFrame:
    """Rows a fit can use (item_id as text, label, features, weight): items with a trusted label among the classes, a propensity and
    every answer. A twin (item_id of its source, features) is one more row under `<item_id>__twin` with its source's label and
    propensity. Weights are over all rows, twins included. What is left out is counted by `records.drop_reason`."""
    usable = latest.where(F.col("label").isin(*classes) & F.col("propensity").isNotNull()).select("item_id", "label", "propensity")
    whole = ["item_id", "label", "propensity", *names]
    own = usable.join(features, "item_id")
    rows = own.select(F.col("item_id").cast("string").alias("item_id"), *whole[1:])
    if twins is not None:
        kept = own.select("item_id", "label", "propensity").join(twins, "item_id")
        rows = rows.unionByName(kept.select(F.concat(F.col("item_id").cast("string"), F.lit("__twin")).alias("item_id"), *whole[1:]))
    return inverse_propensity(rows, []).select("item_id", "label", *names, "weight")
