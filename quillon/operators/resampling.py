"""Bootstrap intervals of statistics that rank the resample anew."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordering

DRAWS = "cut int, bin long, resample int, need long, drawn_o long, drawn_f long, drawn_m long, above_f long, above_m long, all_f long, all_m long"


def _draws(cells: np.ndarray, cuts: Sequence[int], seed: int):
    """A resample is a multinomial draw over bins of neighbours in the ranking (bins x others, women, men). By cut: the bin in which it
    falls, how many places are left there, and what is above it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = int(cells.sum())
        for batch in batches:
            rows = []
            for r in batch["id"]:
                drawn = np.random.default_rng([seed, int(r)]).multinomial(n, cells.ravel() / n).reshape(cells.shape)
                upto = drawn.sum(1).cumsum()
                for cut in cuts:
                    b = int(np.searchsorted(upto, min(cut, n)))
                    above = drawn[:b].sum(0)
                    rows.append((cut, b, int(r), min(cut, n) - int(above.sum()), *map(int, drawn[b]), int(above[1]), int(above[2]), int(drawn[:, 1].sum()), int(drawn[:, 2].sum())))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DRAWS.split(", ")])

    return run


def _placed(seed: int):
    """Deals a bin's drawn places out over its applicants and takes the first in order, as many as places are left."""

    def run(key: tuple, applicants: pd.DataFrame, draws: pd.DataFrame) -> pd.DataFrame:
        kind = applicants.sort_values("place")["kind"].to_numpy()
        rows = []
        for d in draws.itertuples():
            rng, times = np.random.default_rng([seed, int(d.resample), int(d.bin), 1]), np.zeros(len(kind), np.int64)
            for k, total in enumerate((d.drawn_o, d.drawn_f, d.drawn_m)):
                if total:
                    at = np.flatnonzero(kind == k)
                    times[at] = rng.multinomial(int(total), np.full(len(at), 1 / len(at)))
            taken = np.clip(d.need - (times.cumsum() - times), 0, times)
            rows.append((int(d.cut), int(d.resample), int(d.above_f + taken[kind == 1].sum()), int(d.above_m + taken[kind == 2].sum()), int(d.all_f), int(d.all_m)))
        return pd.DataFrame(rows, columns=["cut", "resample", "in_f", "in_m", "all_f", "all_m"])

    return run


def ratio_resamples(pool: DataFrame, cuts: Sequence[int], resamples: int = 1000, seed: int = 0, bins: int = 1024) -> DataFrame:
    """cut, resample, ratio of the shortlisted shares of women and men among the positives, null where no man is shortlisted. Applicants
    (item_id, score, gender, positive) are drawn with replacement as many times as there are, the best `cut` by (score, id) taken; copies
    of one applicant stand together. Resamples are the same for all cuts.

    The ranking is sorted once. A resample then costs a draw over bins of the ranking, which is what the driver and every task know of it
    (3 numbers a bin), and a draw over the applicants of the one bin that the cut falls in, whose rows one task holds."""
    spark = pool.sparkSession
    who = F.when(~F.col("positive"), 0).when(F.col("gender") == "female", 1).when(F.col("gender") == "male", 2).otherwise(0)
    placed = ordering.positions(pool.select((-F.col("score")).alias("loss"), "item_id", who.cast("int").alias("kind")), ["loss", "item_id"], "place")
    n = placed.count()
    if not n:
        return spark.createDataFrame([], "cut int, resample int, ratio double")
    binned = placed.select("place", "kind", F.floor((F.col("place") - 1) * bins / F.lit(n)).cast("long").alias("bin"))
    cells = np.zeros((bins, 3), np.int64)
    for r in binned.groupBy("bin", "kind").count().collect():
        cells[r["bin"], r["kind"]] = r["count"]
    draws = spark.range(0, resamples, 1, spark.sparkContext.defaultParallelism).mapInPandas(_draws(cells, list(cuts), seed), DRAWS)
    found = binned.groupBy("bin").cogroup(draws.groupBy("bin")).applyInPandas(_placed(seed), "cut int, resample int, in_f long, in_m long, all_f long, all_m long")
    share = lambda g: F.when(F.col(f"all_{g}") > 0, F.col(f"in_{g}") / F.col(f"all_{g}")).otherwise(0.0)
    return found.select("cut", "resample", (share("f") / F.nullif(share("m"), F.lit(0.0))).alias("ratio"))


def ratio_intervals(pool: DataFrame, cuts: Sequence[int], resamples: int = 1000, seed: int = 0, bins: int = 1024) -> DataFrame:
    """cut, low, high, used: the 2.5 and 97.5 % points of the resamples that have a ratio; null without any."""
    ratios = ratio_resamples(pool, cuts, resamples, seed, bins).groupBy("cut").agg(F.array_sort(F.collect_list("ratio")).alias("r"))  # one number a resample
    at = lambda share: F.get("r", F.floor(F.size("r") * F.lit(share)).cast("int"))
    return ratios.select("cut", at(0.025).alias("low"), at(0.975).alias("high"), F.size("r").cast("long").alias("used"))


def resampled_sums(rows: DataFrame, key: str, columns: Sequence[str], resamples: int = 1000, seed: int = 0, block: int = 10_000) -> DataFrame:
    """resample, n, and the sum of each column over a draw of as many rows as there are, with replacement; nulls count 0.

    Rows are dealt out over blocks by a hash of the key. A resample deals its draws out over the blocks first, a multinomial draw that
    every task makes alike from the blocks' sizes, and each block then over its rows: the work is rows times resamples, in all tasks."""
    total = rows.count()
    blocks = max(1, -(-total // block))
    dealt = rows.select(F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("b"), key, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    sizes = np.zeros(blocks, np.int64)
    for r in dealt.groupBy("b").count().collect():
        sizes[r["b"]] = r["count"]
    schema = "resample int, " + ", ".join(f"{c} double" for c in columns)

    def run(group: tuple, own: pd.DataFrame) -> pd.DataFrame:
        values = own.sort_values(key)[list(columns)].to_numpy()
        out = np.zeros((resamples, len(columns)))
        for r in range(resamples):
            k = np.random.default_rng([seed, r]).multinomial(total, sizes / total)[int(group[0])]
            times = np.random.default_rng([seed, r, int(group[0]), 1]).multinomial(k, np.full(len(values), 1 / len(values)))
            out[r] = times @ values
        return pd.DataFrame(out, columns=list(columns)).assign(resample=np.arange(resamples))[["resample", *columns]]

    sums = dealt.groupBy("b").applyInPandas(run, schema).groupBy("resample").agg(*[F.sum(c).alias(c) for c in columns])
    return sums.withColumn("n", F.lit(total).cast("double"))


def intervals(sums: DataFrame, stats: Mapping[str, Column]) -> DataFrame:
    """statistic, low, high, used: the 2.5 and 97.5 % points of each statistic over the resamples that have it."""
    gathered = sums.agg(*[F.array_sort(F.collect_list(c)).alias(n) for n, c in stats.items()])  # one number a resample
    rows = gathered.select(F.explode(F.array(*[F.struct(F.lit(n).alias("statistic"), F.col(n).alias("r")) for n in stats])).alias("s")).select("s.*")
    at = lambda share: F.get("r", F.floor(F.size("r") * F.lit(share)).cast("int"))
    return rows.select("statistic", at(0.025).alias("low"), at(0.975).alias("high"), F.size("r").cast("long").alias("used"))
