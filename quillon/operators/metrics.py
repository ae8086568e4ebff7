"""Measurements of scored items. Rows: confidence, correct (0/1), weight; results by any grouping columns.

Rank and threshold metrics work on the histogram of distinct confidences, which partial aggregation makes before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def share(top: Column, total: Column) -> Column:
    """top / total, 0 where total is 0 or missing."""
    return F.coalesce(top / F.nullif(total, F.lit(0.0)), F.lit(0.0))


def accuracy(weight: Column, correct: Column) -> Column:
    return share(F.sum(weight * correct), F.sum(weight))


def brier(weight: Column, confidence: Column, correct: Column) -> Column:
    return share(F.sum(weight * (confidence - correct) * (confidence - correct)), F.sum(weight))


def log_loss(weight: Column, true_probability: Column, floor: float = 1e-6) -> Column:
    return share(-F.sum(weight * F.ln(F.greatest(true_probability, F.lit(floor)))), F.sum(weight))


def kish(weight: Column) -> Column:
    return share(F.sum(weight) * F.sum(weight), F.sum(weight * weight))


def reliability(rows: DataFrame, by: list[str] | None = None, bins: int = 10) -> DataFrame:
    """bin, mass, mean_confidence, bin_accuracy of bins with mass; 1.0 falls into the last."""
    by = by or []
    at = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    w = F.col("weight")
    return rows.groupBy(*by, at.alias("bin")).agg(F.sum(w).alias("mass"), share(F.sum(w * F.col("confidence")), F.sum(w)).alias("mean_confidence"), accuracy(w, F.col("correct")).alias("bin_accuracy")).where("mass > 0")


def calibration_error(rows: DataFrame, by: list[str] | None = None, bins: int = 10) -> DataFrame:
    by = by or []
    gap = F.col("mass") * F.abs(F.col("mean_confidence") - F.col("bin_accuracy"))
    return reliability(rows, by, bins).groupBy(*by).agg(share(F.sum(gap), F.sum("mass")).alias("ece"))


def summary(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, accuracy, ece, brier, mean_confidence, overconfidence."""
    by = by or []
    w, c, k = F.col("weight"), F.col("confidence"), F.col("correct")
    at = F.least(F.floor(c * 10), F.lit(9)).cast("int")
    # sums by bin first: the one aggregate that all the figures follow from
    sums = rows.groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n"), F.sum(w).alias("m"), F.sum(w * c).alias("mc"), F.sum(w * k).alias("mk"), F.sum(w * (c - k) * (c - k)).alias("mb"))
    m = F.sum("m")
    return sums.groupBy(*by).agg(F.sum("n").alias("n"), share(F.sum("mk"), m).alias("accuracy"), share(F.sum(F.abs(F.col("mc") - F.col("mk"))), m).alias("ece"), share(F.sum("mb"), m).alias("brier"), share(F.sum("mc"), m).alias("mean_confidence")).withColumn("overconfidence", F.col("mean_confidence") - F.col("accuracy"))


def histogram(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(by or []), "confidence").agg(F.count("*").alias("n"), F.sum("correct").cast("bigint").alias("k"))


def auroc(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mann-Whitney with mean ranks; null where a class is missing."""
    by = by or []
    below = F.sum("n").over(Window.partitionBy(*by).orderBy("confidence").rowsBetween(Window.unboundedPreceding, -1))
    ranks = histogram(rows, by).withColumn("rank", F.coalesce(below, F.lit(0)) + (F.col("n") + 1) / F.lit(2.0))
    pos, neg = F.sum("k"), F.sum(F.col("n") - F.col("k"))
    area = (F.sum(F.col("k") * F.col("rank")) - pos * (pos + 1) / F.lit(2.0)) / F.nullif(pos * neg, F.lit(0))
    return ranks.groupBy(*by).agg(F.round(area, 4).alias("auroc"))


def coverage_at(rows: DataFrame, least: float = 0.95, by: list[str] | None = None) -> DataFrame:
    """How many rows may be decided, most confident first, before accuracy falls under `least`; equal confidences go together
    and the first block that falls short ends it. coverage, accuracy (null without any), tie_block (size of the last block)."""
    by = by or []
    down = Window.partitionBy(*by).orderBy(F.desc("confidence")).rowsBetween(Window.unboundedPreceding, 0)
    blocks = histogram(rows, by).withColumns({"cn": F.sum("n").over(down), "ck": F.sum("k").over(down)})
    short = F.max((F.col("ck") / F.col("cn") < least).cast("int")).over(down)
    kept = blocks.withColumn("short", short)
    n, ok = F.sum("n"), F.col("short") == 0
    return kept.groupBy(*by).agg(share(F.coalesce(F.max(F.when(ok, F.col("cn"))), F.lit(0)).cast("double"), n.cast("double")).alias("coverage"), F.max_by(F.col("ck") / F.col("cn"), F.when(ok, F.col("cn"))).alias("accuracy"), F.coalesce(F.max_by("n", F.when(ok, F.col("cn"))), F.lit(0)).alias("tie_block"))


def confusion(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Counts of all pairs of the labels that occur on either side, zeros included."""
    labels = rows.select(F.col(actual).alias("label")).union(rows.select(predicted)).distinct()
    counts = rows.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    # labels are classes of a scorecard, a handful
    grid = labels.withColumnRenamed("label", "actual").crossJoin(labels.withColumnRenamed("label", "predicted"))
    return grid.join(counts, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))
