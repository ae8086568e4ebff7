"""Aggregates over runs, arms and slices: what the study reports count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gain(runs: DataFrame) -> DataFrame:
    """arm, run, gain: a run's last version's accuracy less its best fitted one's. Rows: arm, run, version, kind, accuracy."""
    return runs.groupBy("arm", "run").agg((F.max_by("accuracy", "version") - F.max(F.when(F.col("kind") == "fit", F.col("accuracy")))).alias("gain"))


def spread(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, mean and sample deviation (0 for a single row) by the keys."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("deviation"))


def slice_gate(rows: DataFrame, by: Sequence[str], student: str, teacher: str, least: int = 30, margin: float = 0.02) -> DataFrame:
    """Accuracy of student and teacher in every slice of at least `least` rows, and whether the student is within the margin."""
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col(student).cast("double")).alias("student"), F.avg(F.col(teacher).cast("double")).alias("teacher")).where(F.col("n") >= least)
    return out.withColumn("passes", F.col("student") >= F.col("teacher") - margin)


def flips_by_element(before: DataFrame, after: DataFrame, keys: Sequence[str] = ("item_id", "element"), most: float = 0.02) -> DataFrame:
    """element, n, flip_rate, passes: the share of items whose verdict changes between two sets of answers. Items that only one side
    has raise an error: the sets must be the same."""
    both = before.select(*keys, F.col("verdict").alias("was")).withColumn("_b", F.lit(True)).join(after.select(*keys, F.col("verdict").alias("now")).withColumn("_a", F.lit(True)), list(keys), "full_outer")
    guarded = F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(F.lit("the two sets do not hold the same items")).cast("boolean")).otherwise(~F.col("was").eqNullSafe(F.col("now")))
    rate = both.withColumn("_f", guarded).groupBy("element").agg(F.count("*").alias("n"), F.avg(F.col("_f").cast("double")).alias("flip_rate"))
    return rate.withColumn("passes", F.col("flip_rate") <= most)


def twins(items: DataFrame, text: Column, swapped: Column, where: Column) -> DataFrame:
    """The items, and for those that `where` names a second row with the swapped text, the other gender and the item's id."""
    base = items.select("*", F.lit(None).cast("string").alias("counterfactual_of"))
    other = F.when(F.col("gender") == "female", "male").when(F.col("gender") == "male", "female")
    twin = items.where(where).withColumn("counterfactual_of", F.col("item_id")).withColumn("item_id", F.concat("item_id", F.lit("__twin"))).withColumn("gender", other).withColumn("text", swapped)
    return base.unionByName(twin)


def version_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """key, change: added, retired or reworded elements between two versions (key, instructions, criteria)."""
    both = old.select("key", F.struct("instructions", "criteria").alias("was")).join(new.select("key", F.struct("instructions", "criteria").alias("now")), "key", "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "retired").when(F.col("was") != F.col("now"), "reworded")
    return both.select("key", change.alias("change")).where("change is not null")


def due_steps(steps: DataFrame, labels: DataFrame) -> DataFrame:
    """step, label: each step with the label after which it is due, the after_labels-th by time. Labels are numbered by counts per day
    and numbers within the day, so that no task numbers the whole log. steps: step, after_labels; labels: event_id, ts."""
    from pyspark.sql.window import Window

    daily = labels.withColumn("day", F.to_date("ts"))
    before = daily.groupBy("day").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("day")) - F.col("n"))  # a row per day
    numbered = daily.join(F.broadcast(before), "day").withColumn("place", F.col("before") + F.row_number().over(Window.partitionBy("day").orderBy("ts", "event_id")))
    return steps.join(numbered.select("event_id", "place"), F.col("after_labels") == F.col("place"), "left").select("step", "after_labels", F.col("event_id").alias("due_at"))
