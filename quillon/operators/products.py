"""Many heads over many items at once: a sparse product of features (item, question, term) and weights (version, class, question, term)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONSTANT = "intercept"


def served(items: DataFrame, features: DataFrame, heads: DataFrame) -> DataFrame:
    """item_id, version, value, confidence, coverage, probabilities (a map by class) of every item under every version.

    features: item_id, qhash, term, value: what answers say, by the question that they answer, so that a version meets the answers to its
    own wording and no other's. heads: version, place, class, qhash, term, weight: a few rows a version, intercepts under the term
    CONSTANT; equal probabilities go to the smaller place. A feature that an item lacks counts 0. Coverage is the share of a version's
    features that are there, 1 for a version without any. One join of features and heads, one sum a (item, version, class)."""
    heads = F.broadcast(heads)  # questions of scorecards, made by hand
    classes = heads.groupBy("version", "place", "class").agg(F.coalesce(F.sum(F.when(F.col("term") == CONSTANT, F.col("weight"))), F.lit(0.0)).alias("constant"))
    asked = heads.where(F.col("term") != CONSTANT).groupBy("version").agg(F.count_distinct("qhash", "term").alias("asked"))
    met = features.join(heads.where(F.col("term") != CONSTANT), ["qhash", "term"]).groupBy("item_id", "version", "class").agg(F.sum(F.col("value") * F.col("weight")).alias("sum"))
    there = features.join(F.broadcast(asked_terms(heads)), ["qhash", "term"]).groupBy("item_id", "version").agg(F.count("*").alias("there"))
    every = items.select("item_id").crossJoin(F.broadcast(classes.join(asked, "version", "left")))
    logits = every.join(met, ["item_id", "version", "class"], "left").withColumn("z", F.col("constant") + F.coalesce("sum", F.lit(0.0)))
    one = logits.groupBy("item_id", "version").agg(F.array_sort(F.collect_list(F.struct((-F.col("z")).alias("loss"), "place", "class"))).alias("r"), F.first("asked").alias("asked"))  # of the classes
    top = F.col("r")[0]["loss"]
    powers = F.transform("r", lambda x: F.exp(top - x["loss"]))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    p = F.map_from_arrays(F.transform("r", lambda x: x["class"]), F.transform("r", lambda x: F.exp(top - x["loss"]) / total))
    covered = F.when(F.col("asked").isNull(), 1.0).otherwise(F.coalesce("there", F.lit(0)) / F.col("asked"))
    return one.join(there, ["item_id", "version"], "left").select("item_id", "version", F.col("r")[0]["class"].alias("value"), (1 / total).alias("confidence"), covered.alias("coverage"), p.alias("probabilities"))


def asked_terms(heads: DataFrame) -> DataFrame:
    return heads.where(F.col("term") != CONSTANT).select("version", "qhash", "term").distinct()


def ablated(heads: DataFrame, holistic: Column, reset: Column) -> DataFrame:
    """Three versions of a head: as_fitted; new_zeroed, its weights but the holistic one's and the intercept 0; holistic_reset, the
    holistic weight back at what it was (`reset`, by class) and the others as fitted."""
    constant, weight = F.col("term") == CONSTANT, F.col("weight")
    kinds = {"as_fitted": weight, "new_zeroed": F.when(holistic | constant, weight).otherwise(0.0), "holistic_reset": F.when(holistic, reset).otherwise(weight)}
    versions = F.explode(F.array(*[F.struct(F.lit(k).alias("version"), w.cast("double").alias("weight")) for k, w in kinds.items()]))
    return heads.select("place", "class", "qhash", "term", versions.alias("v")).select("v.version", "place", "class", "qhash", "term", "v.weight")
