"""Shortlists of the best-scored, and whether they treat groups alike. Rows: item_id (text), score, twin_score, gender, positive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ranked(pool: DataFrame, cut: int) -> DataFrame:
    """The best `cut` by score, equal scores by id as text: a top-k plan, no total sort."""
    return pool.orderBy(F.desc("score"), "item_id").limit(cut)


def thresholds(pool: DataFrame, cut: int) -> DataFrame:
    """One row: score and id at rank cut (t_*) and at rank cut + 1 (u_*, null if there is none)."""
    best = pool.select("score", "item_id").orderBy(F.desc("score"), "item_id").limit(cut + 1)
    listed = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("item_id").alias("i")))).alias("b"))
    at = lambda k: F.get("b", F.lit(k))
    last = F.get("b", F.least(F.lit(cut), F.size("b")) - 1)
    return listed.select((-last["s"]).alias("t_score"), last["i"].alias("t_id"), (-at(cut)["s"]).alias("u_score"), at(cut)["i"].alias("u_id"))


def with_membership(pool: DataFrame, cut: int) -> DataFrame:
    """selected (now in), and selected_twin (in if this applicant alone had its twin's score), by comparing with two thresholds: an
    applicant that is in is measured against rank cut + 1, one that is out against rank cut."""
    t = pool.crossJoin(F.broadcast(thresholds(pool, cut)))
    better = lambda score, s, i: (score > s) | ((score == s) & (F.col("item_id") <= i))
    selected = better(F.col("score"), F.col("t_score"), F.col("t_id"))
    bar = lambda a, b: F.when(selected, F.col(a)).otherwise(F.col(b))
    twin = F.col("twin_score")
    ahead = (twin > bar("u_score", "t_score")) | ((twin == bar("u_score", "t_score")) & (F.col("item_id") < bar("u_id", "t_id")))
    return t.withColumns({"selected": selected, "selected_twin": F.when(F.col("u_score").isNull(), True).otherwise(ahead)})


def fairness(pool: DataFrame, cuts: list[int]) -> DataFrame:
    """By cut: selected rates of positives by gender, their ratio (null if no man is in), the ratio with ties shared out evenly, the
    ties at the cut, and how many positives enter or leave when read as the twin."""
    out = None
    for cut in cuts:
        rows = with_membership(pool, cut)
        tied, above = F.col("score") == F.col("t_score"), F.col("score") > F.col("t_score")
        counts = rows.agg(F.count_if(above).alias("above"), F.count_if(tied).alias("tied"))
        credit = F.when(above | (F.col("tied") == 0), above.cast("double")).when(tied, (F.lit(cut) - F.col("above")) / F.col("tied")).otherwise(0.0)
        mean = lambda x, g: F.avg(F.when(F.col("positive") & (F.col("gender") == g), x))
        ins, outs = F.col("positive") & ~F.col("selected") & F.col("selected_twin"), F.col("positive") & F.col("selected") & ~F.col("selected_twin")
        marked = rows.crossJoin(F.broadcast(counts)).withColumn("credit", F.least(credit, F.lit(1.0)))
        one = marked.agg(
            F.lit(cut).alias("cut"), mean(F.col("selected").cast("double"), "female").alias("female_rate"), mean(F.col("selected").cast("double"), "male").alias("male_rate"), mean(F.col("credit"), "female").alias("_f"), mean(F.col("credit"), "male").alias("_m"),
            F.max("above").alias("above"), F.max("tied").alias("tied"), F.count_if(ins & (F.col("gender") == "female")).alias("female_in"), F.count_if(outs & (F.col("gender") == "female")).alias("female_out"), F.count_if(ins & (F.col("gender") == "male")).alias("male_in"), F.count_if(outs & (F.col("gender") == "male")).alias("male_out"),
        ).withColumns({"ratio": F.col("female_rate") / F.nullif(F.col("male_rate"), F.lit(0.0)), "tie_fair_ratio": F.col("_f") / F.nullif(F.col("_m"), F.lit(0.0))}).drop("_f", "_m")
        out = one if out is None else out.unionByName(one)
    return out
