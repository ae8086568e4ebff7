"""Counterfactual pairs: an item as written and its twin or versions, and what changed."""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import uniform
from .metrics import calibration_error


def paired_summary(pairs: DataFrame, positive: str, by: str | None = None) -> DataFrame:
    """Rows: predicted, twin_predicted, p, twin_p, truth, gender. Overall (by = 'all') and, with `by`, one row per value:
    n, accuracy, flip_rate, mean_abs_delta, mean_shift, flips, toward_positive (share of flips, null without any), recall_gap."""
    flips = F.col("predicted") != F.col("twin_predicted")
    tpr = lambda g: F.avg(F.when((F.col("truth") == positive) & (F.col("gender") == g), (F.col("predicted") == positive).cast("double")))
    figures = [
        F.count("*").alias("n"), F.avg((F.col("predicted") == F.col("truth")).cast("double")).alias("accuracy"), F.avg(flips.cast("double")).alias("flip_rate"),
        F.avg(F.abs(F.col("twin_p") - F.col("p"))).alias("mean_abs_delta"), F.avg(F.col("twin_p") - F.col("p")).alias("mean_shift"), F.count_if(flips).alias("flips"),
        F.avg(F.when(flips, (F.col("twin_predicted") == positive).cast("double"))).alias("toward_positive"), (tpr("female") - tpr("male")).alias("recall_gap"),
    ]
    keyed = pairs.withColumn("_by", F.col(by) if by else F.lit("all"))
    return (keyed.rollup("_by") if by else keyed.groupBy("_by")).agg(*figures).withColumn("slice", F.coalesce("_by", F.lit("all"))).drop("_by")


def verdict_error(verdicts: DataFrame, positive: str) -> DataFrame:
    """ECE of verdicts: the confidence is p where the positive class is predicted, else 1 - p."""
    confidence = F.when(F.col("predicted") == positive, F.col("p")).otherwise(1 - F.col("p"))
    return calibration_error(verdicts.select(confidence.alias("confidence"), (F.col("predicted") == F.col("truth")).cast("int").alias("correct"), F.lit(1.0).alias("weight")))


def complete_versions(versions: DataFrame, groups: int = 4, names: int = 4) -> DataFrame:
    whole = versions.groupBy("source_id").agg(F.count("*").alias("_n")).where(F.col("_n") == groups * names).select("source_id")
    return versions.join(whole, "source_id", "left_semi")


def group_calls(versions: DataFrame, positive: str) -> DataFrame:
    """By source and group: mean p and the majority call; an even split goes by the mean p."""
    up = F.count_if(F.col("predicted") == positive)
    call = F.when(up * 2 > F.count("*"), True).when(up * 2 < F.count("*"), False).otherwise(F.avg("p") >= 0.5)
    return versions.groupBy("source_id", "grp").agg(F.avg("p").alias("mean_p"), call.alias("call"))


def group_shifts(versions: DataFrame, positive: str, reference: str = "white") -> DataFrame:
    """By other group: mean shift of p against the reference, share of sources whose majority call flips, and of name pairs (same k)
    that flip. The floor is the same between the reference's own names: 3, 4 against 1, 2, and pairs (1, 3), (2, 4)."""
    calls = group_calls(versions, positive)
    own = calls.where(F.col("grp") == reference).select("source_id", F.col("mean_p").alias("ref_p"), F.col("call").alias("ref_call"))
    majority = calls.where(F.col("grp") != reference).join(own, "source_id").groupBy("grp").agg(F.avg(F.col("mean_p") - F.col("ref_p")).alias("shift"), F.avg((F.col("call") != F.col("ref_call")).cast("double")).alias("majority_flip"))
    ref = versions.where(F.col("grp") == reference)
    names = ref.select("source_id", "k", F.col("predicted").alias("ref_predicted"))
    pairs = versions.where(F.col("grp") != reference).join(names, ["source_id", "k"]).groupBy("grp").agg(F.avg((F.col("predicted") != F.col("ref_predicted")).cast("double")).alias("pair_flip"))
    late = group_calls(ref.withColumn("grp", F.when(F.col("k") > 2, "late").otherwise("early")), positive)
    halves = late.where("grp = 'late'").alias("b").join(late.where("grp = 'early'").alias("a"), "source_id").agg(F.avg(F.col("b.mean_p") - F.col("a.mean_p")).alias("shift"), F.avg((F.col("a.call") != F.col("b.call")).cast("double")).alias("majority_flip"))
    moved = ref.withColumn("k", F.col("k") - 2).where("k > 0").select("source_id", "k", F.col("predicted").alias("later"))
    floor_pairs = ref.join(moved, ["source_id", "k"]).agg(F.avg((F.col("predicted") != F.col("later")).cast("double")).alias("pair_flip"))
    floor = halves.crossJoin(floor_pairs).withColumn("grp", F.lit("floor"))
    return majority.join(pairs, "grp").unionByName(floor)


def bootstrap_mean(values: DataFrame, resamples: int = 1000, seed: str = "b") -> DataFrame:
    """Percentile interval of a mean by resampling with md5 draws. values: i (0, 1, ... without gaps), x. The draws of a resample are
    joined by index and averaged before anything is sorted; the sorted table has a row per resample."""
    n = values.agg(F.count("*").alias("n"))
    draws = values.select(F.col("i").alias("j")).crossJoin(F.broadcast(n)).select("j", "n", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("r"))
    picked = draws.select("r", F.floor(uniform(seed, "r", "j") * F.col("n")).cast("bigint").alias("i")).join(values, "i")
    means = picked.groupBy("r").agg(F.avg("x").alias("m")).agg(F.array_sort(F.collect_list("m")).alias("s"))
    at = lambda q: F.element_at("s", min(int(q * resamples), resamples - 1) + 1)
    return means.select(at(0.025).alias("low"), at(0.975).alias("high"))


def bootstrap_share(values: DataFrame, resamples: int = 1000, seed: str = "b") -> DataFrame:
    """Percentile interval of the mean of 0/1 values x. A resample of n values with k ones holds Binomial(n, k / n) ones, so that each
    is drawn from the two counts, by the inverse of the exact distribution at an md5 draw. Without values both limits are 0."""
    n, k, other = values.agg(F.count("x"), F.count_if(F.col("x") == 1), F.count_if(~F.col("x").isin(0, 1))).first()
    if other:
        raise ValueError("bootstrap_share takes values of 0 and 1")
    ones, upto = _binomial(n, k)
    draws = [int(hashlib.md5(f"{seed}#{r}".encode()).hexdigest()[:8], 16) / 4294967296 for r in range(resamples)]
    means = sorted(ones[min(bisect.bisect_right(upto, u), len(ones) - 1)] / max(n, 1) for u in draws)
    at = lambda q: float(means[min(int(q * resamples), resamples - 1)])
    return values.sparkSession.createDataFrame([(at(0.025), at(0.975))], "low double, high double")


def _binomial(n: int, k: int) -> tuple[range, list[float]]:
    """Numbers of ones and their cumulated Binomial(n, k / n) probabilities, over 12 deviations and 40 on each side."""
    if k in (0, n):
        return range(k, k + 1), [1.0]
    wide = int(12 * math.sqrt(k * (n - k) / n)) + 40
    ones = range(max(0, k - wide), min(n, k + wide) + 1)
    odds = math.log(k) - math.log(n - k)
    logs = [odds * (i - k) + math.lgamma(k + 1) + math.lgamma(n - k + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in ones]
    powers = [math.exp(x) for x in logs]  # relative to the likeliest number, k
    total = math.fsum(powers)
    return ones, [x / total for x in itertools.accumulate(powers)]


def answer_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Share of changed top answers and mean change of p, over items that both have."""
    both = before.select("item_id", F.col("predicted").alias("a"), F.col("p").alias("pa")).join(after.select("item_id", F.col("predicted").alias("b"), F.col("p").alias("pb")), "item_id")
    return both.agg(F.count("*").alias("n"), F.avg((F.col("a") != F.col("b")).cast("double")).alias("changed"), F.avg(F.abs(F.col("pa") - F.col("pb"))).alias("mean_abs_delta"))


def pair_up(items: DataFrame, twins: DataFrame) -> DataFrame:
    """Items next to the twin that names them as its source; items without a twin and twins of unknown items drop out."""
    own = items.withColumnRenamed("item_id", "source_id")
    return own.join(twins.select("source_id", F.col("item_id").alias("twin_id"), F.col("p").alias("twin_p"), F.col("predicted").alias("twin_predicted")), "source_id")


def arm_rows(pairs: DataFrame, by: str) -> DataFrame:
    """Accuracy, flips and shifts over all pairs ('all') and by group, in one pass."""
    shift = F.col("twin_p") - F.col("p")
    rate = lambda c: F.avg(c.cast("double"))
    return pairs.groupingSets([[], [by]], by).agg(
        F.count("*").alias("n"), rate(F.col("predicted") == F.col("truth")).alias("accuracy"), rate(F.col("predicted") != F.col("twin_predicted")).alias("flip_rate"),
        F.avg(F.abs(shift)).alias("mean_abs_shift"), F.avg(shift).alias("mean_shift"),
    ).withColumn(by, F.coalesce(by, F.lit("all")))


def version_rows(items: DataFrame, groups: list[str], names: int) -> DataFrame:
    """Every item under `names` names of each group: columns grp and k (from 1)."""
    with_groups = items.select("*", F.explode(F.array(*map(F.lit, groups))).alias("grp"))
    return with_groups.select("*", F.explode(F.sequence(F.lit(1), F.lit(names))).alias("k"))


def pairwise_flips(versions: DataFrame, groups: list[str], reference: str, names: int) -> DataFrame:
    """Share of names whose verdict differs from the reference's name of the same place, by group. The reference's own row compares its
    first half with its second. One shuffle by item; a place that either side lacks doesn't count."""
    at = lambda g, k: F.max(F.when((F.col("grp") == g) & (F.col("k") == k), F.col("predicted")))
    wide = versions.groupBy("source_id").agg(*[at(g, k).alias(f"{g}_{k}") for g in (reference, *groups) for k in range(1, names + 1)])
    couples = [(g, f"{g}_{k}", f"{reference}_{k}") for g in groups for k in range(1, names + 1)]
    couples += [(reference, f"{reference}_{k}", f"{reference}_{k + names // 2}") for k in range(1, names // 2 + 1)]
    flips = wide.select(F.explode(F.array(*[F.struct(F.lit(g).alias("grp"), (F.col(a) != F.col(b)).alias("flip")) for g, a, b in couples])).alias("c")).select("c.*").where("flip is not null")
    return flips.groupBy("grp").agg(F.count("*").alias("n"), F.avg(F.col("flip").cast("double")).alias("flip_rate"))


def flip_mismatches(pairs: DataFrame) -> DataFrame:
    """Pairs whose verdict changes on the twin, in the shape of mismatches that a person explained. Pairs without one verdict are left out."""
    return pairs.where("predicted <> twin_predicted").select("source_id", F.col("predicted").alias("we_said"), F.round(F.greatest("p", 1 - F.col("p")), 4).alias("confidence_when_shown"), F.col("twin_predicted").alias("human_said"), F.lit("only the pronouns differ").alias("human_comment"))


def source_shifts(versions: DataFrame, groups: list[str], reference: str, names: int = 4) -> DataFrame:
    """source_id, a column per group: the mean p under its names less that under the reference's; floor_shift: the same between the
    second and the first half of the reference's own names."""
    mean = lambda g, *which: F.avg(F.when(F.col("grp") == g if not which else (F.col("grp") == g) & which[0], F.col("p")))
    late = F.col("k") > names // 2
    own = [(mean(g) - mean(reference)).alias(g) for g in groups]
    return versions.groupBy("source_id").agg(*own, (mean(reference, late) - mean(reference, ~late)).alias("floor_shift"))


def stability(asks: DataFrame, base: str) -> DataFrame:
    """name, asked: how answers (item_id, name, asked, p) compare with those of `base`: n, identical, largest (difference), flips."""
    first = asks.where(F.col("asked") == base).select("item_id", "name", F.col("p").alias("own"))
    both = asks.where(F.col("asked") != base).join(first, ["item_id", "name"])
    return both.groupBy("name", "asked").agg(F.count("*").alias("n"), F.count_if(F.col("p") == F.col("own")).alias("identical"), F.max(F.abs(F.col("p") - F.col("own"))).alias("largest"), F.count_if((F.col("p") >= 0.5) != (F.col("own") >= 0.5)).alias("flips"))
