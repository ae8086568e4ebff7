"""Fitting heads and calibrations from labelled rows.

Labelled rows are what people have labelled; `newton` fits heads to them, all values of C and all folds at once. Out-of-fold predictions
are what calibration may learn from: only `cross_validated` makes them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import logit, temper
from . import newton


@dataclass(frozen=True)
class Tier:
    name: str
    least: float
    per_feature: float
    grid: tuple[float, ...]
    calibration: str = "none"

    def budget(self, n_effective: float) -> int:
        return int(n_effective // self.per_feature) if self.per_feature else 0


#: The rungs: effective labels needed, effective labels a feature, values of C to try, calibration (fixed values).
LADDER = (
    Tier("hold", 0, 0, ()),
    Tier("shrunk", 30, 5, (0.03, 0.1, 0.3), "temperature"),
    Tier("standard", 200, 10, (0.03, 0.1, 0.3, 1.0, 3.0, 10.0), "temperature"),
    Tier("rich", 1000, 10, (0.03, 0.1, 0.3, 1.0, 3.0, 10.0, 100.0), "two_stage"),
)


class Refused(ValueError):
    """The evidence does not carry the fit that was asked for."""


def tier_for(n_effective: float, ladder: tuple[Tier, ...] = LADDER) -> Tier:
    return max((t for t in ladder if t.least <= n_effective), key=lambda t: t.least)


def to_next(n_effective: Column, ladder: tuple[Tier, ...] = LADDER) -> Column:
    """Effective labels that the next rung needs more; null on the highest."""
    out = F.lit(None).cast("double")
    for t in reversed(ladder):
        out = F.when(n_effective < t.least, t.least - n_effective).otherwise(out)
    return out


def stratified_folds(rows: DataFrame, label: str, key: str, folds: int = 5, seed: str = "fold") -> DataFrame:
    """fold: labels dealt out in turn, in the order of a hash of the key."""
    order = Window.partitionBy(label).orderBy(F.md5(F.concat(F.lit(f"{seed}#"), F.col(key).cast("string"))), key)
    return rows.withColumn("fold", F.pmod(F.row_number().over(order) - 1, F.lit(folds)).cast("int"))


def logistic(rows: DataFrame, features: list[str], c: float):
    """L2 logistic regression with sklearn's objective: regParam = 1 / (c * sum of weights)."""
    if not (total := rows.agg(F.sum("weight")).first()[0]):
        raise Refused("no weight to learn from")
    assembled = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="error").transform(rows)
    return LogisticRegression(featuresCol="_x", labelCol="y", weightCol="weight", regParam=1 / (c * total), elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-9).fit(assembled)


def predicted(rows: DataFrame, model, features: list[str]) -> DataFrame:
    assembled = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="error").transform(rows)
    p = vector_to_array("_probability")[1]
    out = model.setProbabilityCol("_probability").setRawPredictionCol("_raw").setPredictionCol("_prediction").transform(assembled)
    return out.withColumn("p", p).drop("_x", "_raw", "_probability", "_prediction")


@dataclass(frozen=True)
class OutOfFold:
    """confidence, correct, weight, fold: made by models that did not see the row."""

    rows: DataFrame
    c: float
    log_loss: float


def cross_validated(rows: DataFrame, features: list[str], grid: tuple[float, ...], folds: int = 5, classes: int = 2) -> OutOfFold:
    """The grid value with the least weighted out-of-fold log loss, and its predictions. Rows: y (0 to classes - 1), weight, fold, features."""
    c, params, loss = newton.chosen_c(rows, features, grid, folds, classes)
    p = F.array(*newton.probabilities(features, params, "fold"))
    told = rows.select(p.alias("p"), "y", "weight", "fold").withColumn("confidence", F.array_max("p"))
    hit = (F.array_position("p", F.col("confidence")) - 1 == F.col("y")).cast("int")
    return OutOfFold(told.select("confidence", hit.alias("correct"), "weight", "fold"), c, loss)


def fit_temperature(oof: DataFrame, steps: int = 200) -> float:
    """The temperature in [0.1, 10] with the least weighted negative log likelihood, which has one minimum: a row per point of a log
    grid and cell of equal (confidence, correct), summed up inside each task; then the same between the neighbours of its best."""
    cells = oof.groupBy("confidence", "correct").agg(F.sum("weight").alias("w"))
    p = F.least(F.greatest(1 / (1 + F.exp(-F.col("z") / F.col("t"))), F.lit(1e-9)), F.lit(1 - 1e-9))
    loss = -F.sum(F.col("w") * F.ln(F.when(F.col("correct") == 1, p).otherwise(1 - p)))
    low, high = 0.1, 10.0
    for _ in range(2):
        grid = [low * (high / low) ** (i / steps) for i in range(steps + 1)]
        points = F.explode(F.array(*map(F.lit, grid))).alias("t")
        by = cells.select(logit(F.col("confidence"), 1e-6).alias("z"), "correct", "w", points).groupBy("t").agg(loss.alias("loss"))
        row = by.agg(F.min(F.struct("loss", "t")).alias("least")).first()
        if row[0] is None or row[0]["loss"] is None:
            return 1.0
        best = min(range(len(grid)), key=lambda i: abs(grid[i] - row[0]["t"]))
        low, high = grid[max(0, best - 1)], grid[min(steps, best + 1)]
    return grid[best]


@dataclass(frozen=True)
class Calibration:
    """101 points over 0..1, the method used, its temperature (null without one), and why it isn't the one that was asked for."""

    table: list[float]
    method: str
    temperature: float | None = None
    fallback_reason: str | None = None
    n: int = 0

    def config(self) -> dict:
        """As a scorecard's decision keeps it."""
        raw = [i / (len(self.table) - 1) for i in range(len(self.table))]
        why = {"fallback_reason": self.fallback_reason} if self.fallback_reason else {}
        return {"method": self.method, "temperature": self.temperature or 1.0, "raw_confidence": raw, "calibrated_confidence": self.table, "fit_on": "out_of_fold", "n": self.n} | why


def calibrate(oof: DataFrame, method: str = "two_stage") -> Calibration:
    """A monotone table from out-of-fold rows; too few rows for the method (temperature 10, isotonic and two_stage 50) leave "none"."""
    n, least = oof.count(), {"none": 0, "temperature": 10, "isotonic": 50, "two_stage": 50}[method]
    used = "none" if n < least else method
    t = fit_temperature(oof) if used in ("temperature", "two_stage") else None
    raw = [i / 100 for i in range(101)]
    soft = [x if t is None else 1 / (1 + math.exp(-math.log(max(x, 1e-6) / max(1 - x, 1e-6)) / t)) for x in raw]
    if used in ("isotonic", "two_stage"):
        x = temper(F.col("confidence"), t) if used == "two_stage" else F.col("confidence")
        model = IsotonicRegression(featuresCol="x", labelCol="y", weightCol="weight").fit(oof.select(x.alias("x"), F.col("correct").cast("double").alias("y"), "weight"))
        xs, ys = model.boundaries.toArray().tolist(), model.predictions.toArray().tolist()
        soft = [interpolated(s, xs, ys) for s in soft]
    out, top = [], 0.0
    for s in soft:
        top = max(top, min(max(s, 0.0), 1.0))
        out.append(top)
    return Calibration(out, used, t, None if used == method else f"{n} out-of-fold rows; {method} needs {least}", n)


def calibration_table(oof: DataFrame, method: str = "two_stage") -> tuple[list[float], str]:
    """The table and the method used."""
    found = calibrate(oof, method)
    return found.table, found.method


def interpolated(x: float, xs: list[float], ys: list[float]) -> float:
    if x <= xs[0]:
        return ys[0]
    for a, b, fa, fb in zip(xs, xs[1:], ys, ys[1:], strict=False):
        if x <= b:
            return fb if b == a else fa + (x - a) / (b - a) * (fb - fa)
    return ys[-1]


def compare(candidate: DataFrame, incumbent: DataFrame, least_gain: float = 0.005, flips: DataFrame | None = None, most_flips: float = 0.02) -> DataFrame:
    """One row: whether the candidate is promoted and why not. Inputs are one-row summaries with accuracy, brier, n_effective, and
    optionally the flip rate of each new element on twins (element, flip_rate): one above `most_flips` rejects the candidate."""
    both = candidate.select(F.col("accuracy").alias("a1"), F.col("brier").alias("b1"), "n_effective").crossJoin(incumbent.select(F.col("accuracy").alias("a0"), F.col("brier").alias("b0")))
    slack = 2 / F.greatest("n_effective", F.lit(1.0))
    reasons = F.array_compact(F.array(F.when(F.col("b0") - F.col("b1") < least_gain, "brier gain too small"), F.when(F.col("a1") < F.col("a0") - slack, "accuracy fell")))
    if flips is not None:
        gated = flips.where(F.col("flip_rate") > most_flips).agg(F.array_sort(F.collect_list(F.concat(F.lit("flips too often: "), "element"))).alias("gated"))
        both, reasons = both.crossJoin(F.broadcast(gated)), F.concat(reasons, F.col("gated"))
    return both.select((F.col("b0") - F.col("b1")).alias("brier_gain"), (F.col("a1") - F.col("a0")).alias("accuracy_change"), slack.alias("tolerance"), reasons.alias("reasons"), (F.size(reasons) == 0).alias("promoted"))


def fit_head(rows: DataFrame, features: list[str], n_effective: float, folds: int = 5, ladder: tuple[Tier, ...] = LADDER) -> dict:
    """Weights and intercept (of the second of two classes; `heads` has those of every class if there are more), calibration and
    out-of-fold figures. rows: item_id, y (0 to classes - 1), weight, features. On the lowest rung the incumbent is held, which is a
    result; Refused when the ladder does not carry the fit, or a class has fewer than three labels."""
    tier = tier_for(n_effective, ladder)
    if not tier.grid:
        return {"status": "held", "tier": tier.name, "reason": f"{n_effective:.1f} effective labels; {ladder[1].least - n_effective:.1f} more are needed"}
    if len(features) > tier.budget(n_effective):
        raise Refused(f"{len(features)} features; {n_effective:.0f} effective labels carry {tier.budget(n_effective)}")
    classes, least, most = rows.groupBy("y").count().agg(F.count("*"), F.min("count"), F.max("y")).first()
    if classes < 2:
        raise Refused("labels of one class only")
    if least < 3:
        raise Refused(f"{least} labels of a class; three are needed")
    if most != classes - 1:
        raise Refused(f"labels up to {most:.0f} of {classes} classes; they count from 0 without a gap")
    folds = min(folds, least)
    dealt = stratified_folds(rows, "y", "item_id", folds).select("item_id", "y", "weight", "fold", *features).persist()
    try:
        oof = cross_validated(dealt, features, tier.grid, folds, classes)
        kept = oof.rows.persist()  # read by the calibration several times
        found = calibrate(kept, tier.calibration)
        accuracy = kept.agg(F.sum(F.col("weight") * F.col("correct")) / F.sum("weight")).first()[0]
        brier = kept.agg(F.sum(F.col("weight") * (F.col("confidence") - F.col("correct")) ** 2) / F.sum("weight")).first()[0]
        kept.unpersist()
        params = newton.fitted(dealt, features, [newton.Job(oof.c)], classes)[0]
    finally:
        dealt.unpersist()
    own = [(float(p[0]), dict(zip(features, map(float, p[1:]), strict=True))) for p in params]
    return {
        "status": "fitted", "tier": tier.name, "c": oof.c, "log_loss": oof.log_loss, "accuracy": accuracy, "brier": brier, "weights": own[0][1], "intercept": own[0][0], "heads": own,
        "table": found.table, "method": found.method, "temperature": found.temperature, "fallback_reason": found.fallback_reason, "calibration": found.config(),
    }


def fit_ids(rows: DataFrame, by: Sequence[str], features: Sequence[str], c: float) -> DataFrame:
    """fit_id by group: dh- and ten hex digits that name the labels learnt from (item_id, label), the features and the constant. The order
    of the rows doesn't matter: their hashes are summed, so no group is gathered in one place."""
    digits = F.substring(F.sha2(F.concat_ws("\x1f", F.col("item_id").cast("string"), "label"), 256), 1, 15)
    sums = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.conv(digits, 16, 10).cast("decimal(20,0)")).alias("labels"))
    named = F.sha2(F.concat_ws("|", "n", F.col("labels").cast("string"), F.lit(",".join(features)), F.lit(str(c))), 256)
    return sums.select(*by, "n", F.concat(F.lit("dh-"), F.substring(named, 1, 10)).alias("fit_id"))


def matrix(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """missing: the names of features that a row lacks; vector: its features in the order of names, null if any is missing."""
    absent = F.filter(F.array(*[F.when(F.col(n).isNull() | F.isnan(n), F.lit(n)) for n in names]), lambda n: n.isNotNull())
    return rows.withColumn("missing", absent).withColumn("vector", F.when(F.size("missing") == 0, F.array(*names)))


def complete_matrix(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """The same, refused if any row lacks a feature: a neutral value in its place would draw the feature's weight to zero."""
    said = F.concat(F.lit("training needs full coverage; missing "), F.array_join("missing", ", "))
    return matrix(rows, names).withColumn("vector", F.coalesce("vector", F.raise_error(said).cast("array<double>"))).drop("missing")


def serving_head(classes: Sequence[str], features: Sequence[str], intercepts: Sequence[float], coefficients: Sequence[Sequence[float]], declared: Sequence[str]) -> dict:
    """classes in declared order, others after them, and weights by class; of two classes only the second, in sorted order, has any."""
    learnt = sorted(classes)
    weighted = learnt[1:] if len(learnt) == 2 else learnt
    weights = {k: {"intercept": float(b), **dict(zip(features, map(float, w), strict=True))} for k, b, w in zip(weighted, intercepts, coefficients, strict=True)}
    return {"model": "multinomial_logistic", "classes": [*(k for k in declared if k in learnt), *(k for k in learnt if k not in declared)], "weights": weights}


def boundary(intercept: Column, weight: Column) -> Column:
    """The value of a head's only feature at which its two classes are as likely; null without a weight."""
    return -intercept / F.nullif(weight, F.lit(0.0))
