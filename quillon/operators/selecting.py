"""What a linear head shows about an item: class ranking, contributions, signals for choosing the next item to label."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import binary_entropy, normalized_entropy, softmax

Head = Mapping[str, Mapping[str, float]]  # class -> feature -> weight; "intercept" too
#: Weights of the signals in the score of a candidate; ambiguity counts against it (fixed values).
SIGNALS = {"uncertainty": 1.0, "disagreement": 1.0, "conflict": 1.0, "novelty": 0.5, "ambiguity": 0.0}


def features_of(head: Head) -> list[str]:
    """The declared features, in the order in which the classes name them."""
    return list(dict.fromkeys(f for weights in head.values() for f in weights if f != "intercept"))


def decided(rows: DataFrame, head: Head) -> DataFrame:
    """Adds top, runner_up, confidence, margin, coverage and contributions (array of feature, value; features that are there, in
    their declared order). A missing feature counts 0; equal probabilities keep the classes' order."""
    names = features_of(head)
    logit = {c: sum((F.lit(float(w.get(f, 0.0))) * F.coalesce(F.col(f), F.lit(0.0)) for f in names), F.lit(float(w.get("intercept", 0.0)))) for c, w in head.items()}
    p = softmax(list(logit.values()))
    ranked = F.array_sort(F.array(*[F.struct((-x).alias("loss"), F.lit(i).alias("at"), F.lit(c).alias("class")) for i, (c, x) in enumerate(zip(head, p, strict=True))]))
    with_rank = rows.withColumn("_r", ranked).withColumns({"top": F.col("_r")[0]["class"], "runner_up": F.col("_r")[1]["class"], "confidence": -F.col("_r")[0]["loss"], "margin": (F.col("_r")[1]["loss"] - F.col("_r")[0]["loss"]) / 2})
    weight = lambda of, f: F.coalesce(*[F.when(F.col(of) == c, F.lit(float(w.get(f, 0.0)))) for c, w in head.items()])
    pushes = F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), F.struct(F.lit(f).alias("feature"), ((weight("top", f) - weight("runner_up", f)) * F.col(f)).alias("value"))) for f in names]))
    there = sum((F.col(f).isNotNull().cast("int") for f in names), F.lit(0))
    return with_rank.withColumns({"contributions": pushes, "coverage": there / F.lit(float(len(names))) if names else F.lit(1.0)}).drop("_r")


def largest(contributions: Column, n: int = 3) -> Column:
    """The n largest by absolute value; equal ones keep their order."""
    keyed = F.transform(contributions, lambda x, i: F.struct((-F.abs(x["value"])).alias("k"), i.alias("i"), x.alias("x")))
    return F.transform(F.slice(F.array_sort(keyed), 1, n), lambda x: x["x"])


def explanation(value: Column, confidence: Column, drivers: Column) -> Column:
    # the sign apart, since rounding loses that of a negative zero
    sign = lambda v: F.when(v.cast("string").startswith("-"), "-").otherwise("+")
    said = F.array_join(F.transform(drivers, lambda x: F.format_string("%s (%s%.2f)", x["feature"], sign(x["value"]), F.abs(F.bround(x["value"], 2)))), ", ")
    return F.format_string("%s at %.0f%%. Largest drivers: %s.", value, F.bround(confidence * 100, 0), F.when(said == "", "none").otherwise(said))


def conflict(contributions: Column) -> Column:
    """The smaller of the evidence for and against, as a share of both; 0 without evidence."""
    total = lambda sign: F.aggregate(contributions, F.lit(0.0), lambda a, x: a + F.greatest(x["value"] * sign, F.lit(0.0)))
    for_, against = total(1.0), total(-1.0)
    return F.when(for_ + against > 0, F.least(for_, against) / (for_ + against)).otherwise(0.0)


def answer_entropy(nouls: Sequence[Column], choices: Sequence[Column]) -> Column:
    """Mean normalized entropy over an item's answers: yes/no probabilities and arrays of option masses; 0 without answers."""
    parts = [F.when(p.isNotNull(), binary_entropy(p)) for p in nouls] + [F.when(m.isNotNull(), normalized_entropy(m)) for m in choices]
    known = F.array_compact(F.array(*parts))
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)).otherwise(0.0)


def candidate_score(weights: Mapping[str, float] = SIGNALS) -> Column:
    return sum((F.lit(-w if name == "ambiguity" else w) * F.col(name) for name, w in weights.items()), F.lit(0.0))


def triggers(state: DataFrame, fit_floor: float = 30.0, refit_every: int = 5, rethink_labels: int = 15, rethink_mismatches: int = 5, window: int = 3, least_gain: float = 0.01, headroom: float = 0.03, first: bool = False) -> DataFrame:
    """A row per condition of each trigger: state's key, trigger, condition, met, have, need; with `first`, the first that is not met
    alone, or the last if all are. state: key, n_effective,
    labels_since_fit, labels_since_rethink, mismatches_since_rethink, losses (array), oof_accuracy (may be null)."""
    n, losses = F.col("n_effective"), F.col("losses")
    enough = lambda name: (name, n >= fit_floor, F.format_string("%.0f effective labels", n), F.lit(f"{fit_floor:.0f}"))
    at_least = lambda name, c, need, form="%d": (name, F.col(c) >= need, F.format_string(form, F.col(c)), F.lit(str(need)))
    told = F.size(losses) > window
    gain = F.try_element_at(losses, F.lit(-1 - window)) - F.try_element_at(losses, F.lit(-1))
    error = 1 - F.col("oof_accuracy")
    conditions = {
        "refit": [enough("enough evidence to fit"), at_least("new labels since the last fit", "labels_since_fit", refit_every)],
        "rethink": [
            enough("a candidate can be evaluated"),
            at_least("cooldown since the last rethink", "labels_since_rethink", rethink_labels, "%d new labels"),
            at_least("mismatches the human explained", "mismatches_since_rethink", rethink_mismatches),
            ("progress has plateaued", F.coalesce(told & (gain < least_gain), F.lit(False)), F.when(told, F.format_string(f"%+.4f loss gain over the last {window} refits", gain)).otherwise(F.format_string("%d refit(s); too few to tell a plateau from early progress", F.size(losses))), F.lit(f"under {least_gain} per {window} refits")),
            ("room left to improve", F.coalesce(error >= headroom, F.lit(False)), F.when(error.isNull(), "unknown").otherwise(F.format_string("%.3f error", error)), F.lit(f"at least {headroom}")),
        ],
    }
    one = lambda t, i, c, met, have, need: F.struct(F.lit(t).alias("trigger"), F.lit(i).alias("place"), F.lit(c).alias("condition"), met.alias("met"), have.alias("have"), need.alias("need"))
    by = [[one(t, i, *c) for i, c in enumerate(cs)] for t, cs in conditions.items()]
    rows = [F.coalesce(F.get(F.filter(F.array(*cs), lambda c: ~c["met"]), F.lit(0)), cs[-1]) for cs in by] if first else [c for cs in by for c in cs]
    return state.select("key", F.explode(F.array(*rows)).alias("c")).select("key", "c.*")


def fired(conditions: DataFrame) -> DataFrame:
    """key, trigger, fire, summary: whether all conditions are met, or the first that is not. Rows are dealt out first: texts have no
    place in a hash aggregate, which would sort whatever one task reads."""
    unmet = F.min(F.when(~F.col("met"), F.struct("place", "condition", "have", "need"))).alias("u")
    return conditions.repartition("key", "trigger").groupBy("key", "trigger").agg(unmet).select(
        "key", "trigger", F.col("u").isNull().alias("fire"),
        F.when(F.col("u").isNull(), F.concat("trigger", F.lit(": worth doing now"))).otherwise(F.format_string("%s: not yet (%s: have %s, need %s)", "trigger", "u.condition", "u.have", "u.need")).alias("summary"),
    )


def shuffled_place(rows: DataFrame, key: str, salt: Column, by: Sequence[str] = (), out: str = "place") -> DataFrame:
    """Numbers rows from 1 in the order of md5(salt#key), in each group of `by`: rows are dealt out by the hash's first digits, counts of
    these 4,096 parts are summed up, and each part is ordered by itself, so that no task sees a group whole."""
    hashed = rows.withColumn("_h", F.md5(F.concat_ws("#", salt, F.col(key).cast("string")))).withColumn("_part", F.substring("_h", 1, 3))
    parts = hashed.groupBy(*by, "_part").count()
    before = parts.withColumn("_before", F.sum("count").over(Window.partitionBy(*by, F.lit(0)).orderBy("_part")) - F.col("count")).drop("count")
    inside = F.row_number().over(Window.partitionBy(*by, "_part").orderBy("_h", key))
    return hashed.withColumn("_inside", inside).join(before, [*by, "_part"]).withColumn(out, F.col("_before") + F.col("_inside")).drop("_h", "_part", "_inside", "_before")


def element_importance(rows: DataFrame, key: str, label: str, weight: str, elements: Mapping[str, Sequence[str]], head: Head, repeats: int = 8) -> DataFrame:
    """element, importance: the mean rise of the weighted log loss of the true class when the features of an element (its values in
    `elements`) change places between all rows, over `repeats` seeded shuffles; keys are unique. One shuffle serves all elements: a row
    meets the row whose values it gets, and each element's loss takes only that element's from there. Without rows, null."""
    moved = list(dict.fromkeys(f for fs in elements.values() for f in fs))

    def loss(given: Sequence[str] = ()) -> Column:
        value = lambda f: F.coalesce(F.col(f"_{f}" if f in given else f), F.lit(0.0))
        logits = [sum((F.lit(float(w.get(f, 0.0))) * value(f) for f in features_of(head)), F.lit(float(w.get("intercept", 0.0)))) for w in head.values()]
        true = F.coalesce(*[F.when(F.col(label) == c, x) for c, x in zip(head, softmax(logits), strict=True)])
        return -F.sum(F.col(weight) * F.ln(F.greatest(true, F.lit(1e-9)))) / F.sum(weight)

    base = rows.agg(loss().alias("base"))
    again = F.explode(F.sequence(F.lit(1), F.lit(repeats)))
    own = shuffled_place(rows.select(key, label, weight, *features_of(head)), key, F.lit("base")).withColumn("repeat", again)
    drawn = shuffled_place(rows.select(key, *moved).withColumn("repeat", again), key, F.col("repeat").cast("string"), ["repeat"])
    given = drawn.select("repeat", "place", *[F.col(f).alias(f"_{f}") for f in moved])
    each = own.join(given, ["repeat", "place"]).groupBy("repeat").agg(*[loss(fs).alias(f"_{i}") for i, fs in enumerate(elements.values())])
    rise = F.explode(F.array(*[F.struct(F.lit(e).alias("element"), (F.col(f"_{i}") - F.col("base")).alias("rise")) for i, e in enumerate(elements)]))
    return each.crossJoin(F.broadcast(base)).select(rise.alias("r")).groupBy(F.col("r.element").alias("element")).agg(F.avg("r.rise").alias("importance"))
