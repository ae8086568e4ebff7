"""Registered queries: what a head says about items, and which item to label next."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import selecting
from ..registry import query
from . import worlds as W
from .measure import rounded

#: A head of three classes over four features.
HEAD = {
    "keep": {"x1": 1.5, "x2": -0.5, "x3": 0.25, "x4": 0.75, "intercept": 0.1},
    "fix": {"x1": -0.5, "x2": 1.25, "x3": 0.5, "x4": -0.25, "intercept": 0.0},
    "drop": {"x1": -1.0, "x2": 0.25, "x3": -0.75, "x4": 0.5, "intercept": -0.1},
}
NAMES = selecting.features_of(HEAD)


def vectors(spark, d):
    """Items with four features, each missing from one in ten."""
    x = {f: F.when(S.uniform(f"m{f}", "vec_id") >= 0.1, F.floor(S.uniform(f, "vec_id") * 64) / F.lit(16.0) - 2) for f in NAMES}
    return W.table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), *[c.alias(f) for f, c in x.items()], F.col("label"))


VECTORS = "vectors AS (SELECT vec_id AS item_id, " + ", ".join(f"CASE WHEN {W.u('m' + f, 'vec_id')} >= 0.1 THEN floor({W.u(f, 'vec_id')} * 64) / 16.0::DOUBLE - 2 END AS {f}" for f in NAMES) + ", label FROM embeddings)"
_logit = {c: " + ".join([f"{w['intercept']}::DOUBLE", *(f"{w[f]}::DOUBLE * coalesce({f}, 0)" for f in NAMES)]) for c, w in HEAD.items()}
_each = lambda of, f: f"CASE {of} " + " ".join(f"WHEN '{c}' THEN {w[f]}::DOUBLE" for c, w in HEAD.items()) + " END"
DECIDED = f"""{VECTORS}, logits AS (SELECT *, [{', '.join(_logit.values())}] AS z FROM vectors), powers AS (SELECT *, list_transform(z, lambda v: exp(v - list_max(z))) AS e FROM logits),
    masses AS (SELECT item_id, unnest(['{"', '".join(HEAD)}']) AS class, unnest([1, 2, 3]) AS place, unnest(e) / list_sum(e) AS p FROM powers),
    ranks AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY p DESC, place) AS r FROM masses),
    decided AS (SELECT v.*, a.class AS top, b.class AS runner_up, a.p AS confidence, (a.p - b.p) / 2 AS margin FROM vectors v JOIN ranks a ON v.item_id = a.item_id AND a.r = 1 JOIN ranks b ON v.item_id = b.item_id AND b.r = 2),
    pushes AS ({' UNION ALL '.join(f"SELECT item_id, {i} AS place, '{f}' AS feature, (({_each('top', f)}) - ({_each('runner_up', f)})) * {f} AS value FROM decided WHERE {f} IS NOT NULL" for i, f in enumerate(NAMES))})"""


@query("w02_top_contributions", f"WITH {DECIDED} SELECT item_id, place, feature, round(value, 6) AS value, CAST(row_number() OVER (PARTITION BY item_id ORDER BY abs(value) DESC, place) AS INTEGER) AS rank FROM pushes QUALIFY rank <= 3")
def w02(spark, d):
    """The three largest contributions of each item."""
    best = selecting.decided(vectors(spark, d), HEAD).select("item_id", F.posexplode(selecting.largest(F.col("contributions"))).alias("at", "c"))
    place = F.coalesce(*[F.when(F.col("c.feature") == f, F.lit(i)) for i, f in enumerate(NAMES)])
    return rounded(best.select("item_id", place.alias("place"), F.col("c.feature").alias("feature"), F.col("c.value").alias("value"), (F.col("at") + 1).alias("rank")))


@query("t13_explanations", f"""WITH {DECIDED}, top3 AS (SELECT * FROM pushes QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY abs(value) DESC, place) <= 3),
    said AS (SELECT item_id, string_agg(printf('%s (%+.2f)', feature, value), ', ' ORDER BY abs(value) DESC, place) AS drivers FROM top3 GROUP BY item_id)
    SELECT item_id, printf('%s at %.0f%%. Largest drivers: %s.', top, confidence * 100, coalesce(drivers, 'none')) AS explanation FROM decided LEFT JOIN said USING (item_id)""")  # fmt: skip
def t13(spark, d):
    rows = selecting.decided(vectors(spark, d), HEAD)
    return rows.select("item_id", selecting.explanation(F.col("top"), F.col("confidence"), selecting.largest(F.col("contributions"))).alias("explanation"))


@query("c07_predictions", f"WITH {DECIDED} SELECT item_id, top, runner_up, round(confidence, 6) AS confidence, margin < 0.05 AS abstain, round(({' + '.join(f'CAST({f} IS NOT NULL AS INTEGER)' for f in NAMES)}) / 4.0::DOUBLE, 6) AS coverage FROM decided")
def c07(spark, d):
    """A compiled head over all items."""
    return rounded(selecting.decided(vectors(spark, d), HEAD).select("item_id", "top", "runner_up", "confidence", (F.col("margin") < 0.05).alias("abstain"), "coverage"))


BINARY = lambda p: f"-(greatest(least({p}, 1 - 1e-9), 1e-9) * log2(greatest(least({p}, 1 - 1e-9), 1e-9)) + (1 - greatest(least({p}, 1 - 1e-9), 1e-9)) * log2(1 - greatest(least({p}, 1 - 1e-9), 1e-9)))"
ENTROPY = f"""entropies AS (SELECT item_id, CASE WHEN n IS NULL THEN h ELSE (h + {BINARY('n')}) / 2 END AS ambiguity FROM (SELECT *, -(m1 / t * ln(m1 / t) + m2 / t * ln(m2 / t) + m3 / t * ln(m3 / t)) / ln(3.0::DOUBLE) AS h
    FROM (SELECT *, m1 + m2 + m3 AS t FROM (SELECT vec_id AS item_id, CASE WHEN {W.u('an', 'vec_id')} >= 0.2 THEN {W.u('ap', 'vec_id')} END AS n, {W.u('a1', 'vec_id')} + 0.01::DOUBLE AS m1, {W.u('a2', 'vec_id')} + 0.01::DOUBLE AS m2, {W.u('a3', 'vec_id')} + 0.01::DOUBLE AS m3 FROM embeddings))))"""


def ambiguity():
    noul = F.when(S.uniform("an", "item_id") >= 0.2, S.uniform("ap", "item_id"))
    return selecting.answer_entropy([noul], [F.array(*[S.uniform(f"a{i}", "item_id") + 0.01 for i in (1, 2, 3)])])


@query("a15_answer_entropy", f"WITH {ENTROPY} SELECT item_id, round(ambiguity, 6) AS ambiguity FROM entropies")
def a15(spark, d):
    return rounded(W.table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id")).select("item_id", ambiguity().alias("ambiguity")))


CANDIDATES = f"""{DECIDED}, {ENTROPY}, sides AS (SELECT item_id, sum(greatest(value, 0)) AS f, sum(greatest(-value, 0)) AS a FROM pushes GROUP BY item_id),
    signals AS (SELECT item_id, {BINARY('confidence')} AS uncertainty, CAST((['keep', 'fix', 'drop'])[floor({W.u('jv', 'item_id')} * 3)::INTEGER + 1] <> top AS DOUBLE) AS disagreement, coalesce(CASE WHEN f + a > 0 THEN least(f, a) / (f + a) ELSE 0 END, 0) AS conflict, ambiguity
        FROM decided JOIN entropies USING (item_id) LEFT JOIN sides USING (item_id) WHERE item_id % 5 >= 2),
    candidates AS (SELECT *, uncertainty + disagreement + conflict + 0.5::DOUBLE * 0.5::DOUBLE AS score FROM signals)"""


def candidates(spark, d):
    """The pool with its signals, before anything is labelled: every item is as novel, 0.5 (j11 has the distances)."""
    rows = selecting.decided(vectors(spark, d).where("item_id % 5 >= 2"), HEAD)
    holistic = F.element_at(F.array(*map(F.lit, HEAD)), (F.floor(S.uniform("jv", "item_id") * 3) + 1).cast("int"))
    signals = rows.select("item_id", S.binary_entropy(F.col("confidence")).alias("uncertainty"), (holistic != F.col("top")).cast("double").alias("disagreement"), selecting.conflict(F.col("contributions")).alias("conflict"), ambiguity().alias("ambiguity"), F.lit(0.5).alias("novelty"))
    return signals.withColumn("score", selecting.candidate_score()).drop("novelty")


@query("c01_signals", f"WITH {CANDIDATES} SELECT item_id, round(uncertainty, 6) AS uncertainty, disagreement, round(conflict, 6) AS conflict, round(ambiguity, 6) AS ambiguity, round(score, 6) AS score FROM candidates")
def c01s(spark, d):
    """C1, A15, A16, M7, M12."""
    return rounded(candidates(spark, d))


@query("c03_next_question", f"""WITH {CANDIDATES}, w AS (SELECT item_id, score, exp((score - max(score) OVER ()) / 0.6::DOUBLE) AS e FROM candidates), n AS (SELECT item_id, 0.85::DOUBLE * e / sum(e) OVER () + 0.15::DOUBLE / count(*) OVER () AS p, count(*) OVER () AS pool FROM w),
    l AS (SELECT *, sum(p) OVER (ORDER BY item_id) AS reached FROM n) SELECT item_id, round(p, 6) AS propensity, pool AS pool_size FROM l WHERE reached >= 0.5 ORDER BY item_id LIMIT 1""")  # fmt: skip
def c03(spark, d):
    """One draw (u = 0.5) from the pool, with its propensity. Two passes: sums by range of ids, then the range that u falls in."""
    rows = candidates(spark, d).select("item_id", "score")
    top = rows.agg(F.max("score").alias("top"))
    powers = rows.crossJoin(F.broadcast(top)).withColumn("e", F.exp((F.col("score") - F.col("top")) / 0.6)).drop("top")
    total = powers.agg(F.sum("e").alias("sum"), F.count("*").alias("pool"))
    drawn = powers.crossJoin(F.broadcast(total)).select("item_id", (F.lit(0.85) * F.col("e") / F.col("sum") + F.lit(0.15) / F.col("pool")).alias("p"), F.col("pool").alias("pool_size"))
    from pyspark.sql.window import Window

    ranges = drawn.groupBy(F.floor(F.col("item_id") / 1000).alias("range")).agg(F.sum("p").alias("mass"))
    before = ranges.withColumn("before", F.sum("mass").over(Window.orderBy("range")) - F.col("mass"))  # a row per thousand ids
    hit = before.where(F.col("before") + F.col("mass") >= 0.5).orderBy("range").limit(1)
    inside = drawn.withColumn("range", F.floor(F.col("item_id") / 1000)).join(F.broadcast(hit), "range").withColumn("reached", F.col("before") + F.sum("p").over(Window.partitionBy("range").orderBy("item_id")))
    return rounded(inside.where("reached >= 0.5").orderBy("item_id").limit(1).select("item_id", F.col("p").alias("propensity"), "pool_size"))


STATES = f"""states AS (SELECT key, n_effective, (n * 7) % 11 AS labels_since_fit, (n * 3) % 31 AS labels_since_rethink, n % 9 AS mismatches_since_rethink, [l1, l2, l3, l4][1:(n % 5)] AS losses, CASE WHEN n % 3 > 0 THEN 0.5::DOUBLE + ((n * 13) % 50) / 100.0::DOUBLE END AS oof_accuracy
    FROM (SELECT c_custkey AS key, CAST(c_custkey AS BIGINT) AS n, CAST((c_custkey * 17) % 90 AS DOUBLE) AS n_effective, 0.7::DOUBLE - {W.u('l1', 'c_custkey')} / 10 AS l1, 0.65::DOUBLE AS l2, 0.62::DOUBLE AS l3, 0.7::DOUBLE - {W.u('l4', 'c_custkey')} / 10 AS l4 FROM customer))"""


def states(spark, d):
    n = F.col("c_custkey").cast("long")
    losses = F.slice(F.array(F.lit(0.7) - S.uniform("l1", "c_custkey") / 10, F.lit(0.65), F.lit(0.62), F.lit(0.7) - S.uniform("l4", "c_custkey") / 10), F.lit(1), (n % 5).cast("int"))
    return W.table(spark, d, "customer").select(
        F.col("c_custkey").alias("key"), ((n * 17) % 90).cast("double").alias("n_effective"), ((n * 7) % 11).alias("labels_since_fit"), ((n * 3) % 31).alias("labels_since_rethink"), (n % 9).alias("mismatches_since_rethink"),
        losses.alias("losses"), F.when(n % 3 > 0, F.lit(0.5) + ((n * 13) % 50) / F.lit(100.0)).alias("oof_accuracy"),
    )


CONDITIONS = f"""{STATES}, gains AS (SELECT *, len(losses) AS fits, losses[-4] - losses[-1] AS gain, 1 - oof_accuracy AS error FROM states), conditions AS (
    SELECT key, 'refit' AS trigger, 0 AS place, 'enough evidence to fit' AS condition, n_effective >= 30 AS met, printf('%.0f effective labels', n_effective) AS have, '30' AS need FROM gains
    UNION ALL SELECT key, 'refit', 1, 'new labels since the last fit', labels_since_fit >= 5, CAST(labels_since_fit AS VARCHAR), '5' FROM gains
    UNION ALL SELECT key, 'rethink', 0, 'a candidate can be evaluated', n_effective >= 30, printf('%.0f effective labels', n_effective), '30' FROM gains
    UNION ALL SELECT key, 'rethink', 1, 'cooldown since the last rethink', labels_since_rethink >= 15, labels_since_rethink || ' new labels', '15' FROM gains
    UNION ALL SELECT key, 'rethink', 2, 'mismatches the human explained', mismatches_since_rethink >= 5, CAST(mismatches_since_rethink AS VARCHAR), '5' FROM gains
    UNION ALL SELECT key, 'rethink', 3, 'progress has plateaued', fits > 3 AND gain < 0.01, CASE WHEN fits > 3 THEN printf('%+.4f loss gain over the last 3 refits', gain) ELSE fits || ' refit(s); too few to tell a plateau from early progress' END, 'under 0.01 per 3 refits' FROM gains
    UNION ALL SELECT key, 'rethink', 4, 'room left to improve', coalesce(error >= 0.03, false), CASE WHEN error IS NULL THEN 'unknown' ELSE printf('%.3f error', error) END, 'at least 0.03' FROM gains)"""


@query("c06_conditions", f"WITH {CONDITIONS} SELECT * FROM conditions")
def c06(spark, d):
    """The conditions of both triggers, over one state per customer."""
    return selecting.triggers(states(spark, d))


@query("x05_triggers", f"""WITH {CONDITIONS}, u AS (SELECT key, trigger, bool_and(met) AS fire, arg_min(condition, place) FILTER (NOT met) AS c, arg_min(have, place) FILTER (NOT met) AS h, arg_min(need, place) FILTER (NOT met) AS n FROM conditions GROUP BY 1, 2)
    SELECT key, trigger, fire, CASE WHEN fire THEN trigger || ': worth doing now' ELSE trigger || ': not yet (' || c || ': have ' || h || ', need ' || n || ')' END AS summary FROM u""")  # fmt: skip
def x05(spark, d):
    return selecting.fired(selecting.triggers(states(spark, d), first=True))


@query("a17_element_weights", f"WITH {VECTORS} " + " UNION ALL ".join(f"SELECT '{f}' AS element, round(stddev_pop(coalesce({f}, 0)), 6) AS deviation, round({max(abs(w[f]) for w in HEAD.values())}::DOUBLE * stddev_pop(coalesce({f}, 0)), 6) AS standardized_weight FROM vectors" for f in NAMES))
def a17(spark, d):
    """Each element's population deviation, and its largest weight times that."""
    one = vectors(spark, d).agg(*[F.stddev_pop(F.coalesce(F.col(f), F.lit(0.0))).alias(f) for f in NAMES])
    rows = [F.struct(F.lit(f).alias("element"), F.col(f).alias("deviation"), (F.lit(max(abs(w[f]) for w in HEAD.values())) * F.col(f)).alias("standardized_weight")) for f in NAMES]
    return rounded(one.select(F.explode(F.array(*rows)).alias("r")).select("r.*"))


def _loss_sql(moved: str = "") -> str:
    """Log loss of the true class of rows o (features) and g (those of the row that is drawn), with the element's from g."""
    z = [f"({w['intercept']}::DOUBLE + " + " + ".join(f"{w[f]}::DOUBLE * coalesce({'g' if f == moved else 'o'}.{f}, 0)" for f in NAMES) + ")" for w in HEAD.values()]
    true = f"CASE o.label % 3 WHEN 0 THEN {z[0]} WHEN 1 THEN {z[1]} ELSE {z[2]} END"
    return f"avg(-ln(greatest(exp({true}) / ({' + '.join(f'exp({x})' for x in z)}), 1e-9)))"


@query("a18_permutation_importance", f"""WITH {VECTORS}, o AS (SELECT *, row_number() OVER (ORDER BY md5('base#' || item_id), item_id) AS i FROM vectors),
    g AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY md5(r || '#' || item_id), item_id) AS i FROM vectors, (SELECT unnest(range(1, 9)) AS r)), base AS (SELECT {_loss_sql()} AS base FROM o),
    each AS (SELECT r, {', '.join(f'{_loss_sql(f)} AS l{f}' for f in NAMES)} FROM o JOIN g USING (i) GROUP BY r)
    """ + " UNION ALL ".join(f"SELECT '{f}' AS element, round(avg(l{f} - base), 6) AS importance FROM each, base" for f in NAMES))  # fmt: skip
def a18(spark, d):
    """The rise of the log loss when an element's values change places between all rows."""
    rows = vectors(spark, d).withColumns({"y": F.element_at(F.array(*map(F.lit, HEAD)), (F.col("label") % 3 + 1).cast("int")), "w": F.lit(1.0)})
    return rounded(selecting.element_importance(rows, "item_id", "y", "w", {f: [f] for f in NAMES}, HEAD))


@query("m03_scaling", f"WITH {W.VERDICTS} SELECT item_id, " + ", ".join(f"round(1 / (1 + exp(-(ln(q / (1 - q)) / {t}::DOUBLE))), 6) AS t{int(t * 10)}" for t in (0.5, 2.0)) + ", round(1 / (1 + exp(-least(greatest(80 * (p - 0.5::DOUBLE), -35), 35))), 6) AS clipped FROM (SELECT *, greatest(least(p, 1 - 1e-6), 1e-6) AS q FROM verdicts)")
def m03(spark, d):
    """M3, M4: the clipped sigmoid and temperature scaling."""
    p = F.col("p")
    return rounded(W.verdicts(spark, d).select("item_id", S.temper(p, 0.5).alias("t5"), S.temper(p, 2.0).alias("t20"), S.sigmoid(80 * (p - 0.5)).alias("clipped")))


@query("m11_row_softmax", f"WITH {DECIDED} SELECT item_id, round(exp(z[1] / 2 - m) / s, 6) AS p1, round(exp(z[2] / 2 - m) / s, 6) AS p2, round(exp(z[3] / 2 - m) / s, 6) AS p3 FROM (SELECT *, list_max(z) / 2 AS m, list_sum(list_transform(z, lambda v: exp(v / 2 - list_max(z) / 2))) AS s FROM logits)")
def m11(spark, d):
    """Softmax at temperature 2 over an array of logits."""
    z = [sum((F.lit(w[f]) * F.coalesce(F.col(f), F.lit(0.0)) for f in NAMES), F.lit(w["intercept"])) for w in HEAD.values()]
    p = S.softmax_array(F.col("z"), 2.0)
    return rounded(vectors(spark, d).select("item_id", F.array(*z).alias("z")).select("item_id", p.alias("p")).select("item_id", *[F.col("p")[i].alias(f"p{i + 1}") for i in range(3)]))
