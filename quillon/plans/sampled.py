"""Registered queries: propensities, weights, selection signals, novelty, choosing."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..operators import sampling
from ..registry import query
from . import worlds as W
from .measure import rounded

IPW = """r AS (SELECT *, 1 / propensity AS raw, count(*) OVER (PARTITION BY label_source) AS n, row_number() OVER (PARTITION BY label_source ORDER BY 1 / propensity, event_id) AS k FROM feedback),
    c AS (SELECT *, least(raw, 20 * max(CASE WHEN k = n // 2 + 1 THEN raw END) OVER (PARTITION BY label_source)) AS capped FROM r), w AS (SELECT *, capped * n / sum(capped) OVER (PARTITION BY label_source) AS weight FROM c)"""


@query("a09_ipw", f"WITH {W.FEEDBACK}, {IPW} SELECT label_source, event_id, round(weight, 6) AS weight FROM w")
def a09(spark, d):
    rows = W.feedback(spark, d).select("label_source", "event_id", "propensity")
    return rounded(sampling.inverse_propensity(rows, ["label_source"]).select("label_source", "event_id", "weight"))


@query("a10_ipw_effective", f"WITH {W.FEEDBACK}, {IPW} SELECT label_source, round(sum(weight) * sum(weight) / sum(weight * weight), 4) AS n_effective FROM w GROUP BY label_source")
def a10(spark, d):
    rows = sampling.inverse_propensity(W.feedback(spark, d).select("label_source", "event_id", "propensity"), ["label_source"])
    return rows.groupBy("label_source").agg(F.round(F.sum("weight") * F.sum("weight") / F.sum(F.col("weight") * F.col("weight")), 4).alias("n_effective"))


def scores(spark, d):
    return W.table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), S.uniform("sc", "vec_id").alias("score"))


DISTRIBUTION = f"""s AS (SELECT vec_id AS item_id, {W.u('sc', 'vec_id')} AS score FROM embeddings), e AS (SELECT *, exp((score - (SELECT max(score) FROM s)) / 0.6) AS e FROM s),
    q AS (SELECT item_id, score, 0.85 * e / (SELECT sum(e) FROM e) + 0.15 / (SELECT count(*) FROM s) AS probability FROM e)"""


@query("m09_selection", f"WITH {DISTRIBUTION} SELECT item_id, round(probability, 9) AS probability FROM q")
def m09(spark, d):
    return sampling.selection_distribution(scores(spark, d)).select("item_id", F.round("probability", 9).alias("probability"))


@query("c02_choose", f"WITH {DISTRIBUTION}, c AS (SELECT *, sum(probability) OVER (ORDER BY item_id) AS upto FROM q) SELECT item_id, round(probability, 9) AS propensity FROM c WHERE upto >= 0.61803 ORDER BY item_id LIMIT 1")
def c02(spark, d):
    return sampling.choose(sampling.selection_distribution(scores(spark, d)), 0.61803, "item_id").select("item_id", F.round("probability", 9).alias("propensity"))


@query("j11_novelty", """WITH v AS (SELECT vec_id AS item_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings), s AS (SELECT coalesce(nullif(stddev_pop(a), 0), 1) AS sa, coalesce(nullif(stddev_pop(b), 0), 1) AS sb FROM v WHERE item_id % 10 <> 0),
    d AS (SELECT p.item_id, min(sqrt(((p.a - k.a) / sa) * ((p.a - k.a) / sa) + ((p.b - k.b) / sb) * ((p.b - k.b) / sb))) AS d FROM v p, v k, s WHERE p.item_id % 10 <> 0 AND k.item_id % 10 = 0 GROUP BY 1)
    SELECT item_id, round(d / (d + (SELECT quantile_cont(d, 0.5) FROM d)), 6) AS novelty FROM d""")  # fmt: skip
def j11(spark, d):
    """J11, M10."""
    e = lambda i: F.element_at("embedding", i).cast("double")
    v = W.table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), e(1).alias("a"), e(2).alias("b"))
    out = sampling.novelty(v.where("item_id % 10 <> 0"), v.where("item_id % 10 = 0"), ["a", "b"])
    return rounded(out.select("item_id", "novelty"))


@query("c01_candidates", f"""WITH {W.VERDICTS}, c AS (SELECT item_id, greatest(p, 1 - p) AS conf, CAST(predicted <> truth AS DOUBLE) AS disagreement, least(p, twin_p) / (p + twin_p) AS conflict FROM verdicts WHERE item_id % 10 <> 0),
    e AS (SELECT *, least(greatest(conf, 1e-9), 1 - 1e-9) AS q FROM c)
    SELECT item_id, round(-(q * log2(q) + (1 - q) * log2(1 - q)), 6) AS uncertainty, disagreement, round(conflict, 6) AS conflict, round(-(q * log2(q) + (1 - q) * log2(1 - q)) + disagreement + conflict, 6) AS score FROM e""")  # fmt: skip
def c01(spark, d):
    """Signals of unlabelled items and their weighted sum."""
    v = W.verdicts(spark, d)
    pool = v.join(v.where("item_id % 10 = 0").select("item_id"), "item_id", "left_anti")
    signals = pool.select("item_id", S.binary_entropy(F.greatest("p", 1 - F.col("p"))).alias("uncertainty"), (F.col("predicted") != F.col("truth")).cast("double").alias("disagreement"), (F.least("p", "twin_p") / (F.col("p") + F.col("twin_p"))).alias("conflict"))
    return rounded(signals.withColumn("score", F.col("uncertainty") + F.col("disagreement") + F.col("conflict")))


@query("w09_newest", f"WITH {W.FEEDBACK} SELECT label_source, event_id FROM feedback QUALIFY row_number() OVER (PARTITION BY label_source ORDER BY ts DESC, event_id DESC) <= 5")
def w09(spark, d):
    w = Window.partitionBy("label_source").orderBy(F.desc("ts"), F.desc("event_id"))
    return W.feedback(spark, d).select("label_source", "event_id", "ts").withColumn("r", F.row_number().over(w)).where("r <= 5").select("label_source", "event_id")


@query("w10_mismatches", f"WITH {W.FEEDBACK} SELECT event_id FROM feedback WHERE initial <> rtrim(lower(final), '.') ORDER BY comment = '', propensity DESC, event_id LIMIT 25")
def w10(spark, d):
    rows = W.feedback(spark, d).where(S.normalize_label(F.col("initial")) != S.normalize_label(F.col("final")))
    return rows.orderBy(F.col("comment") == "", F.desc("propensity"), "event_id").limit(25).select("event_id")


@query("w11_folds", f"WITH {W.SCORED} SELECT item_id, ((row_number() OVER (PARTITION BY ref ORDER BY md5('fold#' || item_id), item_id) - 1) % 5)::INTEGER AS fold FROM scored")
def w11(spark, d):
    from ..operators.fitting import stratified_folds

    return stratified_folds(W.scored(spark, d).select("item_id", "ref"), "ref", "item_id").select("item_id", "fold")


@query("w12_sample", "SELECT doc_id FROM documents ORDER BY md5('seed#' || doc_id), doc_id LIMIT 50")
def w12(spark, d):
    return W.table(spark, d, "documents").select("doc_id").orderBy(F.md5(F.concat(F.lit("seed#"), F.col("doc_id").cast("string"))), "doc_id").limit(50)
