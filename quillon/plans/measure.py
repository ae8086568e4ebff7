"""Registered queries: metrics, selective prediction, counterfactual pairs, shortlists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import uniform
from ..operators import metrics, paired, shortlist
from ..registry import query
from . import worlds as W


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


SUMMARY = """count(*) AS n, round(sum(weight * correct) / sum(weight), 6) AS accuracy, round(sum(weight * (confidence - correct) * (confidence - correct)) / sum(weight), 6) AS brier,
    round(sum(weight * confidence) / sum(weight), 6) AS mean_confidence, round(sum(weight * confidence) / sum(weight) - sum(weight * correct) / sum(weight), 6) AS overconfidence"""


def ece_sql(table: str, by: str = "") -> str:
    key = f"{by}, " if by else ""
    return f"""SELECT {key}sum(abs(mc - mk)) / sum(m) AS ece FROM (SELECT {key}least(floor(confidence * 10), 9) AS bin, sum(weight) AS m, sum(weight * confidence) AS mc, sum(weight * correct) AS mk
        FROM {table} GROUP BY ALL) GROUP BY ALL"""


@query("a01_weighted_accuracy", f"WITH {W.SCORED} SELECT lang, round(sum(weight * correct) / sum(weight), 6) AS accuracy FROM scored GROUP BY lang")
def a01(spark, d):
    return rounded(W.scored(spark, d).groupBy("lang").agg(metrics.accuracy(F.col("weight"), F.col("correct")).alias("accuracy")))


RELIABILITY = """SELECT CAST(least(floor(confidence * 10), 9) AS INTEGER) AS bin, round(sum(weight), 6) AS mass, round(sum(weight * confidence) / sum(weight), 6) AS mean_confidence, round(sum(weight * correct) / sum(weight), 6) AS bin_accuracy FROM"""


@query("a02_reliability", f"WITH {W.SCORED} {RELIABILITY} scored GROUP BY 1")
def a02(spark, d):
    return rounded(metrics.reliability(W.scored(spark, d)))


@query("a03_ece", f"WITH {W.SCORED} SELECT tier, round(ece, 6) AS ece FROM ({ece_sql('scored', 'tier')})")
def a03(spark, d):
    return rounded(metrics.calibration_error(W.scored(spark, d), ["tier"]))


@query("a03_ece_large", f"WITH {W.SCORED_LARGE} SELECT stratum, round(ece, 6) AS ece FROM ({ece_sql('scored_large', 'stratum')})")
def a03_large(spark, d):
    return rounded(metrics.calibration_error(W.scored_large(spark, d), ["stratum"]))


@query("a04_brier", f"WITH {W.SCORED} SELECT split, round(sum(weight * (confidence - correct) * (confidence - correct)) / sum(weight), 6) AS brier FROM scored GROUP BY split")
def a04(spark, d):
    return rounded(W.scored(spark, d).groupBy("split").agg(metrics.brier(F.col("weight"), F.col("confidence"), F.col("correct")).alias("brier")))


@query("a05_log_loss", f"WITH {W.SCORED} SELECT split, round(-sum(weight * ln(greatest(CASE ref WHEN 'positive' THEN p ELSE 1 - p END, 0.000001))) / sum(weight), 6) AS log_loss FROM scored GROUP BY split")
def a05(spark, d):
    true = F.when(F.col("ref") == "positive", F.col("p")).otherwise(1 - F.col("p"))
    return rounded(W.scored(spark, d).groupBy("split").agg(metrics.log_loss(F.col("weight"), true).alias("log_loss")))


@query("a06_confusion", f"""WITH {W.SCORED}, labels AS (SELECT ref AS label FROM scored UNION SELECT predicted FROM scored)
    SELECT a.label AS actual, b.label AS predicted, count(s.item_id) AS n FROM labels a CROSS JOIN labels b LEFT JOIN scored s ON s.ref = a.label AND s.predicted = b.label GROUP BY 1, 2""")  # fmt: skip
def a06(spark, d):
    return metrics.confusion(W.scored(spark, d), "ref", "predicted")


@query("a07_summary", f"WITH {W.SCORED} SELECT s.*, round(ece, 6) AS ece FROM (SELECT lang, {SUMMARY} FROM scored GROUP BY lang) s JOIN ({ece_sql('scored', 'lang')}) e USING (lang)")
def a07(spark, d):
    return rounded(metrics.summary(W.scored(spark, d), ["lang"]))


@query("a07_summary_large", f"WITH {W.SCORED_LARGE} SELECT s.*, round(ece, 6) AS ece FROM (SELECT {SUMMARY} FROM scored_large) s, ({ece_sql('scored_large')}) e")
def a07_large(spark, d):
    return rounded(metrics.summary(W.scored_large(spark, d)))


@query("a08_confusion_cells", f"WITH {W.SCORED} SELECT predicted || '->' || ref AS cell, count(*) AS n FROM scored GROUP BY 1")
def a08(spark, d):
    return W.scored(spark, d).groupBy(F.concat("predicted", F.lit("->"), "ref").alias("cell")).agg(F.count("*").alias("n"))


@query("a10_kish", f"WITH {W.SCORED} SELECT lang, round(sum(weight) * sum(weight) / sum(weight * weight), 6) AS n_effective FROM scored GROUP BY lang")
def a10(spark, d):
    return rounded(W.scored(spark, d).groupBy("lang").agg(metrics.kish(F.col("weight")).alias("n_effective")))


@query("a11_label_prior", f"WITH {W.SCORED} SELECT ref, round(sum(weight) / (SELECT sum(weight) FROM scored), 6) AS prior FROM scored GROUP BY ref")
def a11(spark, d):
    by = W.scored(spark, d).groupBy("ref").agg(F.sum("weight").alias("w"))
    return rounded(by.select("ref", (F.col("w") / F.sum("w").over(Window.partitionBy(F.lit(0)))).alias("prior")))


@query("a12_tier_accuracy", f"WITH {W.ITEMS}, {W.ANSWERS} SELECT tier, count(*) AS n, round(avg(CAST(predicted = ref AS DOUBLE)), 6) AS accuracy, round(avg(CAST({W.u('done', 'item_id')} < 0.8 AS DOUBLE)), 6) AS coverage FROM answered WHERE split = 'test' GROUP BY tier")
def a12(spark, d):
    """Accuracy, and the share of items whose every answer is there (four in five by a draw)."""
    rows = W.answers(W.items(spark, d)).where("split = 'test'")
    return rounded(rows.groupBy("tier").agg(F.count("*").alias("n"), F.avg((F.col("predicted") == F.col("ref")).cast("double")).alias("accuracy"), F.avg((uniform("done", "item_id") < 0.8).cast("double")).alias("coverage")))


HISTOGRAM = "SELECT confidence, count(*) AS n, sum(correct)::BIGINT AS k FROM {} GROUP BY confidence"


def coverage_sql(table: str) -> str:
    return f"""h AS ({HISTOGRAM.format(table)}), c AS (SELECT *, sum(n) OVER w AS cn, sum(k) OVER w AS ck FROM h WINDOW w AS (ORDER BY confidence DESC)),
        s AS (SELECT *, max(CAST(ck / cn::DOUBLE < 0.95 AS INTEGER)) OVER (ORDER BY confidence DESC) AS short FROM c)
        SELECT round(coalesce(max(cn) FILTER (short = 0), 0)::DOUBLE / sum(n), 6) AS coverage, round(arg_max(ck / cn::DOUBLE, cn) FILTER (short = 0), 6) AS accuracy, coalesce(arg_max(n, cn) FILTER (short = 0), 0)::BIGINT AS tie_block FROM s"""


@query("a32_coverage", f"WITH {W.SCORED}, easy AS (SELECT confidence, CASE WHEN confidence > 0.85 THEN 1 ELSE correct END AS correct FROM scored), {coverage_sql('easy')}")
def a32(spark, d):
    easy = W.scored(spark, d).select("confidence", F.when(F.col("confidence") > 0.85, 1).otherwise(F.col("correct")).alias("correct"))
    return rounded(metrics.coverage_at(easy))


@query("a32_coverage_large", f"WITH {W.SCORED_LARGE}, {coverage_sql('scored_large')}")
def a32_large(spark, d):
    return rounded(metrics.coverage_at(W.scored_large(spark, d)))


def auroc_sql(table: str) -> str:
    return f"""h AS ({HISTOGRAM.format(table)}), r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY confidence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0::DOUBLE AS rank FROM h)
        SELECT round((sum(k * rank) - sum(k) * (sum(k) + 1) / 2.0::DOUBLE) / nullif(sum(k) * sum(n - k), 0)::DOUBLE, 4) AS auroc FROM r"""


@query("a33_auroc", f"WITH {W.SCORED}, {auroc_sql('scored')}")
def a33(spark, d):
    return metrics.auroc(W.scored(spark, d))


@query("a33_auroc_large", f"WITH {W.SCORED_LARGE}, {auroc_sql('scored_large')}")
def a33_large(spark, d):
    return metrics.auroc(W.scored_large(spark, d))


@query("a34_selective", f"""WITH {W.SCORED} SELECT part, count(*) AS n, round(avg(correct), 6) AS accuracy FROM (
    SELECT 'all' AS part, correct FROM scored UNION ALL SELECT 'without neutral', correct FROM scored WHERE tier <> 'neutral') GROUP BY part""")  # fmt: skip
def a34(spark, d):
    rows = W.scored(spark, d).select(F.explode(F.when(F.col("tier") != "neutral", F.array(F.lit("all"), F.lit("without neutral"))).otherwise(F.array(F.lit("all")))).alias("part"), "correct")
    return rounded(rows.groupBy("part").agg(F.count("*").alias("n"), F.avg("correct").alias("accuracy")))


# -- pairs -----------------------------------------------------------------------------------------------------------

PAIRED = """count(*) AS n, round(avg(CAST(predicted = truth AS DOUBLE)), 6) AS accuracy, round(avg(CAST(predicted <> twin_predicted AS DOUBLE)), 6) AS flip_rate,
    round(avg(abs(twin_p - p)), 6) AS mean_abs_delta, round(avg(twin_p - p), 6) AS mean_shift, count(*) FILTER (predicted <> twin_predicted) AS flips,
    round(avg(CAST(twin_predicted = 'positive' AS DOUBLE)) FILTER (predicted <> twin_predicted), 6) AS toward_positive,
    round(avg(CAST(predicted = 'positive' AS DOUBLE)) FILTER (truth = 'positive' AND gender = 'female') - avg(CAST(predicted = 'positive' AS DOUBLE)) FILTER (truth = 'positive' AND gender = 'male'), 6) AS recall_gap"""


@query("a25_paired", f"WITH {W.VERDICTS} SELECT coalesce(gender, 'all') AS slice, {PAIRED} FROM verdicts GROUP BY ROLLUP (gender)")
def a25(spark, d):
    """A19 to A23 and A25 in one pass."""
    return rounded(paired.paired_summary(W.verdicts(spark, d), "positive", "gender"))


@query("a24_verdict_ece", f"WITH {W.VERDICTS}, s AS (SELECT CASE predicted WHEN 'positive' THEN p ELSE 1 - p END AS confidence, CAST(predicted = truth AS INTEGER) AS correct, 1.0::DOUBLE AS weight FROM verdicts) SELECT round(ece, 6) AS ece FROM ({ece_sql('s')})")
def a24(spark, d):
    return rounded(paired.verdict_error(W.verdicts(spark, d), "positive"))


CALL = "CASE WHEN count(*) FILTER (predicted = 'positive') * 2 > count(*) THEN true WHEN count(*) FILTER (predicted = 'positive') * 2 < count(*) THEN false ELSE avg(p) >= 0.5 END"


@query("a27_majority", f"WITH {W.VERSIONS} SELECT source_id, grp, round(avg(p), 6) AS mean_p, {CALL} AS call FROM versions GROUP BY source_id, grp")
def a27(spark, d):
    return rounded(paired.group_calls(W.versions(spark, d), "positive"))


@query("a28_group_shifts", f"""WITH {W.VERSIONS}, c AS (SELECT source_id, grp, avg(p) AS mp, {CALL} AS call FROM versions GROUP BY 1, 2),
    h AS (SELECT source_id, k > 2 AS late, avg(p) AS mp, {CALL} AS call FROM versions WHERE grp = 'white' GROUP BY 1, 2)
    SELECT m.grp, round(shift, 6) AS shift, round(majority_flip, 6) AS majority_flip, round(pair_flip, 6) AS pair_flip FROM
      (SELECT a.grp, avg(a.mp - w.mp) AS shift, avg(CAST(a.call <> w.call AS DOUBLE)) AS majority_flip FROM c a JOIN c w ON a.source_id = w.source_id AND w.grp = 'white' WHERE a.grp <> 'white' GROUP BY 1) m
      JOIN (SELECT a.grp, avg(CAST(a.predicted <> w.predicted AS DOUBLE)) AS pair_flip FROM versions a JOIN versions w ON a.source_id = w.source_id AND a.k = w.k AND w.grp = 'white' WHERE a.grp <> 'white' GROUP BY 1) x ON m.grp = x.grp
    UNION ALL SELECT 'floor', (SELECT round(avg(b.mp - a.mp), 6) FROM h a JOIN h b ON a.source_id = b.source_id AND b.late AND NOT a.late), (SELECT round(avg(CAST(b.call <> a.call AS DOUBLE)), 6) FROM h a JOIN h b ON a.source_id = b.source_id AND b.late AND NOT a.late),
      (SELECT round(avg(CAST(a.predicted <> b.predicted AS DOUBLE)), 6) FROM versions a JOIN versions b ON a.source_id = b.source_id AND b.k = a.k + 2 WHERE a.grp = 'white' AND b.grp = 'white')""")  # fmt: skip
def a28(spark, d):
    """A26 to A30, X13."""
    return rounded(paired.group_shifts(W.versions(spark, d), "positive"))


@query("a31_bootstrap", f"""WITH {W.VERDICTS}, v AS (SELECT item_id AS i, CAST(predicted <> twin_predicted AS DOUBLE) AS x FROM verdicts), n AS (SELECT count(*) AS n FROM v),
    m AS (SELECT r, avg(x) AS m FROM (SELECT unnest(range(50)) AS r), (SELECT i AS j FROM v), n, v WHERE v.i = floor({W.u('b', 'r', 'j')} * n)::BIGINT GROUP BY r), s AS (SELECT list_sort(list(m)) AS s FROM m)
    SELECT round(s[2], 6) AS low, round(s[49], 6) AS high FROM s""")  # fmt: skip
def a31(spark, d):
    v = W.verdicts(spark, d).select(F.col("item_id").alias("i"), (F.col("predicted") != F.col("twin_predicted")).cast("double").alias("x"))
    return rounded(paired.bootstrap_mean(v, 50))


@query("a31_bootstrap_1000")
def a31_1000(spark, d):
    """A31 with the reference's 1,000 resamples, from the counts; a31_bootstrap has 50 for its SQL."""
    return rounded(paired.bootstrap_share(W.verdicts(spark, d).select((F.col("predicted") != F.col("twin_predicted")).cast("double").alias("x")), 1000))


@query("j09_complete_versions", f"WITH {W.VERSIONS}, v AS (SELECT * FROM versions WHERE NOT (source_id % 7 = 0 AND k = 4)) SELECT source_id, grp, k FROM v WHERE source_id IN (SELECT source_id FROM v GROUP BY 1 HAVING count(*) = 16)")
def j09(spark, d):
    return paired.complete_versions(W.versions(spark, d).where(~((F.col("source_id") % 7 == 0) & (F.col("k") == 4)))).select("source_id", "grp", "k")


@query("a39_twin_average", f"WITH {W.VERDICTS} SELECT item_id, round((p + twin_p) / 2, 6) AS p, CASE WHEN (p + twin_p) / 2 >= 0.5 THEN 'positive' ELSE 'negative' END AS predicted FROM verdicts")
def a39(spark, d):
    p = (F.col("p") + F.col("twin_p")) / 2
    return rounded(W.verdicts(spark, d).select("item_id", p.alias("p"), F.when(p >= 0.5, "positive").otherwise("negative").alias("predicted")))


@query("a40_prior_corrected", f"""WITH {W.VERDICTS}, q AS (SELECT *, least(greatest(p, 1e-9::DOUBLE), 1 - 1e-9::DOUBLE) AS c, (SELECT avg(CAST(truth = 'positive' AS DOUBLE)) FROM verdicts) AS prior FROM verdicts)
    SELECT round(avg(CAST((ln(c / (1 - c)) - ln(prior / (1 - prior)) >= 0) = (truth = 'positive') AS DOUBLE)), 6) AS accuracy FROM q""")  # fmt: skip
def a40(spark, d):
    v = W.verdicts(spark, d)
    prior = v.agg(F.avg((F.col("truth") == "positive").cast("double")).alias("prior"))
    c = F.least(F.greatest("p", F.lit(1e-9)), F.lit(1 - 1e-9))
    up = F.ln(c / (1 - c)) - F.ln(F.col("prior") / (1 - F.col("prior"))) >= 0
    return rounded(v.crossJoin(F.broadcast(prior)).agg(F.avg((up == (F.col("truth") == "positive")).cast("double")).alias("accuracy")))


@query("a50_drift", f"WITH {W.VERDICTS} SELECT count(*) AS n, round(avg(CAST(predicted <> twin_predicted AS DOUBLE)), 6) AS changed, round(avg(abs(p - twin_p)), 6) AS mean_abs_delta FROM verdicts")
def a50(spark, d):
    v = W.verdicts(spark, d)
    return rounded(paired.answer_drift(v, v.select("item_id", F.col("twin_predicted").alias("predicted"), F.col("twin_p").alias("p"))))


@query("j08_pair_guard", f"WITH {W.VERDICTS}, a AS (SELECT * FROM verdicts WHERE item_id % 9 <> 0), b AS (SELECT * FROM verdicts WHERE item_id % 11 <> 0) SELECT count(*) FILTER (a.item_id IS NULL) AS only_after, count(*) FILTER (b.item_id IS NULL) AS only_before, count(*) AS n FROM a FULL JOIN b ON a.item_id = b.item_id")
def j08(spark, d):
    v = W.verdicts(spark, d).select("item_id")
    a, b = v.where("item_id % 9 <> 0"), v.where("item_id % 11 <> 0").withColumnRenamed("item_id", "after")
    return a.join(b, F.col("item_id") == F.col("after"), "full").agg(F.count_if(F.col("item_id").isNull()).alias("only_after"), F.count_if(F.col("after").isNull()).alias("only_before"), F.count("*").alias("n"))


# -- shortlists ------------------------------------------------------------------------------------------------------


@query("w01_shortlist", f"WITH {W.POOL} SELECT item_id, score FROM pool ORDER BY score DESC, item_id LIMIT 100")
def w01(spark, d):
    return shortlist.ranked(W.shortlist_pool(spark, d).select("item_id", "score"), 100)


def fairness_sql(cut: int) -> str:
    return f"""(WITH r AS (SELECT *, row_number() OVER (ORDER BY score DESC, item_id) AS rank FROM pool), t AS (SELECT * FROM r WHERE rank = {cut}), u AS (SELECT * FROM r WHERE rank = {cut} + 1),
        m AS (SELECT r.*, r.rank <= {cut} AS selected, r.score > t.score AS above, r.score = t.score AS tied,
              CASE WHEN r.rank <= {cut} THEN r.twin_score > u.score OR (r.twin_score = u.score AND r.item_id < u.item_id) ELSE r.twin_score > t.score OR (r.twin_score = t.score AND r.item_id < t.item_id) END AS twin_in FROM r, t, u),
        c AS (SELECT m.*, CASE WHEN above THEN 1.0::DOUBLE WHEN tied THEN ({cut} - (SELECT count(*) FROM m WHERE above))::DOUBLE / (SELECT count(*) FROM m WHERE tied) ELSE 0.0::DOUBLE END AS credit FROM m)
        SELECT {cut}::INTEGER AS cut, round(avg(selected::INTEGER::DOUBLE) FILTER (positive AND gender = 'female'), 6) AS female_rate, round(avg(selected::INTEGER::DOUBLE) FILTER (positive AND gender = 'male'), 6) AS male_rate,
               count(*) FILTER (above) AS above, count(*) FILTER (tied) AS tied, count(*) FILTER (positive AND NOT selected AND twin_in AND gender = 'female') AS female_in, count(*) FILTER (positive AND selected AND NOT twin_in AND gender = 'female') AS female_out,
               count(*) FILTER (positive AND NOT selected AND twin_in AND gender = 'male') AS male_in, count(*) FILTER (positive AND selected AND NOT twin_in AND gender = 'male') AS male_out,
               round(avg(selected::INTEGER::DOUBLE) FILTER (positive AND gender = 'female') / avg(selected::INTEGER::DOUBLE) FILTER (positive AND gender = 'male'), 6) AS ratio,
               round(avg(credit) FILTER (positive AND gender = 'female') / avg(credit) FILTER (positive AND gender = 'male'), 6) AS tie_fair_ratio FROM c)"""


@query("a38_fairness", f"WITH {W.POOL} " + " UNION ALL ".join(f"SELECT * FROM {fairness_sql(c)}" for c in (50, 75, 100)))
def a38(spark, d):
    """Four-fifths and tie-fair ratios, who enters or leaves when read as the twin."""
    return rounded(shortlist.fairness(W.shortlist_pool(spark, d), [50, 75, 100]))


@query("a49_residual_cells", f"WITH {W.SCORED} SELECT tier, ref, lang, count(*) AS n, count(*) FILTER (correct = 0) AS wrong FROM scored GROUP BY 1, 2, 3 HAVING count(*) >= 5")
def a49(spark, d):
    return W.scored(spark, d).groupBy("tier", "ref", "lang").agg(F.count("*").alias("n"), F.count_if(F.col("correct") == 0).alias("wrong")).where("n >= 5")


@query("a52_cascade", f"WITH {W.SCORED} SELECT threshold, round(avg(CAST(confidence >= threshold AS DOUBLE)), 6) AS coverage, round(avg(correct) FILTER (confidence >= threshold), 6) AS accuracy FROM scored, (SELECT unnest([0.6, 0.7, 0.8, 0.9, 0.95]::DOUBLE[]) AS threshold) GROUP BY threshold")
def a52(spark, d):
    rows = W.scored(spark, d).select("confidence", "correct", F.explode(F.array(*[F.lit(x) for x in (0.6, 0.7, 0.8, 0.9, 0.95)])).alias("threshold"))
    hit = F.col("confidence") >= F.col("threshold")
    return rounded(rows.groupBy("threshold").agg(F.avg(hit.cast("double")).alias("coverage"), F.avg(F.when(hit, F.col("correct"))).alias("accuracy")))


@query("a53_latency", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(arg_max(value, rn) FILTER (rn <= floor(0.95 * (n - 1)) + 1), 6) AS p95 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY event_type")
def a53(spark, d):
    w = Window.partitionBy("event_type")
    rows = W.table(spark, d, "events").select("event_type", "value").withColumns({"rn": F.row_number().over(w.orderBy("value")), "n": F.count("*").over(w)})
    near = F.when(F.col("rn") <= F.floor(0.95 * (F.col("n") - 1)) + 1, F.col("rn"))
    return rounded(rows.groupBy("event_type").agg(F.percentile("value", F.lit(0.5)).alias("median"), F.max_by("value", near).alias("p95")))


@query("a44_cost", "SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 4) AS intercept, round(avg(y), 6) AS mean FROM (SELECT n_chars::DOUBLE AS x, n_chars * 0.2::DOUBLE + 350 + " + W.u("cost", "doc_id") + " AS y FROM documents)")
def a44(spark, d):
    rows = W.table(spark, d, "documents").select(F.col("n_chars").cast("double").alias("x"), (F.col("n_chars") * 0.2 + 350 + uniform("cost", "doc_id")).alias("y"))
    return rows.agg(F.round(F.regr_slope("y", "x"), 6).alias("slope"), F.round(F.regr_intercept("y", "x"), 4).alias("intercept"), F.round(F.avg("y"), 6).alias("mean"))


@query("a43_cue_prevalence", f"WITH {W.ITEMS} SELECT tier, ref, count(*) AS n, round(avg(CAST(contains(lower(text), 'stupid') OR contains(lower(text), 'idiot') AS DOUBLE)), 6) AS cue FROM items WHERE ref IS NOT NULL GROUP BY 1, 2")
def a43(spark, d):
    cue = F.exists(F.array(F.lit("stupid"), F.lit("idiot")), lambda k: F.contains(F.lower("text"), k))
    return rounded(W.items(spark, d).where("ref is not null").groupBy("tier", "ref").agg(F.count("*").alias("n"), F.avg(cue.cast("double")).alias("cue")))


@query("u04_fixed_and_broken", f"WITH {W.VERDICTS}, a AS (SELECT item_id FROM verdicts WHERE predicted <> truth), b AS (SELECT item_id FROM verdicts WHERE twin_predicted <> truth) SELECT 'fixed' AS what, item_id FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'broken', item_id FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def u04(spark, d):
    v = W.verdicts(spark, d)
    a, b = v.where("predicted <> truth").select("item_id"), v.where("twin_predicted <> truth").select("item_id")
    return a.subtract(b).select(F.lit("fixed").alias("what"), "item_id").union(b.subtract(a).select(F.lit("broken").alias("what"), "item_id"))
