"""Registered queries: the scoreboard, the control loop's state, triggers, fits and streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..operators import fitting, metrics, newton, records, sampling
from ..registry import query
from . import worlds as W
from .measure import SUMMARY, ece_sql, rounded


@query("c08_scoreboard", f"""WITH {W.SCORED}, t AS (SELECT * FROM scored WHERE split = 'test')
    SELECT s.*, round(ece, 6) AS ece FROM (SELECT tier, {SUMMARY} FROM t GROUP BY tier) s JOIN ({ece_sql('t', 'tier')}) e USING (tier)""")  # fmt: skip
def c08(spark, d):
    """Test items served by the identity head (weight 2 on the centred log ratio), measured by tier."""
    rows = W.items(spark, d).where("split = 'test' and ref is not null")
    answered = W.answers(rows).select("item_id", "tier", "ref", "p")
    clr = S.centred_log_ratios(F.create_map(F.lit("positive"), F.col("p"), F.lit("negative"), 1 - F.col("p")), ["positive", "negative"], 1e-12)
    p = S.softmax([2.0 * clr[0], F.lit(0.0)])[0]
    served = answered.withColumn("served", F.round(p, 9)).withColumn("value", F.when(F.col("served") >= 0.5, "positive").otherwise("negative"))
    scored = served.select("tier", F.greatest("served", 1 - F.col("served")).alias("confidence"), S.agrees(F.col("value"), F.col("ref")).cast("int").alias("correct"), (1 + F.col("item_id") % 4).cast("double").alias("weight"))
    return rounded(metrics.summary(scored.withColumn("confidence", F.round("confidence", 6)), ["tier"]))


@query("c09_simulated_labels", f"WITH {W.SCORED} SELECT item_id, predicted AS initial, ref AS final, predicted = ref AS is_agreement FROM scored WHERE split = 'pool'")
def c09(spark, d):
    return W.scored(spark, d).where("split = 'pool'").select("item_id", F.col("predicted").alias("initial"), F.col("ref").alias("final"), (F.col("predicted") == F.col("ref")).alias("is_agreement"))


@query("a55_steering_state", """WITH e AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS n FROM events), f AS (SELECT coalesce(max(n) FILTER (event_type = 'purchase'), 0) AS fit, coalesce(max(n) FILTER (event_type = 'signup'), 0) AS rethink FROM e)
    SELECT count(*) FILTER (event_type = 'view' AND n > fit) AS labels_since_fit, count(*) FILTER (event_type = 'view' AND n > rethink) AS labels_since_rethink, count(*) FILTER (event_type = 'error' AND n > rethink) AS mismatches_since_rethink FROM e, f""")  # fmt: skip
def a55(spark, d):
    """Counts since the last fit and rethink. Times decide what is later; no row is numbered across the log."""
    e = W.table(spark, d, "events").select("event_type", F.struct("ts", "event_id").alias("at"))
    last = e.agg(F.max(F.when(F.col("event_type") == "purchase", F.col("at"))).alias("fit"), F.max(F.when(F.col("event_type") == "signup", F.col("at"))).alias("rethink"))
    since = lambda kind, mark: F.count_if((F.col("event_type") == kind) & (F.col(mark).isNull() | (F.col("at") > F.col(mark))))
    return e.crossJoin(F.broadcast(last)).agg(since("view", "fit").alias("labels_since_fit"), since("view", "rethink").alias("labels_since_rethink"), since("error", "rethink").alias("mismatches_since_rethink"))


@query("a56_ladder", "SELECT n_effective, arg_max(tier, least) AS tier, CASE arg_max(tier, least) WHEN 'hold' THEN 30 - n_effective WHEN 'shrunk' THEN 200 - n_effective WHEN 'standard' THEN 1000 - n_effective END AS to_next FROM (SELECT unnest([0.0, 29.9, 30.0, 199.0, 200.0, 1000.0]::DOUBLE[]) AS n_effective), (SELECT unnest(['hold', 'shrunk', 'standard', 'rich']) AS tier, unnest([0, 30, 200, 1000]) AS least) WHERE least <= n_effective GROUP BY n_effective")
def a56(spark, d):
    points = spark.createDataFrame([(x,) for x in (0.0, 29.9, 30.0, 199.0, 200.0, 1000.0)], "n_effective double")
    ladder = spark.createDataFrame([(t.name, float(t.least)) for t in fitting.LADDER], "tier string, least double")
    return points.join(F.broadcast(ladder), F.col("least") <= F.col("n_effective")).groupBy("n_effective").agg(F.max_by("tier", "least").alias("tier"), F.max("least").alias("at")).select("n_effective", "tier", fitting.to_next(F.col("n_effective")).alias("to_next"))


@query("w08_plateau", "SELECT window_id, round(coalesce(lag3 - loss, 0), 6) AS gain, coalesce(lag3 - loss < 0.01, false) AS plateau FROM (SELECT event_type AS window_id, value AS loss, lag(value, 3) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS lag3, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def w08(spark, d):
    w = Window.partitionBy("event_type")
    rows = W.table(spark, d, "events").select(F.col("event_type").alias("window_id"), F.col("value").alias("loss"), F.lag("value", 3).over(w.orderBy("ts", "event_id")).alias("lag3"), F.row_number().over(w.orderBy(F.desc("ts"), F.desc("event_id"))).alias("r"))
    gain = F.col("lag3") - F.col("loss")
    return rounded(rows.where("r = 1").select("window_id", F.coalesce(gain, F.lit(0.0)).alias("gain"), F.coalesce(gain < 0.01, F.lit(False)).alias("plateau")))


@query("a14_compare", f"""WITH {W.VERDICTS}, s AS (SELECT avg(CAST(predicted = truth AS DOUBLE)) AS a0, avg(CAST(twin_predicted = truth AS DOUBLE)) AS a1, avg((greatest(p, 1 - p) - CAST(predicted = truth AS DOUBLE)) ** 2) AS b0, avg((greatest(twin_p, 1 - twin_p) - CAST(twin_predicted = truth AS DOUBLE)) ** 2) AS b1, count(*)::DOUBLE AS n FROM verdicts)
    SELECT round(b0 - b1, 6) AS brier_gain, round(a1 - a0, 6) AS accuracy_change, round(2 / n, 6) AS tolerance, b0 - b1 >= 0.005 AND a1 >= a0 - 2 / n AS promoted FROM s""")  # fmt: skip
def a14(spark, d):
    v = W.verdicts(spark, d)
    hit, twin = (F.col("predicted") == F.col("truth")).cast("double"), (F.col("twin_predicted") == F.col("truth")).cast("double")
    conf = lambda c: F.greatest(F.col(c), 1 - F.col(c))
    old = v.agg(F.avg(hit).alias("accuracy"), F.avg((conf("p") - hit) * (conf("p") - hit)).alias("brier"))
    new = v.agg(F.avg(twin).alias("accuracy"), F.avg((conf("twin_p") - twin) * (conf("twin_p") - twin)).alias("brier"), F.count("*").cast("double").alias("n_effective"))
    return rounded(fitting.compare(new, old).drop("reasons"))


@query("f03_fit_head")
def f03(spark, d):
    """A head over two vector features, cross-validated, calibrated; its coefficients and out-of-fold figures."""
    e = lambda i: F.element_at("embedding", i).cast("double")
    rows = W.table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), (F.col("label") % 2 == 0).cast("double").alias("y"), F.lit(1.0).alias("weight"), e(1).alias("a"), e(2).alias("b"))
    n_effective = rows.agg(F.sum("weight") * F.sum("weight") / F.sum(F.col("weight") * F.col("weight"))).first()[0]
    found = fitting.fit_head(rows, ["a", "b"], n_effective)
    return spark.createDataFrame([(found["tier"], found["c"], found["method"], round(found["log_loss"], 6), round(found["weights"]["a"], 6), round(found["weights"]["b"], 6), round(found["intercept"], 6))], "tier string, c double, method string, log_loss double, weight_a double, weight_b double, intercept double")


def paired_rows(spark, d):
    """Labelled embeddings over two features, folds, and a twin whose first feature is moved, for two in three."""
    e = lambda i: F.element_at("embedding", i).cast("double")
    rows = W.table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), (F.col("label") % 2 == 0).cast("double").alias("y"), (1 + F.col("vec_id") % 3).cast("double").alias("weight"), e(1).alias("a"), e(2).alias("b"))
    twin = F.when(F.col("item_id") % 3 > 0, 1.0)
    return fitting.stratified_folds(rows, "y", "item_id").withColumns({newton.TWIN + "a": twin * (F.col("a") + 0.5), newton.TWIN + "b": twin * F.col("b")})


@query("f09_invariance_fit")
def f09(spark, d):
    """the head of each strength of the invariance penalty, fitted to all rows at one C."""
    strengths, features = [0.0, 1.0, 100.0, 10000.0], ["a", "b"]
    found = newton.fitted(paired_rows(spark, d), features, [newton.Job(0.3, s) for s in strengths])
    return spark.createDataFrame([(s, *[round(float(x), 6) for x in p[0]]) for s, p in zip(strengths, found, strict=True)], "penalty double, intercept double, weight_a double, weight_b double")


@query("f10_invariance_sweep")
def f10(spark, d):
    """out-of-fold figures and coefficients by strength, and the one to operate at."""
    out = newton.invariance_sweep(paired_rows(spark, d), ["a", "b"], [0.1, 1.0, 10.0, 100.0, 1000.0, 10000.0], registered=[0.1, 1.0, 10.0, 100.0])
    return rounded(out.select("*", F.col("weights.a").alias("weight_a"), F.col("weights.b").alias("weight_b")).drop("weights"))


@query("r07_windowed_agreement", f"WITH {W.FEEDBACK} SELECT time_bucket(INTERVAL '1 day', ts) AS day, count(*) AS n, round(avg(CAST(initial = rtrim(lower(final), '.') AS DOUBLE)), 6) AS agreement FROM feedback GROUP BY 1")
def r07(spark, d):
    f = W.feedback(spark, d)
    return rounded(f.groupBy(F.window("ts", "1 day")["start"].alias("day")).agg(F.count("*").alias("n"), F.avg((S.normalize_label(F.col("initial")) == S.normalize_label(F.col("final"))).cast("double")).alias("agreement")))


@query("a54_alignment", f"""WITH {W.FEEDBACK}, r AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS k FROM feedback), p AS (SELECT a.k, b.event_id, 1 / b.propensity AS raw, b.initial = rtrim(lower(b.final), '.') AS ok, count(*) OVER (PARTITION BY a.k) AS n, row_number() OVER (PARTITION BY a.k ORDER BY 1 / b.propensity, b.event_id) AS j FROM r a JOIN r b ON b.k BETWEEN a.k - 19 AND a.k),
    c AS (SELECT *, least(raw, 20 * max(CASE WHEN j = n // 2 + 1 THEN raw END) OVER (PARTITION BY k)) AS w FROM p)
    SELECT k, round(sum(w * CAST(ok AS INTEGER)) / sum(w), 6) AS agreement, round(sum(w) * sum(w) / sum(w * w), 4) AS n_effective FROM c GROUP BY k""")  # fmt: skip
def a54(spark, d):
    """A54, W7 over all labelling events, revisits too; a54_alignment_latest has latest-wins."""
    return curve(W.feedback(spark, d))


@query("a54_alignment_latest", f"""WITH {W.FEEDBACK}, l AS (SELECT * FROM feedback QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY ts DESC, event_id DESC) = 1),
    r AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS k FROM l WHERE NOT is_invalid AND label_source IN ('vetted_feedback', 'regular_final_feedback') AND final IS NOT NULL AND initial IS NOT NULL AND propensity > 0),
    p AS (SELECT a.k, b.event_id, 1 / b.propensity AS raw, b.initial = rtrim(lower(b.final), '.') AS ok, count(*) OVER (PARTITION BY a.k) AS n, row_number() OVER (PARTITION BY a.k ORDER BY 1 / b.propensity, b.event_id) AS j FROM r a JOIN r b ON b.k BETWEEN a.k - 19 AND a.k),
    c AS (SELECT *, least(raw, 20 * max(CASE WHEN j = n // 2 + 1 THEN raw END) OVER (PARTITION BY k)) AS w FROM p)
    SELECT k, round(sum(w * CAST(ok AS INTEGER)) / sum(w), 6) AS agreement, round(sum(w) * sum(w) / sum(w * w), 4) AS n_effective FROM c GROUP BY k""")  # fmt: skip
def a54_latest(spark, d):
    """Agreement over the last 20 labels, of the latest record of every item that has a trusted label, an agreement and a
    propensity. A later record without one takes the item out, as in the reference."""
    latest = records.latest_by(W.feedback(spark, d), ["item_id"], ["ts", "event_id"])
    return curve(latest.where(records.label_of(F.col("label_source"), F.col("final"), F.col("is_invalid")).isNotNull()))


@query("a54_alignment_cumulative", f"""WITH {W.FEEDBACK}, l AS (SELECT * FROM feedback QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY ts DESC, event_id DESC) = 1),
    r AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS k FROM l WHERE NOT is_invalid AND label_source IN ('vetted_feedback', 'regular_final_feedback') AND final IS NOT NULL AND initial IS NOT NULL AND propensity > 0),
    p AS (SELECT a.k, 1 / b.propensity AS raw, b.initial = rtrim(lower(b.final), '.') AS ok, count(*) OVER (PARTITION BY a.k) AS n, row_number() OVER (PARTITION BY a.k ORDER BY 1 / b.propensity, b.event_id) AS j FROM r a JOIN r b ON b.k <= a.k),
    c AS (SELECT *, least(raw, 20 * max(CASE WHEN j = n // 2 + 1 THEN raw END) OVER (PARTITION BY k)) AS w FROM p)
    SELECT k, round(sum(w * CAST(ok AS INTEGER)) / sum(w), 6) AS agreement, round(sum(w) * sum(w) / sum(w * w), 4) AS n_effective FROM c GROUP BY k""")  # fmt: skip
def a54_cumulative(spark, d):
    """The same over all labels so far (a window of 0), each prefix capped at its own median."""
    latest = records.latest_by(W.feedback(spark, d), ["item_id"], ["ts", "event_id"])
    return curve(latest.where(records.label_of(F.col("label_source"), F.col("final"), F.col("is_invalid")).isNotNull()), 0)


def curve(feedback, window=20):
    ok = (S.normalize_label(F.col("initial")) == S.normalize_label(F.col("final"))).cast("int")
    rows = feedback.withColumn("ok", ok).where("ok is not null and propensity is not null and propensity <> 0")
    return sampling.alignment_curve(rows, "ts", "event_id", window).select("k", F.round("agreement", 6).alias("agreement"), F.round("n_effective", 4).alias("n_effective"))
