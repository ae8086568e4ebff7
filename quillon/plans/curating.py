"""Registered queries: training sets with twins, recorded labels, pairs by source id, version history, resumable extracts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..operators import paired, records, sampling
from ..registry import query
from . import worlds as W
from .answering import CACHE, LABEL, NAMES, cache, questions
from .measure import rounded

TWINS = f"{W.VERDICTS}, twins AS (SELECT 'twin-' || item_id AS item_id, item_id AS source_id, twin_p AS p, twin_predicted AS predicted FROM verdicts WHERE {W.u('tm', 'item_id')} >= 0.1)"


def twins(spark, d):
    """Twins as rows of their own that name the item they were made from; a tenth of the items have none."""
    v = W.verdicts(spark, d).where(S.uniform("tm", "item_id") >= 0.1)
    return v.select(F.concat(F.lit("twin-"), "item_id").alias("item_id"), F.col("item_id").alias("source_id"), F.col("twin_p").alias("p"), F.col("twin_predicted").alias("predicted"))


@query("j07_twin_pairs", f"WITH {TWINS} SELECT v.item_id AS source_id, t.item_id AS twin_id, round(v.p, 6) AS p, round(t.p, 6) AS twin_p, v.predicted <> t.predicted AS flipped FROM verdicts v JOIN twins t ON t.source_id = v.item_id")
def j07(spark, d):
    pairs = paired.pair_up(W.verdicts(spark, d).select("item_id", "p", "predicted"), twins(spark, d))
    return rounded(pairs.select("source_id", "twin_id", "p", "twin_p", (F.col("predicted") != F.col("twin_predicted")).alias("flipped")))


@query("j10_versions", "SELECT doc_id AS source_id, grp, CAST(k AS INTEGER) AS k, doc_id || '-' || grp || '-' || k AS version_id FROM documents, (SELECT unnest(['white', 'black', 'hispanic', 'asian']) AS grp), (SELECT unnest([1, 2, 3, 4]) AS k)")
def j10(spark, d):
    """Every item under four names of four groups; sixteen rows from each, in its own task."""
    built = paired.version_rows(W.table(spark, d, "documents").select(F.col("doc_id").alias("source_id")), ["white", "black", "hispanic", "asian"], 4)
    return built.select("*", F.concat_ws("-", "source_id", "grp", "k").alias("version_id"))


@query("a25_arm_rows", f"""WITH {TWINS} SELECT coalesce(gender, 'all') AS gender, count(*) AS n, round(avg(CAST(v.predicted = truth AS DOUBLE)), 6) AS accuracy, round(avg(CAST(v.predicted <> t.predicted AS DOUBLE)), 6) AS flip_rate,
    round(avg(abs(t.p - v.p)), 6) AS mean_abs_shift, round(avg(t.p - v.p), 6) AS mean_shift FROM verdicts v JOIN twins t ON t.source_id = v.item_id GROUP BY GROUPING SETS ((), (gender))""")  # fmt: skip
def a25_arm(spark, d):
    """One arm's rows, over all pairs and by gender, in one pass."""
    pairs = paired.pair_up(W.verdicts(spark, d).select("item_id", "p", "predicted", "truth", "gender"), twins(spark, d))
    return rounded(paired.arm_rows(pairs, "gender"))


@query("w14_pairwise_flips", f"""WITH {W.VERSIONS}, w AS (SELECT source_id, k, predicted AS base FROM versions WHERE grp = 'white'), r AS (SELECT grp, v.predicted <> base AS flip FROM versions v JOIN w USING (source_id, k) WHERE grp <> 'white'
    UNION ALL SELECT 'white', a.base <> b.base FROM w a JOIN w b ON a.source_id = b.source_id AND b.k = a.k + 2) SELECT grp, count(*) AS n, round(avg(CAST(flip AS DOUBLE)), 6) AS flip_rate FROM r GROUP BY grp""")  # fmt: skip
def w14(spark, d):
    """Each group's k-th name against the reference's k-th; the reference's own halves against each other are the floor."""
    return rounded(paired.pairwise_flips(W.versions(spark, d), ["black", "hispanic", "asian"], "white", 4))


@query("w06_monotone_table", f"""WITH {W.SCORED_LARGE}, b AS (SELECT confidence, count(*) AS n, avg(correct) AS accuracy FROM scored_large GROUP BY 1)
    SELECT round(confidence, 6) AS confidence, n, round(accuracy, 6) AS accuracy, round(max(accuracy) OVER (ORDER BY confidence), 6) AS fitted FROM b""")  # fmt: skip
def w06(spark, d):
    """Running maximum of the accuracy of ever higher confidences; the window sees one row a confidence."""
    by = W.scored_large(spark, d).groupBy("confidence").agg(F.count("*").alias("n"), F.avg("correct").alias("accuracy"))
    return rounded(by.withColumn("fitted", F.max("accuracy").over(Window.partitionBy(F.lit(0)).orderBy("confidence"))))


HISTORY = f"versions AS (SELECT o_custkey AS card, o_orderkey AS version, {W.u('acc', 'o_orderkey')} AS accuracy FROM orders)"


@query("w13_version_history", f"""WITH {HISTORY} SELECT card, version, row_number() OVER w AS position, lag(version) OVER w AS parent, round(accuracy - lag(accuracy) OVER w, 6) AS gain FROM versions WINDOW w AS (PARTITION BY card ORDER BY version)""")
def w13(spark, d):
    """A card's versions by lineage, each with its parent and what it gained."""
    o = W.table(spark, d, "orders").select(F.col("o_custkey").alias("card"), F.col("o_orderkey").alias("version"), S.uniform("acc", "o_orderkey").alias("accuracy"))
    line = Window.partitionBy("card").orderBy("version")
    before = F.lag("accuracy").over(line)
    return rounded(o.select("card", "version", F.row_number().over(line).cast("long").alias("position"), F.lag("version").over(line).alias("parent"), (F.col("accuracy") - before).alias("gain")))


TWIN_ROWS = ", ".join(f"least({n} + 0.05::DOUBLE, 1) AS {n}" for n in NAMES)


@query("f01_training_set", f"""WITH {W.FEEDBACK}, {CACHE}, l AS (SELECT item_id, arg_max(struct_pack(label := {LABEL}, propensity := propensity), (ts, event_id)) AS v FROM feedback GROUP BY 1),
    a AS (SELECT item_id, {", ".join(f"max(noul) FILTER (name = '{n}') AS {n}" for n in NAMES)} FROM cache JOIN questions USING (name, qhash) GROUP BY 1 HAVING count(DISTINCT name) = 3),
    k AS (SELECT item_id, v.label AS label, v.propensity AS propensity, {", ".join(NAMES)} FROM l JOIN a USING (item_id) WHERE v.label IN ('positive', 'negative') AND v.propensity IS NOT NULL),
    t AS (SELECT CAST(item_id AS VARCHAR) AS item_id, label, propensity, {", ".join(NAMES)} FROM k UNION ALL SELECT item_id || '__twin', label, propensity, {TWIN_ROWS} FROM k WHERE {W.u('tw', 'item_id')} < 0.5),
    r AS (SELECT *, 1 / propensity AS raw, count(*) OVER () AS n, row_number() OVER (ORDER BY 1 / propensity, item_id) AS i FROM t), c AS (SELECT *, least(raw, 20 * max(CASE WHEN i = n // 2 + 1 THEN raw END) OVER ()) AS capped FROM r)
    SELECT item_id, label, {", ".join(f"round({n}, 6) AS {n}" for n in NAMES)}, round(capped * n / sum(capped) OVER (), 6) AS weight FROM c""")  # fmt: skip
def f01(spark, d):
    """Latest trusted labels with complete answers; a twin takes its item's label and propensity; weights over all rows."""
    f = W.feedback(spark, d)
    label = F.regexp_replace(F.lower(records.label_of(F.col("label_source"), F.col("final"), F.col("is_invalid"))), r"\.+$", "")
    last = records.latest_by(f.select("item_id", "ts", "event_id", "propensity", label.alias("label")), ["item_id"], ["ts", "event_id"])
    features = records.feature_rows(cache(spark, d), questions(spark), NAMES)
    made = features.where(S.uniform("tw", "item_id") < 0.5).select("item_id", *[F.least(F.col(n) + 0.05, F.lit(1.0)).alias(n) for n in NAMES])
    return rounded(sampling.training_set(last, features, ["positive", "negative"], NAMES, made))


@query("c04_record_label", f"""WITH {W.FEEDBACK}, v AS (SELECT event_id, initial, rtrim(lower(final), '.') AS final, {W.u('rv', 'event_id')} AS r FROM feedback)
    SELECT event_id, CASE WHEN r < 0.5 THEN initial WHEN r < 0.9 THEN final END AS final, CASE WHEN r < 0.5 THEN true WHEN r < 0.9 THEN final = initial END AS is_agreement,
           CASE WHEN r < 0.9 THEN 'regular_final_feedback' ELSE 'unresolved' END AS label_source FROM v""")  # fmt: skip
def c04(spark, d):
    """C4: a person's verdicts become label records."""
    r = S.uniform("rv", "event_id")
    said = F.when(r < 0.5, "agree").when(r < 0.9, "disagree").otherwise("skip")
    rows = W.feedback(spark, d).select("event_id", F.col("initial").alias("predicted"), F.col("final").alias("correct_label"), said.alias("verdict"))
    return records.recorded(rows, ["positive", "negative"]).select("event_id", "final", "is_agreement", "label_source")


@query("m17_legends", f"SELECT event_type, count(*) AS n, count(*) FILTER ({W.u('lg', 'event_id')} < 0.1) AS differing FROM events GROUP BY event_type")
def m17(spark, d):
    """Answers whose legend doesn't have the levels of the question, counted; `matching_legend` refuses them."""
    legend = F.when(S.uniform("lg", "event_id") < 0.1, F.array(*map(F.lit, "abcd"))).otherwise(F.array(*map(F.lit, "abc")))
    return W.table(spark, d, "events").select("event_type", S.legend_differs(legend, 3).alias("bad")).groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("bad").alias("differing"))


@query("t12_title", """SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(x, '[A-Za-z]+|[^A-Za-z]+'), lambda t: upper(t[1]) || lower(t[2:])), '') AS name
    FROM (SELECT p_partkey, trim(' mc-' || p_brand || ' O''NEIL ' || p_type || '  ') AS x FROM part)""")  # fmt: skip
def t12(spark, d):
    """Names as titles, where a letter after anything but a letter is upper case."""
    x = F.concat(F.lit(" mc-"), "p_brand", F.lit(" O'NEIL "), "p_type", F.lit("  "))
    return W.table(spark, d, "part").select("p_partkey", S.title(x).alias("name"))


@query("x01_lookup", f"WITH {CACHE} SELECT item_id, name, round(noul, 6) AS noul FROM cache JOIN questions USING (name, qhash) WHERE item_id = 7 AND name = 'tone'")
def x01(spark, d):
    """The answer of one item to one question; the filter reaches the scan."""
    return rounded(records.lookup(cache(spark, d), questions(spark), 7, "tone").select("item_id", "name", "noul"))


@query("x18_resumable", f"""WITH p AS (SELECT doc_id, n_chars, {W.u('pf', 'doc_id')} < 0.4 AS done FROM documents) SELECT count(*) AS n, sum(n_chars)::BIGINT AS chars, round(sum(n_chars) / 4.0::DOUBLE * 0.000002::DOUBLE, 6) AS price FROM p WHERE NOT done""")
def x18(spark, d):
    """What an extract that was broken off still needs, and its price, before anything is asked."""
    docs = W.table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "n_chars")
    partial = docs.where(S.uniform("pf", "item_id") < 0.4).select("item_id")
    return rounded(records.remaining(docs, partial).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), (F.sum("n_chars") / 4.0 * 0.000002).alias("price")))
