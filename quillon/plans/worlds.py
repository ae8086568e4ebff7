"""The logical tables that the registered queries work on, each as a DataFrame and as SQL for the oracle.

The test tables hold no engine's answers, so answers, twins and propensities come from reproducible md5 draws.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import uniform


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def u(salt: str, *ids: str) -> str:
    """The md5 draw in DuckDB SQL."""
    return f"(('0x' || substr(md5('{salt}'" + "".join(f" || '#' || CAST({i} AS VARCHAR)" for i in ids) + "), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    size = F.col("n_chars")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("item_id"), "text", "lang", "source", "n_chars", "toxic", F.when(F.col("doc_id") % 5 < 2, "test").otherwise("pool").alias("split"),
        F.when(size < 500, "strong").when(size < 1500, "medium").when(size < 4000, "weak").otherwise("neutral").alias("tier"),
        F.when(F.col("quality") == 1, "positive").when(F.col("quality") == 0, "negative").alias("ref"),
    )


ITEMS = """items AS (
    SELECT d.doc_id AS item_id, text, lang, source, n_chars, toxic, CASE WHEN d.doc_id % 5 < 2 THEN 'test' ELSE 'pool' END AS split,
           CASE WHEN n_chars < 500 THEN 'strong' WHEN n_chars < 1500 THEN 'medium' WHEN n_chars < 4000 THEN 'weak' ELSE 'neutral' END AS tier,
           CASE quality WHEN 1 THEN 'positive' WHEN 0 THEN 'negative' END AS ref
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def answers(items: DataFrame) -> DataFrame:
    """The holistic answer: p(positive) to two decimals, so that values tie."""
    lean = F.when(F.col("ref") == "positive", 0.15).when(F.col("ref") == "negative", -0.15).otherwise(0.0)
    raw = F.lit(0.5) + lean + (uniform("h", "item_id") - 0.5) * 0.8
    p = F.floor(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)) * 100 + 0.5) / F.lit(100.0)
    return items.withColumn("p", p).withColumns({"predicted": F.when(F.col("p") >= 0.5, "positive").otherwise("negative"), "confidence": F.greatest(F.col("p"), 1 - F.col("p"))})


ANSWERS = f"""answered AS (
    SELECT *, CASE WHEN p >= 0.5 THEN 'positive' ELSE 'negative' END AS predicted, greatest(p, 1 - p) AS confidence
    FROM (SELECT *, floor(least(greatest(0.5::DOUBLE + CASE ref WHEN 'positive' THEN 0.15::DOUBLE WHEN 'negative' THEN -0.15::DOUBLE ELSE 0.0::DOUBLE END + ({u('h', 'item_id')} - 0.5::DOUBLE) * 0.8::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) * 100 + 0.5::DOUBLE) / 100.0::DOUBLE AS p FROM items))"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored test items with a reference label: confidence, correct (0/1), weight."""
    return answers(items(spark, sf_dir)).where("ref is not null").select("item_id", "split", "tier", "lang", "ref", "predicted", "p", "confidence", (F.col("predicted") == F.col("ref")).cast("int").alias("correct"), (1 + F.col("item_id") % 4).cast("double").alias("weight"))


SCORED = f"""{ITEMS}, {ANSWERS}, scored AS (
    SELECT item_id, split, tier, lang, ref, predicted, p, confidence, CAST(predicted = ref AS INTEGER) AS correct, CAST(1 + item_id % 4 AS DOUBLE) AS weight
    FROM answered WHERE ref IS NOT NULL)"""


def scored_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as scored items: few confidences, many ties."""
    return table(spark, sf_dir, "lineitem").select((F.lit(0.5) + F.col("l_discount").cast("double") * 5).alias("raw"), (F.col("l_linestatus") == "F").cast("int").alias("correct"), F.col("l_returnflag").alias("stratum"), (1 / F.col("l_quantity").cast("double")).alias("weight")).withColumn("confidence", F.round("raw", 3)).drop("raw")


SCORED_LARGE = """scored_large AS (
    SELECT CAST(round(0.5::DOUBLE + l_discount::DOUBLE * 5, 3) AS DOUBLE) AS confidence, CAST(l_linestatus = 'F' AS INTEGER) AS correct, l_returnflag AS stratum, 1 / l_quantity::DOUBLE AS weight FROM lineitem)"""


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as labelling events: an item is revisited about ten times; seq orders them."""
    n = table(spark, sf_dir, "documents").agg(F.count("*").alias("n"))
    return feedback_of(table(spark, sf_dir, "events").crossJoin(F.broadcast(n)), F.col("n"))


def feedback_of(e: DataFrame, n: Column) -> DataFrame:
    """The same of any events, batch or stream, over n items."""
    k = F.get_json_object("props", "$.k").cast("int")
    source = F.when(F.col("event_type") == "error", "unresolved").when(F.col("event_type") == "signup", "score_result_or_imported").when(F.col("event_type") == "purchase", "vetted_feedback").otherwise("regular_final_feedback")
    return e.select(
        "event_id", "ts", (F.col("event_id") % n).alias("item_id"), source.alias("label_source"), ((1 + k) / F.lit(100.0)).alias("propensity"),
        F.when(uniform("fi", "event_id") < 0.55, "positive").otherwise("negative").alias("initial"), F.when(uniform("ff", "event_id") < 0.5, "Positive.").otherwise("negative").alias("final"),
        F.when(uniform("fc", "event_id") < 0.3, "because").otherwise("").alias("comment"), (uniform("fx", "event_id") < 0.05).alias("is_invalid"),
    )


FEEDBACK = f"""feedback AS (
    SELECT event_id, ts, event_id % (SELECT count(*) FROM documents) AS item_id,
           CASE event_type WHEN 'error' THEN 'unresolved' WHEN 'signup' THEN 'score_result_or_imported' WHEN 'purchase' THEN 'vetted_feedback' ELSE 'regular_final_feedback' END AS label_source,
           (1 + CAST(json_extract(props, '$.k') AS INTEGER)) / 100.0::DOUBLE AS propensity,
           CASE WHEN {u('fi', 'event_id')} < 0.55 THEN 'positive' ELSE 'negative' END AS initial,
           CASE WHEN {u('ff', 'event_id')} < 0.5 THEN 'Positive.' ELSE 'negative' END AS final,
           CASE WHEN {u('fc', 'event_id')} < 0.3 THEN 'because' ELSE '' END AS comment, {u('fx', 'event_id')} < 0.05 AS is_invalid
    FROM events)"""


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as items with a twin: p, twin_p, truth, gender."""
    p, twin = uniform("w", "vec_id"), F.least(F.greatest(uniform("w", "vec_id") + (uniform("t", "vec_id") - 0.5) * 0.2, F.lit(0.0)), F.lit(1.0))
    call = lambda c: F.when(F.col(c) >= 0.5, "positive").otherwise("negative")
    base = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), p.alias("p"), twin.alias("twin_p"), F.when(F.col("label") % 2 == 0, "positive").otherwise("negative").alias("truth"), F.when(F.col("vec_id") % 2 == 0, "female").otherwise("male").alias("gender"))
    return base.withColumns({"predicted": call("p"), "twin_predicted": call("twin_p")})


VERDICTS = f"""verdicts AS (
    SELECT *, CASE WHEN p >= 0.5 THEN 'positive' ELSE 'negative' END AS predicted, CASE WHEN twin_p >= 0.5 THEN 'positive' ELSE 'negative' END AS twin_predicted
    FROM (SELECT vec_id AS item_id, {u('w', 'vec_id')} AS p, least(greatest({u('w', 'vec_id')} + ({u('t', 'vec_id')} - 0.5::DOUBLE) * 0.2::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) AS twin_p,
                 CASE WHEN label % 2 = 0 THEN 'positive' ELSE 'negative' END AS truth, CASE WHEN vec_id % 2 = 0 THEN 'female' ELSE 'male' END AS gender FROM embeddings))"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item under four names of four groups: source_id, grp, k, p."""
    groups, ks = F.explode(F.array(*map(F.lit, ("white", "black", "hispanic", "asian")))), F.explode(F.sequence(F.lit(1), F.lit(4)))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("source_id"), groups.alias("grp")).select("*", ks.alias("k")).withColumn("p", uniform("g", "grp", "k", "source_id")).withColumn("predicted", F.when(F.col("p") >= 0.5, "positive").otherwise("negative"))


VERSIONS = f"""versions AS (
    SELECT *, CASE WHEN p >= 0.5 THEN 'positive' ELSE 'negative' END AS predicted
    FROM (SELECT vec_id AS source_id, grp, CAST(k AS INTEGER) AS k, {u('g', 'grp', 'k', 'vec_id')} AS p FROM embeddings, (SELECT unnest(['white', 'black', 'hispanic', 'asian']) AS grp), (SELECT unnest([1, 2, 3, 4]) AS k)))"""


def shortlist_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as applicants: score and twin score with ties, gender, positive."""
    s = lambda salt: F.floor(uniform(salt, "c_custkey") * 20) / F.lit(20.0)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("item_id"), s("s").alias("score"), s("st").alias("twin_score"), F.when(F.col("c_nationkey") % 2 == 0, "female").otherwise("male").alias("gender"), (F.col("c_mktsegment") == "FURNITURE").alias("positive"))


POOL = f"""pool AS (
    SELECT CAST(c_custkey AS VARCHAR) AS item_id, floor({u('s', 'c_custkey')} * 20) / 20.0::DOUBLE AS score, floor({u('st', 'c_custkey')} * 20) / 20.0::DOUBLE AS twin_score,
           CASE WHEN c_nationkey % 2 = 0 THEN 'female' ELSE 'male' END AS gender, c_mktsegment = 'FURNITURE' AS positive FROM customer)"""
