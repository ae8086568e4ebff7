"""Append-only records and the answer cache: latest wins, what is missing, what a set of questions would cost."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import normalize_label, strip

TRUSTED = ("vetted_feedback", "regular_final_feedback")


def latest_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by an explicit order: files have none. A partial maximum, no window and no sort."""
    values = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_v")).select(*keys, "_v.*")


def missing(items: DataFrame, questions: DataFrame, cache: DataFrame) -> DataFrame:
    """(item_id, name, qhash) that the cache has no answer for. Questions are those of one scorecard: a bounded handful."""
    asked = items.select("item_id").crossJoin(F.broadcast(questions.select("name", "qhash")))
    return asked.join(cache.select("item_id", "name", "qhash"), ["item_id", "name", "qhash"], "left_anti")


def plan(absent: DataFrame) -> DataFrame:
    """requests (items that miss an answer) and missing_answers; items are grouped first, so counts combine before the shuffle."""
    return absent.groupBy("item_id").count().agg(F.count("*").alias("requests"), F.coalesce(F.sum("count"), F.lit(0)).alias("missing_answers"))


def complete_items(cache: DataFrame, questions: DataFrame) -> DataFrame:
    """Items with an answer to every current question."""
    n = questions.select("name").distinct().agg(F.count("*").alias("_n"))
    have = cache.join(F.broadcast(questions.select("name", "qhash")), ["name", "qhash"], "left_semi").groupBy("item_id").agg(F.count_distinct("name").alias("_have"))
    return have.join(F.broadcast(n), F.col("_have") == F.col("_n")).select("item_id")


def wide_to_long(extract: DataFrame, questions: DataFrame) -> DataFrame:
    """An extract's answers map as cache rows: names of current questions only, under their current hash."""
    long = extract.select("item_id", F.explode("answers").alias("name", "answer"))
    return long.join(F.broadcast(questions.select("name", "qhash")), "name").select("item_id", "name", "qhash", "answer")


def override(base: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both, the other's where both have the key."""
    both = base.withColumn("_rank", F.lit(0)).unionByName(other.withColumn("_rank", F.lit(1)))
    return latest_by(both, keys, ["_rank"]).drop("_rank")


def label_of(source: Column, final: Column, is_invalid: Column) -> Column:
    """The trusted label: null if the record is invalid or its source is not trusted."""
    return F.when(~F.coalesce(is_invalid, F.lit(False)) & source.isin(*TRUSTED), final)


def drop_reason(label: Column, classes: list[str], propensity: Column, answered: Column) -> Column:
    """Why a record can't train, in order of precedence; null if it can."""
    return F.when(label.isNull(), "no_trusted_label").when(~label.isin(*classes), "label_not_in_classes").when(propensity.isNull(), "no_propensity").when(~answered, "needs_answers")


def per_label(rows: DataFrame, label: str, order: str, n: int) -> DataFrame:
    """A reproducible sample of n rows per label, by a hash of the id. The hash is dealt out over label and a bucket first, the n
    least of each bucket are then ranked together, so that a label with a third of all rows is many tasks."""
    h = F.md5(F.concat(F.lit("seed#"), F.col(order).cast("string")))
    hashed = rows.select(label, order, h.alias("_h"), F.pmod(F.xxhash64(order), F.lit(64)).alias("_b"))
    some = hashed.withColumn("_r", F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", order))).where(F.col("_r") <= n)
    return some.withColumn("_r", F.row_number().over(Window.partitionBy(label).orderBy("_h", order))).where(F.col("_r") <= n).select(label, order)


def ingest_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Text lines as items: blank lines and # comments skipped, id = first 12 characters of sha1, the first of equal texts kept."""
    text = strip(F.col(column))
    kept = lines.select(text.alias("text"), "line").where((F.col("text") != "") & ~F.col("text").startswith("#"))
    return kept.groupBy(F.substring(F.sha1(F.col("text").cast("binary")), 1, 12).alias("item_id")).agg(F.min_by("text", "line").alias("text"), F.min("line").alias("line"))


def feature_rows(cache: DataFrame, questions: DataFrame, names: Sequence[str], value: str = "noul") -> DataFrame:
    """A column per question for the items that have every answer; an answer to an older wording is none."""
    current = cache.join(F.broadcast(questions), ["name", "qhash"]).where(F.col("name").isin(*names))
    wide = current.groupBy("item_id").agg(*[F.max(F.when(F.col("name") == n, F.col(value))).alias(n) for n in names])
    return wide.where(reduce(and_, [F.col(n).isNotNull() for n in names]))


def lookup(cache: DataFrame, questions: DataFrame, item_id: int, name: str) -> DataFrame:
    """The answer of one item to one question as it is worded now; no row if there is none."""
    return cache.where((F.col("item_id") == item_id) & (F.col("name") == name)).join(F.broadcast(questions), ["name", "qhash"])


def remaining(items: DataFrame, partial: DataFrame, key: str = "item_id") -> DataFrame:
    """The items that a broken-off extract doesn't hold yet."""
    return items.join(partial.select(key).distinct(), key, "left_anti")


def recorded(rows: DataFrame, classes: list[str]) -> DataFrame:
    """Label records from a person's verdicts (predicted, verdict, correct_label). Agreeing keeps the prediction; disagreeing needs a
    label that is, normalised, one of the classes, and takes that class' own spelling; skipping leaves no label and an unresolved
    source. Anything else, a null verdict too, is an error."""
    allowed = F.create_map(*[x for c in classes for x in (normalize_label(F.lit(c)), F.lit(c))])
    given = normalize_label(F.col("correct_label"))
    chosen = F.when(given == "", F.raise_error(F.lit("disagreeing needs the correct label"))).otherwise(F.coalesce(allowed[given], F.raise_error(F.concat(F.lit("not one of the classes: "), "correct_label")).cast("string")))
    unknown = F.raise_error(F.concat(F.lit("unknown verdict: "), F.coalesce("verdict", F.lit("none"))))
    final = F.when(F.col("verdict") == "agree", F.col("predicted")).when(F.col("verdict") == "disagree", chosen).when(F.col("verdict") == "skip", F.lit(None)).otherwise(unknown)
    agreed = F.when(F.col("verdict") == "agree", True).when(F.col("verdict") == "disagree", normalize_label(F.col("final")) == normalize_label(F.col("predicted")))
    source = F.when(F.col("verdict") == "skip", "unresolved").otherwise("regular_final_feedback")
    return rows.withColumn("final", final.cast("string")).withColumns({"is_agreement": agreed, "label_source": source})
