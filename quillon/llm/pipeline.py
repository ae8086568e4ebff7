"""The stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame, each on what the one before has kept.

Rows without an id pass the near-duplicate stage, which can't name them; repeated rows (same id and text) are one there. Columns that
the stages add on the way get names that the input doesn't have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common, decontaminate, neardup, packing, repeats, toxicity


def unused(docs: DataFrame, name: str) -> str:
    """The name, with underscores after it until no column of docs is called so; case makes no difference to Spark."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, common.table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity of 0.8 or more."""
    kept_id, copy = unused(docs, "kept_id"), unused(docs, "copy")
    kept = neardup.near_duplicates(docs, k=5).where("kept").select(F.col("doc_id").alias(kept_id)).distinct()
    named = docs.where("doc_id is not null").join(kept, F.col("doc_id") == F.col(kept_id), "left_semi")
    once = named.withColumn(copy, F.row_number().over(Window.partitionBy("doc_id", "text").orderBy("doc_id"))).where(F.col(copy) == 1).drop(copy)
    return once.unionByName(docs.where("doc_id is null")).coalesce(common.parts_for(spark, docs.count(), 2000))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings that start in an earlier document too go from the texts."""
    cut = repeats.remove_repeats(docs, keep_text=True, carry=[c for c in docs.columns if c.lower() != "text"])
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return cut.select(*[(changed[c.lower()] if c.lower() in changed else F.col("rest").getField(c)).alias(c) for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold most of a test item go."""
    return decontaminate.without_leaks(docs, common.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, by sequence."""
    return packing.pack(docs)


#: Folders of tables that the stage before has written on its way to its result.
_before: list[tuple[SparkSession, str]] = []


def _stage(work):
    """A stage deletes what the one before has left in the shared folder besides its result, which is a table by then; where it isn't, and
    docs still come from those tables, they stay."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        folders = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in docs.inputFiles()}
        for session, path in _before:
            if folders and path.rsplit("/", 1)[-1] not in folders:  # none are named where docs are only cached
                common.delete(session, path)
        _before.clear()
        start = len(common.MADE)
        out = work(spark, docs, sf_dir)
        _before.extend(common.MADE[start:])
        return out

    return run


STAGES = [(name, _stage(work)) for name, work in (("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("repeats", drop_repeats), ("decontamination", drop_leaks), ("packing", pack))]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
        common.discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
