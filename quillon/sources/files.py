"""Reading and appending records in files that Spark reaches, plain or compressed."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one on a single machine only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/quillon/{label}-{uuid.uuid4().hex}"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, plain or gzip by their names: blank lines are skipped, unknown fields ignored, missing ones null. A line that is no
    record raises an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; quotes double inside quoted fields, which may hold line breaks."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "FAILFAST").csv(path)


def append_jsonl(rows: DataFrame, path: str, gzip: bool = False) -> None:
    """Appends records as JSON lines, in new files; fields that are null are left out. An empty frame adds nothing to read."""
    rows.write.mode("append").option("compression", "gzip" if gzip else "none").json(path)


def put_answers(cache_path: str, answers: DataFrame) -> None:
    """Appends answers (item_id, name, qhash, seq, ...) to a cache of JSON lines; a later seq supersedes."""
    append_jsonl(answers, cache_path, gzip=True)


def load_answers(spark: SparkSession, cache_path: str, schema: str, questions: DataFrame | None = None) -> DataFrame:
    """The latest answer to each (item, question wording); with `questions` (name, qhash), those of the current wording alone."""
    rows = read_jsonl(spark, cache_path, schema)
    if questions is not None:
        rows = rows.join(questions.select("name", "qhash"), ["name", "qhash"], "left_semi")
    whole = F.struct(*rows.columns)
    return rows.groupBy("item_id", "name", "qhash").agg(F.max_by(whole, "seq").alias("r")).select("r.*")


LINEAGE = "version long, parent long, kind string, created_at string, sha256 string, n_feedback long, provenance map<string,string>"


class Conflict(RuntimeError):
    """Another commit has come first."""


def write_once(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all: written under another name and renamed, which fails if the file is there."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    target, draft = hadoop.Path(path), hadoop.Path(f"{path.rsplit('/', 1)[0]}/.draft-{uuid.uuid4().hex}")
    system = target.getFileSystem(conf)
    out = system.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    never = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    never[0] = hadoop.Options.Rename.NONE
    try:
        hadoop.FileContext.getFileContext(system.getUri(), conf).rename(system.makeQualified(draft), system.makeQualified(target), never)
    except Py4JJavaError as e:
        system.delete(draft, False)
        if "FileAlreadyExists" in str(e.java_exception.getClass()) or system.exists(target):
            raise Conflict(f"{path} is there already") from None
        raise


def _versions(spark: SparkSession, folder: str) -> DataFrame:
    try:
        return read_jsonl(spark, f"{folder}/versions", f"{LINEAGE}, content string")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{LINEAGE}, content string")


def lineage(spark: SparkSession, folder: str) -> DataFrame:
    """The versions of a configuration in order; empty before the first commit."""
    return _versions(spark, folder).drop("content").orderBy("version")


def version_of(spark: SparkSession, folder: str) -> int:
    """The number of the latest version, 0 before the first."""
    return _versions(spark, folder).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]


def commit(spark: SparkSession, folder: str, text: str, kind: str, n_feedback: int, provenance: dict[str, str] | None = None, expected: int | None = None) -> int:
    """Adds a version of a configuration on top of version `expected` (the latest by default) and returns its number. Text and lineage are
    one file that is never overwritten: of two commits on top of one version, one raises Conflict and leaves nothing."""
    parent = version_of(spark, folder) if expected is None else expected
    entry = {"version": parent + 1, "parent": parent or None, "kind": kind, "created_at": datetime.now(UTC).isoformat(), "sha256": hashlib.sha256(text.encode()).hexdigest()[:16], "n_feedback": n_feedback, "provenance": provenance or {}, "content": text}
    write_once(spark, f"{folder}/versions/v{parent + 1:08d}.json", json.dumps({k: v for k, v in entry.items() if v is not None}))
    return parent + 1


def version_text(spark: SparkSession, folder: str, version: int | None = None) -> str:
    """A version's text, the latest by default. An unknown version is an error."""
    wanted = version or version_of(spark, folder)
    row = _versions(spark, folder).where(F.col("version") == wanted).select("content").first()
    if row is None:
        raise ValueError(f"no version {wanted} in {folder}")
    return row[0]
