"""Filling an answer cache: an engine is asked for what is missing and nothing else, wave by wave, so that a broken-off run goes on.

A run is named. What it has to ask is planned once, one request an item, and written; items are dealt out over waves by a hash of the id.
A wave is one Spark job whose results, answers and errors alike, are one folder that its commit completes; run again under the same
name, waves that are there are left alone and the plan is not made anew. What a wave had asked before it broke off is asked again, so
that the client gets the same key for the same request. Another run plans without what the cache holds by then, errors included.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import records
from .scorecards import ANSWERS, Question

ANSWER = ANSWERS.removeprefix("map<string,").removesuffix(">")
ROWS = f"item_id string, name string, qhash string, model string, answer {ANSWER}, error string, input_tokens long, output_tokens long"
KINDS = {"noul": pa.float64(), "choice": pa.string(), "score": pa.float64(), "confidence": pa.float64(), "probabilities": pa.map_(pa.string(), pa.float64()), "legend": pa.map_(pa.string(), pa.string())}
SCHEMA = pa.schema([("item_id", pa.string()), ("name", pa.string()), ("qhash", pa.string()), ("model", pa.string()), ("answer", pa.struct(list(KINDS.items()))), ("error", pa.string()), ("input_tokens", pa.int64()), ("output_tokens", pa.int64())])

#: (request key, text, question bodies by name) -> {"answers": {name: answer}, "model": str, "usage": {"input_tokens": n, "output_tokens": n}}
Client = Callable[[str, str, Mapping[str, dict]], Mapping]


def _there(spark: SparkSession, path: str) -> bool:
    """Whether a job has completed a folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def results(spark: SparkSession, folder: str) -> DataFrame:
    """All that engines have said, with run and wave; empty before the first wave."""
    try:
        return spark.read.schema(f"{ROWS}, run string, wave int").parquet(f"{folder}/results")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{ROWS}, run string, wave int")


def cached(spark: SparkSession, folder: str) -> DataFrame:
    """item_id, name, qhash, model, answer: one answer a question, that of the last run in order of names."""
    good = results(spark, folder).where("error is null and answer is not null").select("item_id", "name", "qhash", "model", "answer", "run")
    return good.groupBy("item_id", "name", "qhash").agg(F.max_by(F.struct("model", "answer"), "run").alias("r")).select("item_id", "name", "qhash", "r.*")


def _asking(client: Client, bodies: Mapping[str, str], concurrency: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(request: tuple[str, str, list[dict]]) -> list[dict]:
            item, text, gap = request
            asked = {g["name"]: json.loads(bodies[g["name"]]) for g in gap}
            none = {"item_id": item, "model": None, "answer": None, "error": None, "input_tokens": None, "output_tokens": None}
            try:
                got = client(f"{item}:{','.join(sorted(g['qhash'] for g in gap))}", text or "", asked)
                usage = got.get("usage") or {}
                # the request's tokens stand with its first answer
                paid = [{"input_tokens": usage.get("input_tokens"), "output_tokens": usage.get("output_tokens")}, *[{}] * (len(gap) - 1)]
                answers = got["answers"]
                return [none | g | {"model": got.get("model"), "answer": answers.get(g["name"]), "error": None if g["name"] in answers else "no answer"} | p for g, p in zip(gap, paid, strict=True)]
            except Exception as e:  # an item's failure is a result; the run goes on
                return [none | g | {"error": f"{type(e).__name__}: {e}"[:200]} for g in gap]

        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                requests = zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), batch.column("gap").to_pylist(), strict=True)
                yield pa.RecordBatch.from_pylist([r for rs in pool.map(one, requests) for r in rs], schema=SCHEMA)

    return run


def fill(items: DataFrame, questions: Mapping[str, Question], folder: str, client: Client, run: str, waves: int = 8, concurrency: int = 16) -> DataFrame:
    """Asks for the missing answers of items (item_id, text) and reports in one row: requested, failures, already_complete (items),
    missing_answers, input_tokens, output_tokens, errors (three distinct ones at most). Failures are counted, never raised."""
    spark, plan = items.sparkSession, f"{folder}/plans/{run}"
    spread = max(2, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    items = items.select(F.col("item_id").cast("string").alias("item_id"), "text")
    if not _there(spark, plan):
        asked = spark.createDataFrame([(n, q.fingerprint) for n, q in questions.items()], "name string, qhash string")
        gaps = records.missing(items, asked, cached(spark, folder)).groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("name", "qhash"))).alias("gap"))  # of one card's questions
        gaps.join(items, "item_id").withColumn("wave", F.pmod(F.xxhash64("item_id"), F.lit(waves)).cast("int")).repartition(spread, "item_id", "wave").write.mode("overwrite").partitionBy("wave").parquet(plan)
    requests = spark.read.schema("item_id string, gap array<struct<name:string,qhash:string>>, text string, wave int").parquet(plan)
    ask = _asking(client, {n: json.dumps(q.body) for n, q in questions.items()}, concurrency)
    for wave in range(waves):
        path = f"{folder}/results/run={run}/wave={wave}"
        if not _there(spark, path):
            requests.where(F.col("wave") == wave).select("item_id", "text", "gap").repartition(spread).mapInArrow(ask, ROWS).write.mode("overwrite").parquet(path)
    own = results(spark, folder).where(F.col("run") == run)
    by_item = own.groupBy("item_id").agg(F.count_if(F.col("error").isNotNull()).alias("failed"), F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o"), F.count("*").alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    figures = by_item.agg(F.count_if(F.col("failed") == 0).alias("requested"), F.count_if(F.col("failed") > 0).alias("failures"), zero(F.sum("i")).alias("input_tokens"), zero(F.sum("o")).alias("output_tokens"), zero(F.sum("n")).alias("missing_answers"), F.count("*").alias("_asked"))
    errors = own.where("error is not null").select("error").distinct().orderBy("error").limit(3).agg(F.array_sort(F.collect_list("error")).alias("errors"))
    whole = items.select("item_id").distinct().agg(F.count("*").alias("_items"))
    return figures.crossJoin(whole).crossJoin(errors).select("requested", "failures", (F.col("_items") - F.col("_asked")).alias("already_complete"), "missing_answers", "input_tokens", "output_tokens", "errors")
