"""A table that holds the latest record per key, in files, merged batch by batch.

Keys are dealt out over a fixed number of buckets. A batch rewrites only the buckets that it touches, under its own number, and then a
manifest says so; a bucket's data are those of its last manifest. A batch that is run again reads what was there before it and writes the
same, so that it changes nothing; one that died before its manifest has no effect. Nothing is kept on the driver but bucket numbers.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class KeyedTable:
    def __init__(self, spark: SparkSession, root: str, schema: StructType, keys: Sequence[str], order: Sequence[str], buckets: int = 32) -> None:
        self.spark, self.root, self.schema, self.keys, self.order, self.buckets = spark, root.rstrip("/"), schema, list(keys), list(order), buckets

    def _versions(self, before: int | None = None) -> dict[int, int]:
        """bucket -> the batch that wrote it last."""
        try:
            rows = self.spark.read.schema("bucket int, batch long").parquet(f"{self.root}/manifests")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}
        rows = rows if before is None else rows.where(F.col("batch") < before)
        return {r["bucket"]: r["batch"] for r in rows.groupBy("bucket").agg(F.max("batch").alias("batch")).collect()}

    def _read(self, versions: dict[int, int]) -> DataFrame:
        by_batch: dict[int, list[int]] = {}
        for bucket, batch in versions.items():
            by_batch.setdefault(batch, []).append(bucket)
        parts = [self.spark.read.schema(self.schema).parquet(*[f"{self.root}/data/batch={batch}/bucket={b}" for b in sorted(buckets)]) for batch, buckets in sorted(by_batch.items())]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._read(self._versions())

    def merge(self, rows: DataFrame, batch_id: int) -> None:
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        fresh = rows.select(*self.schema.names).persist()
        try:
            touched = [r[0] for r in fresh.select(bucket.alias("b")).distinct().collect()]
            if touched:
                held = {b: v for b, v in self._versions(before=batch_id).items() if b in touched}
                latest = fresh.unionByName(self._read(held)).groupBy(*self.keys).agg(F.max_by(F.struct(*self.schema.names), F.struct(*self.order)).alias("r")).select("r.*")
                latest.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/data/batch={batch_id}")
                self.spark.createDataFrame([(b,) for b in touched], "bucket int").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifests/batch={batch_id}")
        finally:
            fresh.unpersist()
