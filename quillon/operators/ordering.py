"""Places in a total order, without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.files import new_path


def positions(rows: DataFrame, order: Sequence[Column | str], out: str) -> DataFrame:
    """Adds out, the place of each row from 1 in the order of columns: rows are sorted by ranges and written to the shared folder with
    their place in the range, and a place is that and what the ranges before hold, one row a range. Rows that are equal in all columns
    of the order share a range: give it a last column that tells rows apart."""
    spark = rows.sparkSession
    path, at = new_path(spark, "ordered"), F.monotonically_increasing_id()
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_at", at).write.parquet(path)
    # the number's upper bits are the range's, the lower 33 count its rows
    sorted_ = spark.read.parquet(path).withColumns({"_range": F.shiftright("_at", 33), "_inside": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1})
    counts = sorted_.groupBy("_range").count()
    before = counts.select("_range", (F.sum("count").over(Window.partitionBy(F.lit(0)).orderBy("_range")) - F.col("count")).alias("_before"))  # a row a range
    return sorted_.join(F.broadcast(before), "_range").withColumn(out, F.col("_before") + F.col("_inside")).drop("_at", "_range", "_inside", "_before")
