"""Keyed streams that are read in the order of event time, with state that a restart finds again.

Rows wait in a list state until the watermark has passed them, since none can come in before them after that; an event-time timer then
takes them in order of (time, tie) into a fold, whose value is state too. State is what waits within the allowed lateness, and the
fold's value, per key. Rows later than the watermark are dropped by Spark. Equal times and ties keep the order of their JSON text.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.weights import agreement_of
from ..operators import ordering
from ..sources.files import new_path

#: State stores that list and timer state need.
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

#: (value so far or None, row) -> (value, rows to emit); values and rows are what JSON can hold.
Fold = Callable[[Any, dict], tuple[Any, Sequence[Sequence[Any]]]]


class Ordered(StatefulProcessor):
    def __init__(self, fold: Fold, names: Sequence[str]) -> None:
        self.fold, self.names = fold, list(names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, tie long, body string")
        self.value = handle.getValueState("value", "body string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        fresh = [(r["_at"], r["_tie"], r["_body"]) for r in rows]
        self.waiting.appendList(fresh)
        self._wake(min(at for at, _, _ in fresh))
        return iter(())

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = list(self.waiting.get())
        ready, rest = sorted(tuple(r) for r in rows if r[0] <= passed), [tuple(r) for r in rows if r[0] > passed]
        if not ready:
            return
        value = json.loads(self.value.get()[0]) if self.value.exists() else None
        for _, _, body in ready:
            value, out = self.fold(value, json.loads(body))
            for values in out:
                yield Row(**dict(zip(self.names, [*key, *values], strict=True)))
        self.value.update((json.dumps(value),))
        if rest:
            self.waiting.put(rest)
            self._wake(min(at for at, _, _ in rest))
        else:
            self.waiting.clear()


def folded(stream: DataFrame, key: str, time: str, tie: str, fold: Fold, schema: str, late: str = "1 hour") -> DataFrame:
    """The rows that a fold emits as it meets each key's rows in order: key and the columns of schema (DDL). All of a row is its input,
    the time as text. Start it under ROCKS (see `feedback.drained`)."""
    kind = stream.schema[key].dataType.simpleString()
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    rows = timed.select(key, time, F.unix_micros(time).alias("_at"), F.col(tie).cast("long").alias("_tie"), F.to_json(F.struct(*[c for c in stream.columns if c != key])).alias("_body"))
    names = [key, *(c.split()[0] for c in schema.split(", "))]
    return rows.groupBy(key).transformWithState(Ordered(fold, names), f"{key} {kind}, {schema}", "Append", "EventTime")


class Alignment:
    """k, agreement, n_effective over the last `window` labels (propensity, ok), weights made anew for each."""

    SCHEMA = "k long, agreement double, n_effective double"

    def __init__(self, window: int = 20, max_ratio: float = 20.0) -> None:
        self.window, self.max_ratio = window, max_ratio

    def __call__(self, value: Any, row: dict) -> tuple[Any, list]:
        k, seen = value or (0, [])
        seen = [*seen, [row["propensity"], row["ok"]]][-self.window :]
        return (k + 1, seen), [(k + 1, *agreement_of(seen, self.max_ratio))]


class InFlight:
    """started, joined: a request that starts while none like it is in flight, and how many the one before it has served; a request is
    in flight for `hold` microseconds, and what comes in meanwhile waits for its answer."""

    SCHEMA = "event_id long, served long"

    def __init__(self, hold: int) -> None:
        self.hold = hold

    def __call__(self, value: Any, row: dict) -> tuple[Any, list]:
        until, served = value or (None, 0)
        if until is not None and row["at"] < until:
            return (until, served + 1), []
        return (row["at"] + self.hold, 1), [(row["event_id"], served)]


class Due:
    """label, step: the steps that fall due with a label, by how many labels they follow; `every` adds a refit each so many labels."""

    SCHEMA = "labels long, step string"

    def __init__(self, steps: Sequence[tuple[int, str]] = (), every: int = 0) -> None:
        self.steps, self.every = sorted(steps, key=lambda s: s[0]), every

    def __call__(self, value: Any, row: dict) -> tuple[Any, list]:
        n, cursor = value or (0, 0)
        n, out = n + 1, []
        while cursor < len(self.steps) and self.steps[cursor][0] <= n:
            out.append((n, self.steps[cursor][1]))
            cursor += 1
        if self.every and n % self.every == 0:
            out.append((n, "refit"))
        return (n, cursor), out


# -- the same for keys that are few and large: a batch's rows are placed by Spark, and no task sees a key whole --


def _state(spark: SparkSession, home: str, batch: int, name: str, schema: StructType) -> DataFrame:
    """What batches before this one have left, an empty table before the first."""
    try:
        return spark.read.schema(schema).parquet(f"{home}/state/batch={batch - 1}/{name}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def placed(stream: DataFrame, key: str, time: str, tie: str, emit: Callable[[DataFrame], DataFrame], late: str, label: str, window: int = 0, home: str | None = None) -> str:
    """Runs a stream over what is there and writes what `emit` makes of each batch's passed rows; the path of its output.

    A row has passed when it is `late` or more behind the latest that batches so far have shown, and nothing earlier can come in after
    that: rows behind what had passed before a batch are too late and dropped. Passed rows get `place`, their number from 1 within the
    key in the order of (time, tie), by ranges and their counts. With `window`, emit also sees the last window - 1 rows of each key that
    had passed before (`fresh` is false for these). State is a table a batch: rows that wait, rows that are still in a window, and a
    count a key. A batch that is run again finds the state of the one before it, and overwrites what it had begun."""
    spark, home = stream.sparkSession, home or new_path(stream.sparkSession, label)
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).select(key, F.unix_micros(time).alias("_when"), F.col(tie).cast("long").alias("_tie"), *[c for c in stream.columns if c not in (key, time)])
    told = StructType([*rows.schema.fields, StructField("place", LongType()), StructField("fresh", BooleanType())])
    ends = StructType([rows.schema[key], StructField("_count", LongType())])
    marks = StructType([StructField("_mark", LongType())])
    behind = F.expr(f"interval {late}")

    def step(batch: DataFrame, number: int) -> None:
        spark, at = batch.sparkSession, f"{home}/state/batch={number}"
        put = lambda df, name: df.write.mode("overwrite").parquet(f"{at}/{name}")
        before = _state(spark, home, number, "mark", marks).first()
        latest = batch.agg(F.unix_micros(F.timestamp_micros(F.max("_when")) - behind)).first()[0]
        old = before[0] if before else None
        mark = max((m for m in (old, latest) if m is not None), default=None)
        fresh = batch.where(F.lit(True) if old is None else F.col("_when") > old).unionByName(_state(spark, home, number, "waiting", rows.schema))
        passed = F.lit(False) if mark is None else F.col("_when") <= mark
        put(fresh.where(F.coalesce(~passed, F.lit(False))), "waiting")
        counts = _state(spark, home, number, "counts", ends)
        placed_ = ordering.positions(fresh.where(passed), [key, "_when", "_tie", *[c for c in rows.columns if c not in (key, "_when", "_tie") and rows.schema[c].dataType.typeName() not in ("map", "variant")]], "_p")
        # a key's rows are a stretch of the order: the place within it is that less the stretch's first
        firsts = placed_.groupBy(key).agg(F.min("_p").alias("_first"), F.count("*").alias("_new"))
        keys = firsts.join(counts, firsts[key].eqNullSafe(counts[key]), "full").select(F.coalesce(firsts[key], counts[key]).alias("_key"), "_first", (F.coalesce("_count", F.lit(0)) + F.coalesce("_new", F.lit(0))).alias("_count"), F.coalesce("_count", F.lit(0)).alias("_had"))
        keys.select(F.col("_key").alias(key), "_count").write.mode("overwrite").parquet(f"{at}/counts")
        own = keys.where("_first is not null")
        numbered = placed_.join(own, placed_[key].eqNullSafe(own["_key"])).withColumn("place", F.col("_p") - F.col("_first") + 1 + F.col("_had")).withColumn("fresh", F.lit(True)).select(*told.names)
        if window > 1:
            numbered = numbered.unionByName(_state(spark, home, number, "recent", told))
            numbered.write.mode("overwrite").parquet(f"{at}/numbered")
            numbered = spark.read.schema(told).parquet(f"{at}/numbered")
            last = numbered.join(keys, numbered[key].eqNullSafe(keys["_key"])).where(F.col("place") > F.col("_count") - (window - 1)).withColumn("fresh", F.lit(False))
            put(last.select(*told.names), "recent")
        emit(numbered).write.mode("overwrite").parquet(f"{home}/out/batch={number}")
        put(spark.createDataFrame([(mark,)] if mark is not None else [], marks), "mark")

    query = rows.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{home}/checkpoint").foreachBatch(step).start()
    query.awaitTermination()
    return f"{home}/out"


def swept(stream: DataFrame, key: str, time: str, tie: str, fold: Fold, schema: str, late: str, label: str, home: str | None = None) -> str:
    """Runs a stream over what is there, for keys that are many: what `folded` emits, from a sweep over each batch's passed rows; the path of
    its output (key and the columns of schema, DDL).

    Rows pass as in `placed`. They are dealt out by key and sorted by (key, time, tie), and a task folds them as they come by, one value at a
    time, so that a large key is never held. A key's value is a row before its next ones; values, and rows that wait, are tables a batch. The
    fold sees a row's other columns, but the time, which it sees as `at`, in microseconds."""
    spark, home = stream.sparkSession, home or new_path(stream.sparkSession, label)
    others = [c for c in stream.columns if c not in (key, time)]
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).select(key, F.unix_micros(time).alias("_when"), F.col(tie).cast("long").alias("_tie"), *others)
    told = StructType([rows.schema[key], StructField("_value", StringType())])
    marks, behind = StructType([StructField("_mark", LongType())]), F.expr(f"interval {late}")
    names = [c.split()[0] for c in schema.split(", ")]
    made = StructType([*told.fields, *StructType.fromDDL(schema).fields])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, last, value = to_arrow_schema(made), None, None
        columns: list[list] = [[] for _ in types]

        def put(k: tuple, body: str | None, values: Sequence[Any]) -> None:
            for column, x in zip(columns, (*k, body, *values), strict=True):
                column.append(x)

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, types, strict=True)], schema=types)
            for column in columns:
                column.clear()
            return out

        for batch in batches:
            given = [batch.column(c).to_pylist() for c in ("_when", "_value", *others)]
            for k, at, body, *values in zip(batch.column(key).to_pylist(), *given, strict=True):
                if (k,) != last:
                    if last is not None:
                        put(last, json.dumps(value), [None] * len(names))
                    last, value = (k,), None
                if at is None:  # what batches before have left
                    value = json.loads(body)
                    continue
                value, out = fold(value, {**dict(zip(others, values, strict=True)), "at": at})
                for x in out:
                    put(last, None, x)
            if len(columns[0]) > 10_000:
                yield flushed()
        if last is not None:
            put(last, json.dumps(value), [None] * len(names))
        yield flushed()

    def step(batch: DataFrame, number: int) -> None:
        spark, at = batch.sparkSession, f"{home}/state/batch={number}"
        put = lambda df, name: df.write.mode("overwrite").parquet(f"{at}/{name}")
        before = _state(spark, home, number, "mark", marks).first()
        latest = batch.agg(F.unix_micros(F.timestamp_micros(F.max("_when")) - behind)).first()[0]
        old = before[0] if before else None
        mark = max((m for m in (old, latest) if m is not None), default=None)
        fresh = batch.where(F.lit(True) if old is None else F.col("_when") > old).unionByName(_state(spark, home, number, "waiting", rows.schema))
        passed = F.lit(False) if mark is None else F.col("_when") <= mark
        put(fresh.where(F.coalesce(~passed, F.lit(False))), "waiting")
        given = fresh.where(passed).unionByName(_state(spark, home, number, "swept", made).where("_value is not null").select(key, "_value"), allowMissingColumns=True)
        place = [F.asc_nulls_first(c) for c in (key, "_when", "_tie", *[c for c in others if rows.schema[c].dataType.typeName() not in ("map", "variant")])]
        put(given.repartition(key).sortWithinPartitions(*place).mapInArrow(sweep, made), "swept")
        spark.read.schema(made).parquet(f"{at}/swept").where("_value is null").drop("_value").write.mode("overwrite").parquet(f"{home}/out/batch={number}")
        put(spark.createDataFrame([(mark,)] if mark is not None else [], marks), "mark")

    query = rows.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{home}/checkpoint").foreachBatch(step).start()
    query.awaitTermination()
    return f"{home}/out"


def aligned(rows: DataFrame, key: str, window: int = 20, max_ratio: float = 20.0, block: int = 5000) -> DataFrame:
    """key, k, agreement, n_effective of fresh rows (propensity, ok, place), each over the last `window` labels: what Alignment folds. A key's
    places are cut into blocks that begin with the window - 1 rows before them, so that a large key is many windows."""
    at = F.floor((F.col("place") - 1) / block)
    spread = F.explode(F.array_distinct(F.array(at, F.floor((F.col("place") + window - 2) / block)))).alias("_block")
    near = Window.partitionBy(key, "_block").orderBy("place").rowsBetween(1 - window, 0)
    seen = rows.select(key, "place", "fresh", (1 / F.col("propensity")).alias("_raw"), F.col("ok").cast("double").alias("_ok"), spread).withColumn("_seen", F.collect_list(F.struct("_raw", "_ok")).over(near))
    own = seen.where(F.col("fresh") & (F.col("_block") == at))
    middle = F.get(F.array_sort(F.transform("_seen", lambda x: x["_raw"])), F.floor(F.size("_seen") / 2).cast("int"))
    capped = own.withColumn("_cap", max_ratio * middle).withColumn("_w", F.transform("_seen", lambda x: F.struct(F.least(x["_raw"], F.col("_cap")).alias("w"), x["_ok"].alias("ok"))))
    total = lambda f: F.aggregate("_w", F.lit(0.0), lambda a, x: a + f(x))
    return capped.select(key, F.col("place").alias("k"), (total(lambda x: x["w"] * x["ok"]) / total(lambda x: x["w"])).alias("agreement"), (total(lambda x: x["w"]) * total(lambda x: x["w"]) / total(lambda x: x["w"] * x["w"])).alias("n_effective"))


def due(rows: DataFrame, key: str, steps: Sequence[tuple[int, str]] = (), every: int = 0) -> DataFrame:
    """key, labels, step of rows that have a place: what Due folds."""
    fall = [F.when(F.col("place") == max(1, after), F.lit(step)) for after, step in sorted(steps, key=lambda s: s[0])]
    fall += [F.when(F.col("place") % every == 0, F.lit("refit"))] if every else []
    return rows.select(key, F.col("place").alias("labels"), F.explode(F.array_compact(F.array(*fall))).alias("step"))
