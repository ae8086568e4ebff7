"""Helpers that every operator here shares: the shared folder, written tables, text as bytes."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
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


#: Spark removes the shuffle files of a query once it has ended; off by default, when they stay until the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: How much text Spark hands to a worker process at a time, which holds some copies of it: by default 10,000 rows or 64 MB.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors. The shuffles behind it are done with."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    was = spark.conf.get(CLEANUP, "false"), spark.conf.get(BATCH)
    spark.conf.set(CLEANUP, "true")
    spark.conf.set(BATCH, BATCH_BYTES)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, was[0])
        spark.conf.set(BATCH, was[1])
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    MADE.append((spark, path))
    return out


#: Folders that `written` has made and nobody has deleted.
MADE: list[tuple[SparkSession, str]] = []


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(spark: SparkSession, rows: int, each: int = 20_000) -> int:
    """Partitions for a table of `rows` rows: one for `each` of them, but as many as the cluster has cores, and no more than a shuffle
    has. Small tables would otherwise be as many files as there are shuffle partitions: each costs requests to the store, and on a local
    one the JVM starts processes to set its mode, which for a moment count with all of the JVM's memory."""
    return min(shuffle_partitions(spark), max(spark.sparkContext.defaultParallelism, -(-rows // each)))


def key_fold(column: str, modulus: int) -> F.Column:
    """crc32 of the id as text, modulo modulus; null ids count as the text '' would."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def fold_of(doc_id: int | None, modulus: int) -> int:
    """The same on one id, for use inside tasks."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    """A string column as UTF-8 bytes without decoding."""
    values = batch.column(batch.schema.get_field_index(column))
    return values.cast(pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary()).to_pylist()


def ids(batch: pa.RecordBatch, column: str = "doc_id") -> list[int | None]:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def as_batch(columns: dict[str, list | pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that no piece holds much more than `most` bytes of text (one text at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What a worker process has learnt about tokens, by operator.
CACHES: list[dict] = []


def alone(cache: dict | None = None) -> None:
    """Empties the other operators' caches: a worker process lives on from stage to stage, and needs those of its present one alone."""
    for other in CACHES:
        if other is not cache:
            other.clear()
    if cache is not None and all(other is not cache for other in CACHES):
        CACHES.append(cache)
    release()


def release() -> None:
    """Gives back what Arrow and the C library keep of memory that is no longer used: a worker process lives on between tasks."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key in turn, from a partition sorted by the keys; only one group is held at a time."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        columns = [batch.column(k) for k in keys]
        n = batch.num_rows
        if not n:
            continue
        differs = [False] * (n - 1)
        for c in columns:
            for i, x in enumerate(pc.fill_null(pc.not_equal(c.slice(0, n - 1), c.slice(1)), True).to_pylist()):
                differs[i] = differs[i] or x
        starts = [0, *(i + 1 for i, x in enumerate(differs) if x), n]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            key = tuple(c[a].as_py() for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that `written` made, once nothing that is still to be computed reads them."""
    for df in tables:
        path = getattr(df, "_written_to", None) if df is not None else None
        if path:
            delete(df.sparkSession, path)
            MADE[:] = [m for m in MADE if m[1] != path]


def forest(edges: list[tuple[bytes, bytes]]) -> list[tuple[bytes, bytes]]:
    """As few edges that connect the same nodes: each node to the smallest that it is connected with."""
    parent: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        at = x
        while (p := parent.get(at, at)) != at:
            at = p
        while (p := parent.get(x, x)) != at:
            parent[x], x = at, p
        return at

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(root(x), x) for x in list(parent) if root(x) != x]


def _forests(batches: Iterator[pa.RecordBatch], most: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of a partition as forests of some of them at a time."""
    as_batch = lambda held: pa.RecordBatch.from_arrays([pa.array([u for u, _ in held], pa.binary()), pa.array([v for _, v in held], pa.binary())], ["u", "v"])
    held: list[tuple[bytes, bytes]] = []
    for batch in batches:
        held += zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True)
        if len(held) > most:
            held = forest(held)
            if len(held) > most // 2:
                yield as_batch(held)
                held = []
    yield as_batch(forest(held))
    release()


def components(edges: DataFrame, a: str = "a", b: str = "b", parts: int | None = None) -> DataFrame:
    """node, label: the smallest node of its connected component; nodes are binary.

    Edges are dealt out to `parts` partitions, each of which becomes a forest first. Then, round by round, every node takes the smallest of its neighbours and itself, and
    that one's too; edges between nodes that have taken the same are gone, and the others connect what their ends have taken. So edges
    get fewer fast, and a round costs what is left of them. Nodes' labels follow by a join a round. All is written to the shared folder,
    and deleted when it is done with.
    """
    spark = edges.sparkSession
    dealt = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").repartition(parts or shuffle_partitions(spark))
    left = written(dealt.mapInArrow(_forests, "u binary, v binary"), "edges")
    labels = all_parts = None
    while n := left.count():
        parts = parts_for(spark, 2 * n)  # there are no more nodes
        all_parts = all_parts or parts
        ends = left.select("u", "v").union(left.select(F.col("v"), F.col("u"))).toDF("u", "v")
        near = written(ends.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("to")).coalesce(parts), "near")
        jump = near.select(F.col("node").alias("to"), F.col("to").alias("further"))
        taken = written(near.join(jump, "to", "left").select("node", F.least("to", F.coalesce("further", "to")).alias("to")).coalesce(parts), "taken")
        as_ = lambda old, new: taken.select(F.col("node").alias(old), F.col("to").alias(new))
        moved = left.join(as_("u", "x"), "u").join(as_("v", "y"), "v").where("x <> y").select(F.col("x").alias("u"), F.col("y").alias("v"))
        after = written(moved.coalesce(parts).mapInArrow(_forests, "u binary, v binary"), "edges")
        # what this round has taken in stays a node for the rounds to come
        named = taken.select("node", F.col("to").alias("label")) if labels is None else labels.join(as_("label", "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        named = written(named.coalesce(all_parts), "labels")
        discard(left, near, taken, labels)
        left, labels = after, named
    if labels is None:
        return left.select(F.col("u").alias("node"), F.col("v").alias("label"))
    discard(left)
    return labels


def count_class(times: str) -> F.Column:
    """Classes of counts, 16 a power of two: some hundreds, whatever the counts are."""
    return F.floor(F.log2(F.col(times).cast("double")) * 16).cast("int")


def head_class(counts: DataFrame, word: str, times: str, budget: int, each: int = 100) -> tuple[int, int]:
    """The least class of counts from which on all words together fit `budget` bytes, at `each` bytes a word and those of the word
    itself; and how many words there are below it. The driver sees a sum per class."""
    sums = counts.groupBy(count_class(times).alias("c")).agg(F.sum(F.octet_length(word) + each).alias("size"), F.count("*").alias("n")).collect()
    least, left, below = max((r["c"] for r in sums), default=0) + 1, budget, sum(r["n"] for r in sums)
    for r in sorted(sums, key=lambda r: -r["c"]):
        if r["size"] > left:
            break
        least, left, below = r["c"], left - r["size"], below - r["n"]
    return least, below
