"""Packing by cutting-stock column generation.

Documents become token ids (an end id last), cut at multiples of the sequence length; what remains of each is an item. The
histogram of items over length classes (lengths rounded up to `grain` tokens: a number of rows fixed by the sequence length)
goes to the driver, where a linear program over patterns is solved by a revised simplex; a knapsack dynamic program over the
duals prices new patterns until none can better the bound by more than `gap`. Patterns are rounded down. In Spark, items are
ranked within their class (counted by class and hash bucket, so that a class that holds a third of all rows is many tasks) and
the rank picks pattern, sequence and slot.

Rounding lengths up leaves some tokens free in every patterned sequence, the more the shorter its items are. Items that the patterns
leave over are strung together and cut to fill these rooms one after another; where there are too few, sequences of the worst-filled
patterns are given up for it. What is still left makes sequences of its own, cut where one is full; its tail is cut into powers of
two, which need no padding. Positions in the string are prefix sums by bucket, rooms and items meet by stretches of the string, and
only the texts of items in the string are encoded once more.

Defined cases: null and empty texts hold the end id alone; repeated rows and ids are packed each, also if all rows are equal (rows are
numbered once, in a written table); an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .tokens import VOCABULARY, encoder

PIECES = pa.schema([("row", pa.int64()), ("key", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])
PIECES_DDL = "row long, key long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
BUCKET_ROWS = 50_000
#: Tokens of the string of left-over items that one task fits into rooms.
STRETCH = 1 << 20


def ids_of(text: bytes | None, vocabulary: str, end: int) -> np.ndarray:
    return np.append(encoder(vocabulary).ids(text or b""), np.uint32(end)).astype("<u4", copy=False)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.tobytes())


def cut_documents(docs: DataFrame, size: int, vocabulary: str, end: int) -> DataFrame:
    """Pieces of `size` tokens and one shorter rest per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole):
                out = []
                for row, key, doc_id, text in zip(common.ids(batch, "row"), common.ids(batch, "key"), common.ids(batch), common.texts(batch), strict=True):
                    found = ids_of(text, vocabulary, end)
                    out += [(row, key, doc_id, i, len(found[i : i + size]), crc(found[i : i + size]), len(found)) for i in range(0, len(found), size)]
                yield common.as_batch(dict(zip(PIECES.names, map(list, zip(*out, strict=True)) if out else [[]] * 7, strict=True)), PIECES)

    return docs.mapInArrow(run, PIECES_DDL)


@dataclass(frozen=True)
class Plan:
    """How many sequences each pattern makes; patterns[p][c] is how many items of class c (1 to capacity) it takes."""

    patterns: np.ndarray
    sequences: np.ndarray

    def slots(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By class: from which rank on which first sequence and how many items a sequence hold; a last row ends the ranks."""
        first = np.concatenate([[0], np.cumsum(self.sequences)])
        out = []
        for c in range(self.patterns.shape[1]):
            used = np.flatnonzero((self.patterns[:, c] > 0) & (self.sequences > 0))
            upto = np.concatenate([[0], np.cumsum(self.patterns[used, c] * self.sequences[used])])
            out.append((upto, first[used], self.patterns[used, c]))
        return out


def knapsack(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern; values[c - 1] is the worth of an item of c units. Dynamic program over the capacity."""
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    useful = np.flatnonzero(values > 1e-12) + 1
    if not len(useful):
        return 0.0, np.zeros(capacity, np.int64)
    worth = values[useful - 1]
    for w in range(1, capacity + 1):
        fit = int(np.searchsorted(useful, w, "right"))
        best[w] = best[w - 1]
        if fit:
            got = best[w - useful[:fit]] + worth[:fit]
            k = int(got.argmax())
            if got[k] > best[w] + 1e-12:
                best[w], take[w] = got[k], useful[k]
    pattern, w = np.zeros(capacity, np.int64), capacity
    while w > 0:
        if take[w]:
            pattern[take[w] - 1] += 1
            w -= int(take[w])
        else:
            w -= 1
    return float(best[capacity]), pattern


def solve(demand: np.ndarray, gap: float = 0.003, rounds: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns and how often the linear program uses them; demand[c - 1] items of c units, capacity len(demand) units."""
    capacity, rows = len(demand), np.flatnonzero(demand)
    n, d = len(rows), demand[rows].astype(float)
    if not n:
        return np.zeros((0, capacity), np.int64), np.zeros(0)
    columns = np.zeros((n, capacity), np.int64)
    columns[np.arange(n), rows] = capacity // (rows + 1)
    basis, cost = np.diag(columns[np.arange(n), rows].astype(float)), np.ones(n)
    inverse = np.diag(1.0 / np.diag(basis))
    x = inverse @ d
    for i in range(rounds):
        if i % 100 == 99:
            inverse = np.linalg.inv(basis)
            x = inverse @ d
        duals = np.zeros(capacity)
        duals[rows] = cost @ inverse
        low = int(duals[rows].argmin())
        if duals[rows[low]] < -1e-9:  # an item too many is allowed: the surplus of this class enters, at no cost
            pattern, column, price = np.zeros(capacity, np.int64), -(np.arange(n) == low).astype(float), 0.0
        else:
            value, pattern = knapsack(duals, capacity)
            if value <= 1 + gap:
                break
            column, price = pattern[rows].astype(float), 1.0
        direction = inverse @ column
        ratios = np.where(direction > 1e-9, np.maximum(x, 0) / np.where(direction > 1e-9, direction, 1), np.inf)
        leave = int(ratios.argmin())
        if not np.isfinite(ratios[leave]):
            break
        x = x - ratios[leave] * direction
        x[leave] = ratios[leave]
        columns[leave], basis[:, leave], cost[leave] = pattern, column, price
        pivot = inverse[leave] / direction[leave]
        inverse = inverse - np.outer(direction, pivot)
        inverse[leave] = pivot
    used = cost > 0
    return columns[used], np.maximum(x[used], 0)


def plan(counts: dict[int, int], size: int, grain: int) -> Plan:
    """Whole numbers of sequences from the linear program, never more items of a class than there are, and so many that what is left
    over fills the rooms in them."""
    capacity = size // grain
    demand, tokens = np.zeros(capacity, np.int64), np.zeros(capacity)
    for length, times in counts.items():
        demand[-(-length // grain) - 1] += times
        tokens[-(-length // grain) - 1] += length * times
    patterns, x = solve(demand)
    mean = tokens / np.maximum(demand, 1)
    times = np.floor(x + 1e-6).astype(np.int64)
    filled = patterns @ mean / size if len(patterns) else np.zeros(0)
    for c in np.flatnonzero(demand):
        over = int((patterns[:, c] * times).sum() - demand[c]) if len(patterns) else 0
        for p in np.argsort(filled):
            if over > 0 and patterns[p, c] and times[p]:
                less = min(int(times[p]), -(-over // int(patterns[p, c])))
                times[p] -= less
                over -= less * int(patterns[p, c])
    # a sequence given up is a sequence's tokens more in the string, filled share and room together
    short = float((times * (1 - filled)).sum() * size - (tokens.sum() - (times * filled).sum() * size))
    for p in np.argsort(filled):
        less = min(int(times[p]), max(0, math.ceil(short / size)))
        times[p] -= less
        short -= less * size
    return Plan(patterns[times > 0], times[times > 0])


def bucketed(rows: DataFrame, buckets: int, by: list[str]) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int"))


def with_prefix(rows: DataFrame, keys: list[str], amount: F.Column, order: list[str], out: str) -> DataFrame:
    """Running sum of amount (this row left out) within keys, over hash buckets whose sums are added up first."""
    sums = rows.groupBy(*keys, "bucket").agg(F.sum(amount).alias("_sum"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*keys, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0))).join(before, [*keys, "bucket"]).withColumn(out, F.col("_before") + F.col("_inside")).drop("_before", "_inside", "bucket")


def cuts(position: int, length: int, total: int, size: int) -> list[tuple[int, int, int]]:
    """(sequence, offset there, length) of a stretch of the string of `total` tokens; the tail's sequences are powers of two."""
    out, end, whole = [], position + length, total // size * size
    while position < end:
        if position < whole:
            sequence, offset, room = position // size, position % size, size - position % size
        else:
            sequence, start, left = whole // size, whole, total - whole
            while True:
                power = 1 << (left.bit_length() - 1)
                if position < start + power:
                    break
                start, left, sequence = start + power, left - power, sequence + 1
            offset, room = position - start, start + power - position
        n = min(room, end - position)
        out.append((sequence, offset, n))
        position += n
    return out


def _fitted(stretch: int):
    """Meets rooms and items of a stretch of the string: pieces of items, as far as there are rooms."""

    def run(key: tuple, rooms: pa.Table, items: pa.Table) -> pa.Table:
        low = key[0].as_py() * stretch
        rooms, items = rooms.sort_by("from"), items.sort_by("position")
        column = lambda t, c: t.column(c).to_numpy()
        a, b = column(rooms, "from"), column(items, "position")
        edges = np.unique(np.concatenate([a, a + column(rooms, "room"), b, b + column(items, "length"), [low, low + stretch]]))
        edges = edges[(edges >= low) & (edges <= low + stretch)]
        start, n = edges[:-1], np.diff(edges)
        if len(a) and len(b):
            r, i = np.searchsorted(a, start, "right") - 1, np.searchsorted(b, start, "right") - 1
            ok = (r >= 0) & (i >= 0) & (start < (a + column(rooms, "room"))[r]) & (start < (b + column(items, "length"))[i])
            r, i, start, n = r[ok], i[ok], start[ok], n[ok]
        else:
            r = i = start = n = np.zeros(0, np.int64)
        out = {c: items.column(c).take(pa.array(i)) for c in ("row", "key", "doc_id", "start", "doc_tokens")}
        own = {"skip": start - b[i], "n": n, "sequence_id": column(rooms, "sequence_id")[r], "offset": column(rooms, "used")[r] + start - a[r]}
        return pa.table(out | {c: pa.array(v, pa.int64()) for c, v in own.items()})

    return run


def pack(docs: DataFrame, size: int = 4096, grain: int = 8, vocabulary: str = VOCABULARY, end: int = 2) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece; by_pattern: whether a pattern placed it."""
    spark = docs.sparkSession
    keyed = docs.select(F.xxhash64(F.col("doc_id").cast("long"), "text").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = common.written(cut_documents(keyed.withColumn("row", F.monotonically_increasing_id()), size, vocabulary, end), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    total = sum(counts.values())
    made = plan(counts, size, grain)
    slots, sequences = made.slots(), int(made.sequences.sum())
    buckets = max(1, -(-total // BUCKET_ROWS)) if total > BUCKET_ROWS else 4
    ranked = with_prefix(
        bucketed(pieces.withColumn("class", F.ceil(F.col("length") / grain).cast("int")), buckets, ["row", "start"]), ["class"], F.lit(1), ["row", "start"], "rank"
    )
    sent = spark.sparkContext.broadcast(slots)
    placed_schema = pa.schema([*PIECES, ("class", pa.int32()), ("sequence_id", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sequence by class and rank; none for what is left over."""
        for batch in batches:
            classes, ranks = batch.column("class").to_numpy(zero_copy_only=False), batch.column("rank").to_numpy(zero_copy_only=False)
            out = np.full(len(ranks), -1, np.int64)
            for c in np.unique(classes):
                upto, first, items = sent.value[c - 1]
                mine = np.flatnonzero((classes == c) & (ranks < upto[-1]))
                at = np.searchsorted(upto, ranks[mine], "right") - 1
                out[mine] = first[at] + (ranks[mine] - upto[at]) // items[at] if len(mine) else out[mine]
            columns = {n: batch.column(n) for n in [*PIECES.names, "class"]}
            yield common.as_batch(columns | {"sequence_id": pa.array(out, pa.int64(), mask=out < 0)}, placed_schema)

    placed = common.written(ranked.select(*PIECES.names, "class", "rank").mapInArrow(place, PIECES_DDL + ", class int, sequence_id long"), "placed")
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "row", "start").rowsBetween(Window.unboundedPreceding, -1)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    whole = placed.where("sequence_id is not null")
    patterned = whole.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).select(*columns, F.lit(True).alias("by_pattern"))

    left = placed.where("sequence_id is null").select(*PIECES.names)
    n, length = left.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    if not n:
        return patterned
    strung = common.written(with_prefix(bucketed(left, max(1, -(-n // BUCKET_ROWS)), ["row", "start"]).withColumn("all", F.lit(0)), ["all"], F.col("length"), ["row", "start"], "position").drop("all"), "strung")
    rooms = whole.groupBy("sequence_id").agg(F.sum("length").alias("used")).withColumn("room", F.lit(size) - F.col("used")).where("room > 0")
    rooms = common.written(with_prefix(bucketed(rooms.withColumn("all", F.lit(0)), max(1, -(-sequences // BUCKET_ROWS)), ["sequence_id"]), ["all"], F.col("room"), ["sequence_id"], "from").drop("all"), "rooms")
    room = rooms.agg(F.coalesce(F.sum("room"), F.lit(0))).first()[0]
    over = lambda rows, at, n: rows.withColumn("stretch", F.explode(F.sequence(F.floor(F.col(at) / STRETCH), F.floor((F.col(at) + F.col(n) - 1) / STRETCH))))
    item = "row long, key long, doc_id long, start long, doc_tokens long"
    fits = over(rooms, "from", "room").groupBy("stretch").cogroup(over(strung.where(F.col("position") < room), "position", "length").groupBy("stretch")).applyInArrow(_fitted(STRETCH), f"{item}, skip long, n long, sequence_id long, offset long")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What lies past the rooms, in sequences of its own."""
        names = [c.split()[0] for c in item.split(", ")]
        schema = pa.schema([(c, pa.int64()) for c in [*names, "skip", "n", "sequence_id", "offset"]])
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                skip = max(0, room - r["position"])
                for sequence, offset, k in cuts(r["position"] + skip - room, r["length"] - skip, length - room, size):
                    out.append((*(r[c] for c in names), skip, k, sequences + sequence, offset))
                    skip += k
            yield common.as_batch(dict(zip(schema.names, map(list, zip(*out, strict=True)) if out else [[]] * 9, strict=True)), schema)

    rest = strung.where(F.col("position") + F.col("length") > room).mapInArrow(own, f"{item}, skip long, n long, sequence_id long, offset long")
    names = [c.split()[0] for c in item.split(", ")]
    parts = fits.unionByName(rest).groupBy(*names).agg(F.collect_list(F.struct("skip", "n", "sequence_id", "offset")).alias("parts"))  # of one item
    same = F.col("a.key").eqNullSafe(F.col("b.key")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
    texts = keyed.alias("a").join(left.select("key", "doc_id").distinct().alias("b"), same, "left_semi").dropDuplicates(["key", "doc_id"])
    met = parts.alias("a").join(texts.alias("b"), same).select("a.doc_id", "a.start", "a.doc_tokens", "a.parts", "b.text")
    out_schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in columns[1:])])

    def recut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole):
                out = []
                for row, text in zip(batch.drop_columns(["text"]).to_pylist(), common.texts(batch), strict=True):
                    found = ids_of(text, vocabulary, end)
                    for p in row["parts"]:
                        at = row["start"] + p["skip"]
                        out.append((row["doc_id"], at, p["n"], crc(found[at : at + p["n"]]), row["doc_tokens"], p["sequence_id"], p["offset"]))
                yield common.as_batch(dict(zip(out_schema.names, map(list, zip(*out, strict=True)) if out else [[]] * 7, strict=True)), out_schema)

    return patterned.unionByName(met.mapInArrow(recut, ", ".join(f"{c} long" for c in columns)).withColumn("by_pattern", F.lit(False)))
