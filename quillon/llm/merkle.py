"""Merkle manifest of a dataset: a digest per row, one per source and one of all, and for every row the path that proves it.

A row's leaf is the sha256 of its fields. The leaves of a source ascend by id; every 16 consecutive nodes (the last run: fewer, even
one) become their parent until one is left, the subroot. Subroots, ordered by source (null first, then by UTF-8 bytes), become the root
alike. Digests are hashed as lower-case hex text.

How it scales: rows are dealt out by ranges of (source, id, leaf), so that a source with a third of all rows is many tasks, and get their
place in the source from counts of the ranges. 4,096 consecutive nodes form an aligned block, whose root a stack of unfinished runs
yields as the nodes pass by; the blocks' roots are the nodes of the level above, a 4,096th of them. On the way back each block gets the
path above it once and walks its leaves: for every level a treehash stack makes the next run of 16 while the current one is in use, one
leaf a step, so that the walk holds 2 x 16 nodes a level. No task holds more than a block, and the driver sees no row.

Defined cases: a null field is `-`; rows without an id come first; rows with one id stand in the order of their digests, and equal rows
are leaves of their own; a null text is not the empty one; an empty table gives no rows; other columns don't count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import key_fold, shuffle_partitions, written

FAN, LEVELS = 16, 3
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<place:int,siblings:string>>"


def parent(run: Sequence[str]) -> str:
    return hashlib.sha256("".join(run).encode()).hexdigest()


def depth_of(n: int, block: int) -> int:
    """Levels from the n leaves of a block up to its root: as many as they need if the block is its tree's only one, else all."""
    if block or n == BLOCK:
        return LEVELS
    depth = 0
    while FAN**depth < n:
        depth += 1
    return depth


class Treehash:
    """Unfinished runs, one a level: nodes come in from the left, full runs become a node of the level above, up to `top`."""

    def __init__(self, top: int = LEVELS) -> None:
        self.top, self.runs = top, [[] for _ in range(top + 1)]

    def add(self, node: str) -> None:
        for level in range(self.top):
            self.runs[level].append(node)
            if len(self.runs[level]) < FAN:
                return
            node = parent(self.runs[level])
            self.runs[level] = []
        self.runs[self.top].append(node)

    def close(self, depth: int) -> list[str]:
        """The nodes at a level once no more leaves come."""
        for level in range(depth):
            if self.runs[level]:
                self.runs[level + 1].append(parent(self.runs[level]))
                self.runs[level] = []
        return self.runs[depth]


class Ahead:
    """Makes a run of nodes at a level from the leaves below it, one leaf a step."""

    def __init__(self, leaves: Sequence[str], level: int, run: int) -> None:
        self.leaves, self.level, self.hash = leaves, level, Treehash(level)
        self.at, self.end = run * FAN ** (level + 1), min(len(leaves), (run + 1) * FAN ** (level + 1))

    def step(self) -> None:
        if self.at < self.end:
            self.hash.add(self.leaves[self.at])
            self.at += 1

    def run(self) -> list[str]:
        while self.at < self.end:
            self.step()
        return self.hash.close(self.level)


def walk(leaves: Sequence[str], depth: int) -> Iterator[list[tuple[int, str]]]:
    """For every leaf its place and siblings at each level up to the block's root."""
    now = [Ahead(leaves, level, 0).run() for level in range(depth)]
    ahead = [Ahead(leaves, level, 1) for level in range(depth)]
    steps: list[tuple[int, str]] = [(0, "")] * depth
    for i in range(len(leaves)):
        for level in range(depth):
            width = FAN**level
            if i % width == 0:
                if i and i % (width * FAN) == 0:
                    now[level] = ahead[level].run()
                    ahead[level] = Ahead(leaves, level, i // (width * FAN) + 1)
                place = i // width % FAN
                steps[level] = (place, "".join(now[level][:place] + now[level][place + 1 :]))
            ahead[level].step()
        yield steps.copy()


def _hex(column: pa.Array) -> list[str]:
    return [x.hex() for x in column.to_pylist()]


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks pass by in order; only the stack of the current one is held."""
    key, n, stack = None, 0, Treehash()

    def closed() -> tuple[str, int, bytes]:
        return key[0], key[1], bytes.fromhex(stack.close(depth_of(n, key[1]))[0])

    def batch(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.binary()), strict=True)], ["tree", "pos", "digest"])

    for b in batches:
        done = []
        for tree, block, digest in zip(b.column("tree").to_pylist(), b.column("block").to_pylist(), _hex(b.column("digest")), strict=True):
            if key != (tree, block):
                if key:
                    done.append(closed())
                key, n, stack = (tree, block), 0, Treehash()
            stack.add(digest)
            n += 1
        if done:
            yield batch(done)
    if key:
        yield batch([closed()])


def _authenticate(key: tuple, nodes: pa.Table, above: pa.Table) -> pa.Table:
    """The nodes of a block with their paths up to the root of all; own columns of theirs stay."""
    nodes = nodes.sort_by("pos")
    block = key[1].as_py()
    higher = above.column("path")[0].as_py()
    places, siblings, offsets = [], [], [0]
    for steps in walk(_hex(nodes.column("digest")), depth_of(len(nodes), block)):
        for place, others in steps:
            places.append(place)
            siblings.append(others)
        for x in higher:
            places.append(x["place"])
            siblings.append(x["siblings"])
        offsets.append(len(places))
    step = pa.StructArray.from_arrays([pa.array(places, pa.int32()), pa.array(siblings, pa.string())], ["place", "siblings"])
    nodes = nodes.append_column("path", pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), step))
    for c in ("subroot", "root"):
        nodes = nodes.append_column(c, pa.array([above.column(c)[0].as_py()] * len(nodes), pa.binary()))
    return nodes


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Adds pos, the place of a node in its tree: ranges of (tree, order), sorted each, and counts of what lies before a range."""
    keys = ["tree", *order]
    ranged = written(nodes.repartitionByRange(shuffle_partitions(nodes.sparkSession), *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), "ranged")
    ranged = ranged.withColumn("part", F.shiftright("at", 33))
    runs = ranged.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("tree").orderBy("part")) - F.col("n")
    return ranged.join(runs.select("tree", "part", (before - F.col("first")).alias("shift")), ["tree", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("long"))


def levels_of(nodes: DataFrame) -> list[DataFrame]:
    """The nodes (tree, pos, digest), the roots of their blocks, the roots of those blocks' blocks, until every tree is one node."""
    levels = [nodes]
    while True:
        dealt = _blocks(levels[-1]).select("tree", "block", "pos", "digest").repartition(shuffle_partitions(nodes.sparkSession), "tree", "block").sortWithinPartitions("tree", "block", "pos")
        levels.append(written(dealt.mapInArrow(_roots, "tree string, pos long, digest binary"), "roots"))
        if not levels[-1].where("pos > 0").limit(1).count():
            return levels


def authenticated(levels: list[DataFrame], above: DataFrame, own: str) -> DataFrame:
    """The lowest nodes with their paths: down from above (tree, pos, path, subroot, root of each tree's last node), level by level.
    own: columns of the lowest nodes, as DDL."""
    for i, nodes in reversed(list(enumerate(levels[:-1]))):
        kept = own if i == 0 else "tree string, pos long, digest binary"
        nodes = _blocks(nodes).select(*[c.split()[0] for c in kept.split(", ")], "block")
        pairs = nodes.groupBy("tree", "block").cogroup(above.withColumnRenamed("pos", "block").groupBy("tree", "block"))
        above = pairs.applyInArrow(_authenticate, f"{kept}, block long, path {PATH}, subroot binary, root binary").drop("block")
        above = written(above, "paths") if i else above
    return above


def _leaf(values: Mapping[str, Column]) -> Column:
    """sha256 of the fields: `-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = {f: v.cast("string") for f, v in values.items()}
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in text.values()]), 256))


def manifest(docs: DataFrame, key: str = "doc_id", tree: str = "source", fields: Sequence[str] = FIELDS, claimed: Mapping[str, Column] | None = None) -> DataFrame:
    """doc_id, source, leaf, claim, subroot, root (binary) and path, an array of (place in the run, the siblings' digests as one hex text)
    from the leaf to the root. claim: the leaf that a row would have if the `claimed` fields had these values, null where one of them is."""
    leaf = _leaf({f: F.col(f) for f in fields})
    claim = F.lit(None).cast("binary")
    if claimed:
        claim = F.when(~sum((c.isNull().cast("int") for c in claimed.values()), F.lit(0)).cast("boolean"), _leaf({f: claimed.get(f, F.col(f)) for f in fields}))
    # null first, then by bytes: a mark that sorts so goes before the name
    rows = docs.select(F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit("-")).alias("tree"), F.col(key).cast("long").alias("doc_id"), leaf.alias("digest"), claim.alias("claim"))
    leaves = written(placed(written(rows, "leaves"), ["doc_id", "digest"]), "placed")
    trees = levels_of(leaves)
    subroots = placed(trees[-1].select(F.lit("").alias("tree"), F.col("tree").alias("member"), "digest"), ["member"])
    top = levels_of(written(subroots, "subroots"))
    root = top[-1].select("tree", "pos", F.array().cast(PATH).alias("path"), F.lit(None).cast("binary").alias("subroot"), F.col("digest").alias("root"))
    sources = authenticated(top, root, "tree string, member string, pos long, digest binary")
    above = written(sources.select(F.col("member").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"), "root"), "sources")
    found = authenticated(trees, above, "tree string, pos long, doc_id long, digest binary, claim binary")
    return found.select("doc_id", F.when(F.col("tree") != "-", F.substring("tree", 2, 2**31 - 1)).alias("source"), F.col("digest").alias("leaf"), "claim", "subroot", "root", "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path lead to, as hex text."""
    step = lambda node, s: F.sha2(F.concat(F.substr(s["siblings"], F.lit(1), s["place"] * 64), node, F.substr(s["siblings"], s["place"] * 64 + 1)), 256)
    return F.aggregate(path, F.lower(F.hex(leaf)), step)


def verified(docs: DataFrame, altered: Callable[[str], Column], every: int = 5) -> DataFrame:
    """The manifest with the root recomputed from every row's path, after tampering with the text of the rows whose id has a crc32 that
    `every` divides (rows without an id count as the empty text)."""
    hit = key_fold("doc_id", every) == 0
    rows = manifest(docs, claimed={"text": F.when(hit, altered("text"))})
    text = lambda c: F.lower(F.hex(c))
    proof = F.sha2(F.array_join(F.transform("path", lambda s: s["siblings"]), ""), 256)
    out = rows.select("doc_id", text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"), proof.alias("proof_sha256"), folded(F.coalesce("claim", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
