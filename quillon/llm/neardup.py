"""Near duplicates by a signature-coordinate inverted join, confirmed on full shingle sets.

1. Each text's distinct k-word shingles (64-bit hashes) give a signature of `coordinates` minhashes. Equal sets collapse
   into one node, so that groups of copies cost one row.
2. Nodes are posted under each (coordinate, value) pair. Pairs of similarity `threshold` agree on fewer than `matches`
   coordinates with a probability below 1e-9 a pair, so agreement on `matches` is asked for. Prefix: a node skips
   its matches - 1 most frequent postings, since two nodes that agree on `matches` still meet under another.
3. Within a posting list collisions are counted against one hub after another; those with enough go with the hub, and two hubs'
   groups are tied by one pair with enough. Lists over `hot` nodes are split by each node's other postings first; there only the
   matches - 2 most frequent are skipped, so that two nodes that agree on `matches` share a second one besides the list's own,
   and no pair is lost. What comes out are a few edges per node, never all pairs.
4. The edges' components are families: every pair to confirm lies within one. Families of at most `block` nodes are compared
   exactly, as a whole. In larger ones all are compared with a hub; those not linked to it are compared, block by block,
   with all. Only links that join two components of a block are emitted.
5. The links' components are the result.

Defined cases: null and empty texts have no shingles and are linked with nothing; a text of fewer than k words has one shingle;
rows without an id get no component and are not kept; repeated ids count as documents of their own, each row keeping the
smallest id of its component; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .tokens import Generations

MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
COORDINATES, MATCHES = 32, 10
SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.binary()), ("signature", pa.binary())])
SIGNED_DDL = "doc_id long, n_shingles long, node binary, signature binary"


class WordHashes(Generations):
    def __init__(self):
        super().__init__(most=50_000)

    def made(self, word: bytes) -> int:
        return xxhash.xxh3_64_intdigest(word)


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        for shift, by in ((30, MIX[1]), (27, MIX[2]), (31, None)):
            more = x >> np.uint64(shift)
            more ^= x
            if by is not None:
                more *= by
            x = more
    return x


def shingles(text: bytes | None, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; A-Z lower-cased; a shorter text is one shingle."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(k, len(words))
    with np.errstate(over="ignore"):
        out = h[: len(h) - n + 1] + np.uint64(n)
        for j in range(1, n):
            out = mixed(out) + h[j : len(h) - n + 1 + j]
    return np.unique(mixed(out))


def signature(found: np.ndarray, coordinates: int) -> bytes:
    """The least value of each of `coordinates` hash functions, four bytes each."""
    with np.errstate(over="ignore"):
        odd = mixed(np.arange(1, coordinates + 1, dtype=np.uint64) * MIX[0]) | np.uint64(1)
        return np.array([((found * m) >> np.uint64(32)).min() for m in odd], np.uint64).astype(np.uint32).tobytes()


def sign(docs: DataFrame, k: int, coordinates: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone()
        hashes = WordHashes()
        for whole in batches:
            for batch in common.slices(whole):
                sets = [shingles(t, k, hashes) for t in common.texts(batch)]
                yield common.as_batch({"doc_id": common.ids(batch), "n_shingles": list(map(len, sets)), "node": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], "signature": [signature(s, coordinates) if len(s) else None for s in sets]}, SIGNED)

    return docs.mapInArrow(run, SIGNED_DDL)


EDGE = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def tie(signatures: np.ndarray, matches: int) -> list[tuple[int, int]]:
    """Edges that connect all members with at least `matches` equal coordinates, a few for each member."""
    left, clusters, edges = np.arange(len(signatures)), [], []
    while len(left):
        hub, rest = left[0], left[1:]
        near = (signatures[rest] == signatures[hub]).sum(1) >= matches
        edges += [(int(hub), int(x)) for x in rest[near]]
        clusters.append(np.append(hub, rest[near]))
        left = rest[~near]
    # pairs across clusters: one tie for two clusters is enough
    owner = np.empty(len(signatures), np.int64)
    for i, c in enumerate(clusters):
        owner[c] = i
    tied: set[tuple[int, int]] = set()
    if len(clusters) > 1:
        for x in range(len(signatures)):
            later = np.arange(x + 1, len(signatures))
            later = later[owner[later] != owner[x]]
            for y in later[(signatures[later] == signatures[x]).sum(1) >= matches]:
                pair = tuple(sorted((int(owner[x]), int(owner[y]))))
                if pair not in tied:
                    tied.add(pair)
                    edges.append((x, int(y)))
    return edges


def candidates(nodes: DataFrame, coordinates: int, matches: int, hot: int, files: int) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) between nodes of the same families, and the table that they are made from."""
    at = F.col("coordinate")
    posted = nodes.select("node", "signature", F.explode(F.sequence(F.lit(0), F.lit(coordinates - 1))).alias("coordinate")).select("node", F.xxhash64(at, F.substring("signature", at * 4 + 1, F.lit(4))).alias("key"))
    often = posted.groupBy("key").agg(F.count("*").alias("often")).where("often > 1")
    rarest = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("often"), "key"))
    met = posted.join(often, "key").withColumn("rank", rarest)
    ranked = common.written(met.where(F.col("rank") >= matches - 1).select("node", "key", "often", "rank").coalesce(files), "postings")
    kept = ranked.where(F.col("rank") >= matches)
    lists = kept.where(F.col("often") <= hot).select("node", "key", F.lit(0).cast("long").alias("second"))
    other = ranked.select("node", F.col("key").alias("second"))
    split = kept.where(F.col("often") > hot).select("node", "key").join(other, "node").where("key <> second")
    rows = lists.unionByName(split.select("node", "key", "second")).join(nodes.select("node", "signature"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[bytes, bytes]] = []
        for group in common.groups(batches, ["key", "second"]):
            if group.num_rows > 1:
                names = group.column("node").to_pylist()
                values = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint32).reshape(-1, coordinates)
                out += [(names[i], names[j]) for i, j in tie(values, matches)]
            if len(out) > 50_000:
                out = common.forest(out)
                if len(out) > 25_000:  # what a task holds stays as small as it was
                    yield common.as_batch({"a": [a for a, _ in out], "b": [b for _, b in out]}, EDGE)
                    out = []
        out = common.forest(out)
        yield common.as_batch({"a": [a for a, _ in out], "b": [b for _, b in out]}, EDGE)
        common.release()

    return rows.repartition(common.shuffle_partitions(nodes.sparkSession), "key", "second").sortWithinPartitions("key", "second", "node").mapInArrow(run, "a binary, b binary"), ranked


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def links(sets: list[np.ndarray], percent: int, first: int | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets; with `first`, only links of the first `first` sets with any."""
    n, sizes = len(sets), np.array(list(map(len, sets)))
    values, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    of = np.repeat(np.arange(n), sizes)
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    # shared shingles only; intersections of a block of sets with all come from one sparse count
    keep = times[at] > 1
    rows, cols = of[keep], at[keep]
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    starts = np.flatnonzero(np.r_[True, cols[1:] != cols[:-1]]) if len(cols) else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], len(cols)]
    both = np.zeros((n if first is None else first, n), np.int32)
    for a, b in zip(starts, ends, strict=True):
        members = rows[a:b]
        left = members if first is None else members[members < first]
        if len(left):
            both[np.ix_(left, members)] += 1
    union = sizes[: len(both), None] + sizes[None, :] - both
    out = []
    for i, j in zip(*np.nonzero(100 * both >= percent * union), strict=True):
        if i != j and (x := root(int(i))) != (y := root(int(j))):
            parent[max(x, y)] = min(x, y)
            out.append((int(i), int(j)))
    return out


def confirm(docs: DataFrame, members: DataFrame, k: int, percent: int, block: int, count: int) -> DataFrame:
    """Links (a, b) between nodes of a family that are similar on full sets. members: node, doc_id, family, size; `count` at most."""
    spark = docs.sparkSession
    parts = common.shuffle_partitions(docs.sparkSession)
    schema = pa.schema([("family", pa.binary()), ("size", pa.int64()), ("node", pa.binary()), ("shingles", pa.binary())])

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for batch in common.slices(whole):
                sets = [shingles(t, k, hashes) for t in common.texts(batch)]
                nodes = common.ids(batch, "node")
                right = [i for i, s in enumerate(sets) if xxhash.xxh3_128_digest(s.tobytes()) == nodes[i]]
                columns = {c: [common.ids(batch, c)[i] for i in right] for c in ("family", "size", "node")}
                yield common.as_batch(columns | {"shingles": [sets[i].tobytes() for i in right]}, schema)

    texts = docs.join(members, "doc_id").select("family", "size", "node", "text")
    sets = common.written(texts.where(F.col("size") > block).mapInArrow(resolve, "family binary, size long, node binary, shingles binary").dropDuplicates(["node"]).coalesce(common.parts_for(spark, count, 2000)), "shingle-sets")

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Families of texts that one task holds: their sets are made there, and go nowhere."""
        hashes = WordHashes()
        for group in common.groups(batches, ["family"]):
            by_node = {}
            for node, text in zip(group.column("node").to_pylist(), group.column("text").cast(pa.binary()).to_pylist(), strict=True):
                found = shingles(text, k, hashes) if node not in by_node else None
                if found is not None and xxhash.xxh3_128_digest(found.tobytes()) == node:  # of rows with one id, the one that is meant
                    by_node[node] = found
            names = list(by_node)
            edges = links(list(by_node.values()), percent) if len(names) > 1 else []
            yield common.as_batch({"a": [names[i] for i, _ in edges], "b": [names[j] for _, j in edges]}, EDGE)
        common.release()

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in common.groups(batches, ["family", "one", "two"]):
            names = group.column("node").to_pylist()
            found = [np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()]
            edges = links(found, percent, sum(group.column("side").to_pylist())) if len(found) > 1 else []
            yield common.as_batch({"a": [names[i] for i, _ in edges], "b": [names[j] for _, j in edges]}, EDGE)

    small = texts.where(F.col("size") <= block).select("family", "node", "text").repartition(parts, "family").sortWithinPartitions("family", "node").mapInArrow(within, "a binary, b binary")
    large = sets
    hubs = large.groupBy("family").agg(F.min_by(F.struct("node", "shingles"), "node").alias("hub"))

    def against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([*schema, ("hub", pa.binary()), ("linked", pa.bool_())])
        for batch in batches:
            pairs = zip(common.texts(batch, "shingles"), common.texts(batch, "hub_shingles"), strict=True)
            linked = [similar(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent) for a, b in pairs]
            yield common.as_batch({c: batch.column(c) for c in [*schema.names, "hub"]} | {"linked": linked}, out)

    tried = common.written(
        large.join(hubs.select("family", F.col("hub.node").alias("hub"), F.col("hub.shingles").alias("hub_shingles")), "family").select(*schema.names, "hub", "hub_shingles").mapInArrow(against, "family binary, size long, node binary, shingles binary, hub binary, linked boolean"), "hub-links"
    )
    starred = tried.where("linked and node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    # those not linked to the hub, in blocks, against all, in blocks; blocks by hash, so their sizes are near `block`
    counts = tried.groupBy("family").agg(F.ceil(F.count_if(~F.col("linked")) / block).cast("int").alias("ones"), F.ceil(F.count("*") / block).cast("int").alias("twos")).where("ones > 0")
    placed = tried.select("family", "node", "shingles", "linked").join(counts, "family").withColumns({"one": F.pmod(F.xxhash64("node"), F.col("ones")).cast("int"), "two": F.pmod(F.xxhash64("node", F.lit(1)), F.col("twos")).cast("int")})
    lone = placed.where(~F.col("linked")).select("family", "node", "shingles", "one", F.explode(F.sequence(F.lit(0), F.col("twos") - 1)).alias("two"), F.lit(1).alias("side"))
    rest = placed.select("family", "node", "shingles", F.explode(F.sequence(F.lit(0), F.col("ones") - 1)).alias("one"), "two", F.lit(0).alias("side"))
    blocks = lone.unionByName(rest).repartition(parts, "family", "one", "two").sortWithinPartitions("family", "one", "two", F.desc("side"), "node").mapInArrow(across, "a binary, b binary")
    found = common.written(small.union(starred).union(blocks).repartition(common.parts_for(spark, count)), "links")
    common.discard(sets, tried)
    return found


def near_duplicates(docs: DataFrame, k: int = 2, percent: int = 80, coordinates: int = COORDINATES, matches: int = MATCHES, hot: int = 4096, block: int = 256) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    signed = common.written(sign(docs, k, coordinates), "signatures")
    count = signed.count()
    files = common.parts_for(docs.sparkSession, count)
    nodes = common.written(signed.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.any_value("signature").alias("signature")).coalesce(files), "nodes")
    found, postings = candidates(nodes, coordinates, matches, hot, files)
    families = common.components(found, parts=files)
    common.discard(postings)
    sizes = families.groupBy("label").agg(F.count("*").alias("size"))
    members = families.join(sizes, "label").join(nodes.select("node", "first_id"), "node").select("node", F.col("first_id").alias("doc_id"), F.col("label").alias("family"), "size")
    linked = confirm(docs, members, k, percent, block, count)
    joined = common.components(linked, parts=files)
    common.discard(linked, families)
    named = nodes.select("node", "first_id").join(joined, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    by_node = named.join(smallest, "label").select("node", "component_id")
    out = signed.select("doc_id", "n_shingles", "node").join(by_node, "node", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
