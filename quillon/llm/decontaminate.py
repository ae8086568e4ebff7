"""Benchmark decontamination by greedy string tiling.

Words are lower-cased runs of ASCII letters and digits and of all other characters beyond ASCII, so case and punctuation don't
hide a leak. Test items and documents are joined on seeds, the hashes of `least` successive words (all words of a shorter
item). For each pair that shares a seed, running Karp-Rabin hashes find the longest common stretches of unmarked words, which
are marked as tiles, longest first, until none of `least` words is left. Tiles may lie in any order, so reordered passages
count. An item is leaked when tiles cover at least `coverage` of its words.

Test items are sent to the tasks in blocks of at most `block_bytes` of text; more items mean more passes over the documents,
each of which carries the result so far. Every document meets every item.

Defined cases: null and empty texts hold nothing; null or empty items are in nothing; equal coverage goes to the smaller item id,
a null id last; repeated rows are judged each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Upper case as lower case, and a blank for what is in no word.
PARTED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(PARTED).split()


def hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Running polynomial hashes of all stretches of n words."""
    if len(codes) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(codes) - n + 1, np.uint64)
        for j in range(n):
            out = out * BASE + codes[j : j + len(out)].astype(np.uint64) + np.uint64(1)
    return out


def scan(item: np.ndarray, text: np.ndarray, free_item: np.ndarray, free_text: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """Maximal stretches of at least n equal unmarked words: (length, start in item, start in text)."""
    a, b = hashes(item, n), hashes(text, n)
    at: dict[int, list[int]] = {}
    for i in np.flatnonzero(np.isin(b, a)).tolist():
        at.setdefault(int(b[i]), []).append(i)
    found = []
    for p, h in enumerate(a.tolist()):
        if not free_item[p : p + n].all():
            continue
        for t in at.get(h, ()):
            if p and t and item[p - 1] == text[t - 1] and free_item[p - 1] and free_text[t - 1]:
                continue  # part of a longer stretch that starts before
            k = 0
            while p + k < len(item) and t + k < len(text) and item[p + k] == text[t + k] and free_item[p + k] and free_text[t + k]:
                k += 1
            if k >= n:
                found.append((k, p, t))
    return found


def tiles(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: non-overlapping (length, start in item, start in text), longest first."""
    free_item, free_text, out = np.ones(len(item), bool), np.ones(len(text), bool), []
    while True:
        found = sorted(scan(item, text, free_item, free_text, least), key=lambda x: (-x[0], x[1], x[2]))
        if not found:
            return out
        longest = found[0][0]
        for k, p, t in found:  # all of the greatest length that aren't occluded; shorter ones are sought again
            if k < longest:
                break
            if free_item[p : p + k].all() and free_text[t : t + k].all():
                free_item[p : p + k] = free_text[t : t + k] = False
                out.append((k, p, t))


class Block:
    """Test items that go to every task: words, seeds, and where each seed is."""

    def __init__(self, items: list[tuple[int | None, bytes]], least: int):
        self.codes: dict[bytes, int] = {}
        self.items: list[tuple[int | None, np.ndarray, int]] = []
        self.seeds: dict[int, dict[int, set[int]]] = {}  # length -> hash -> items
        for item_id, text in items:
            words = words_of(text)
            if words:
                codes = np.array([self.codes.setdefault(w, len(self.codes) + 1) for w in words], np.int64)
                n = min(least, len(codes))
                for h in hashes(codes, n).tolist():
                    self.seeds.setdefault(n, {}).setdefault(h, set()).add(len(self.items))
                self.items.append((item_id, codes, n))
        self.keys = {n: np.array(sorted(s), np.uint64) for n, s in self.seeds.items()}

    def search(self, text: bytes | None) -> list[tuple[int | None, float]]:
        """Coverage of every item that shares a seed with the text."""
        codes = np.fromiter(map(self.codes.get, words := words_of(text), (0 for _ in words)), np.int64, len(words))
        near: set[int] = set()
        for n, keys in self.keys.items():
            own = hashes(codes, n)
            own = own[(codes > 0)[: len(own)]]  # no seed begins with a word that no item has
            for h in own[keys[np.minimum(np.searchsorted(keys, own), len(keys) - 1)] == own].tolist():
                near |= self.seeds[n][h]
        out = []
        for i in sorted(near):
            item_id, item, n = self.items[i]
            covered = sum(k for k, _, _ in tiles(item, codes, n))
            out.append((item_id, covered / len(item)))
        return out


FOUND = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("leaked", pa.list_(pa.int64()))])
FOUND_DDL = "doc_id long, text string, item_id long, coverage double, leaked array<long>"


def _pass(sent, threshold: float, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = lambda x: (-x[1], x[0] is None, x[0])
        for whole in batches:
            for batch in common.slices(whole):
                best_id, best, leaked = common.ids(batch, "item_id"), common.ids(batch, "coverage"), common.ids(batch, "leaked")
                for r, text in enumerate(common.texts(batch)):
                    for item_id, covered in sent.value.search(text):
                        if covered > 0 and (best[r] == 0 or rank((item_id, covered)) < rank((best_id[r], best[r]))):
                            best_id[r], best[r] = item_id, covered
                        if covered >= threshold:
                            leaked[r] = sorted({*leaked[r], item_id}, key=lambda x: (x is None, x))
                texts = pa.nulls(batch.num_rows, pa.string()) if last else batch.column(1).cast(pa.string())
                yield common.as_batch({"doc_id": common.ids(batch), "text": texts, "item_id": best_id, "coverage": best, "leaked": leaked}, FOUND)

    return run


def item_blocks(benchmark: DataFrame, least: int, block_bytes: int) -> list:
    """The test items as broadcast blocks of about block_bytes of text each, one block at least."""
    spark = benchmark.sparkSession
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    rows = [items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == b).collect() for b in range(n)]
    return [spark.sparkContext.broadcast(Block([(r["item_id"], r["text"].encode()) for r in block], least)) for block in rows]


def without_leaks(docs: DataFrame, benchmark: DataFrame, least: int = 5, coverage: float = 0.6, block_bytes: int = 16 << 20) -> DataFrame:
    """The rows whose text leaks no item, with all their columns; a pass per block, no shuffle."""

    def kept(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([all(c < coverage for _, c in sent.value.search(t)) for t in common.texts(batch)], pa.bool_()))
            common.release()

        return run

    for sent in item_blocks(benchmark, least, block_bytes):
        docs = docs.mapInArrow(kept(sent), docs.schema)
    return docs


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: int = 5, coverage: float = 0.6, block_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, contaminated, item_id (most covered), coverage, leaked (ids of all leaked items) of every whole text."""
    out = docs.select(F.col("doc_id").cast("long"), "text", F.lit(None).cast("long").alias("item_id"), F.lit(0.0).alias("coverage"), F.array().cast("array<long>").alias("leaked"))
    blocks = item_blocks(benchmark, least, block_bytes)
    for b, sent in enumerate(blocks):
        out = out.mapInArrow(_pass(sent, coverage, b == len(blocks) - 1), FOUND_DDL)
    return out.select("doc_id", (F.size("leaked") > 0).alias("contaminated"), "item_id", "coverage", "leaked")
