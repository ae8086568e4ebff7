"""Collocations by pivot partitioning: which phrases are said as wholes.

Texts are cut into pieces at punctuation and line ends, pieces into words; everything is counted per language. An n-gram belongs to its
rarest word, the pivot (of equal words the leftmost). So each occurrence of a word sends a fragment to the word's partition: the up to
four words on either side that are more frequent, cut where a rarer word stands, since what reaches past that one belongs to it. A
partition counts the n-grams of its fragments that hold the pivot, from short to long, and goes on only from those that are frequent.
Every occurrence of an n-gram is counted once, in one partition.

How it scales: words are counted with partial sums. The most frequent words, as far as they fit `budget` bytes by a sum over classes of
counts, are broadcast with their ranks, and tasks ship fragments as arrays of ranks, equal ones merged with their count before the
shuffle. Frequent words beyond the budget are the rarest of all, and go the exact way for the rest: their fragments carry words, meet the
table of frequent words in a join and are mined likewise. A partition whose fragments are too many for one task, by a sum over the written
fragments, is split and its partial counts are added up afterwards. The driver sees sums per class and the words of the budget.

Defined cases: a null text is empty, a null language is `und`; texts without words and empty tables give no rows; repeated rows count
each; other columns don't count. Scores divide exact decimals and round down.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

LONGEST = 5
REACH = LONGEST - 1
ENDS = b".,;:!?\n\x0b\x0c\r"
UPPER = bytes(range(65, 91))
CUT = bytes.maketrans(ENDS + b"\t" + UPPER, b"\n" * len(ENDS) + b" " + UPPER.lower())
WALL = np.int32(2**31 - 1)
FRAGMENTS = "bucket long, n long, blob binary, lang string, word string, left string, right string"


def _by_lang(batch: pa.RecordBatch) -> dict[str, bytes]:
    """All texts of a batch by language, as lines of words with one space or more between."""
    joined: dict[str, list[bytes]] = {}
    for lang, text in zip(common.ids(batch, "lang"), common.texts(batch), strict=True):
        if text:
            joined.setdefault(lang, []).append(text)
    return {lang: b"\n".join(x).translate(CUT) for lang, x in joined.items()}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}

    def flushed() -> Iterator[pa.RecordBatch]:
        for lang, c in counts.items():
            words = list(c)
            for i in range(0, len(words), 50_000):
                some = words[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.binary()).cast(pa.string()), pa.array([c[w] for w in some], pa.int64())], ["lang", "word", "times"])
        counts.clear()

    for whole in batches:
        for batch in common.slices(whole, most=2 << 20):
            for lang, text in _by_lang(batch).items():
                counts.setdefault(lang, Counter()).update(text.split())
            if sum(map(len, counts.values())) > 300_000:
                yield from flushed()
    yield from flushed()


def windows(ranks: np.ndarray) -> np.ndarray:
    """A row per word that has a more frequent neighbour: REACH places to the left, the word, REACH to the right; -1 where a rarer word,
    or to the left an equal one, has cut the fragment. A rank of WALL is no word."""
    n = len(ranks)
    padded = np.concatenate([np.full(REACH, WALL, np.int32), ranks, np.full(REACH, WALL, np.int32)])
    out = np.full((n, 2 * REACH + 1), -1, np.int32)
    out[:, REACH] = ranks
    for side, compare in ((-1, np.less), (1, np.less_equal)):
        ok = ranks < WALL
        for k in range(1, REACH + 1):
            other = padded[REACH + side * k : REACH + side * k + n]
            ok = ok & compare(other, ranks)
            out[ok, REACH + side * k] = other[ok]
    return out[(out[:, REACH - 1] >= 0) | (out[:, REACH + 1] >= 0)]


def merged(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal rows once, with the sum of their counts. Rows are brought together by a hash; the odd one that shares another's stays apart."""
    if not len(rows):
        return rows, counts
    h = np.zeros(len(rows), np.uint64)
    for column in rows.T:
        h = (h ^ (column.astype(np.int64).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    _, first, group = np.unique(h, return_index=True, return_inverse=True)
    same = (rows == rows[first[group]]).all(1)
    total = np.bincount(group[same], weights=counts[same], minlength=len(first)).astype(np.int64)
    return np.concatenate([rows[first], rows[~same]]), np.concatenate([total, counts[~same]])


def _blobs(rows: np.ndarray, counts: np.ndarray, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, fragments, their bytes): all fragments of a word go to one bucket."""
    bucket = (rows[:, REACH].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    rows, counts, bucket = rows[order], counts[order], bucket[order]
    packer = zstandard.ZstdCompressor(level=1)
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    for a, b in zip(starts, [*starts[1:], len(rows)], strict=True):
        yield int(bucket[a]), int(b - a), packer.compress(np.ascontiguousarray(rows[a:b].T).tobytes() + counts[a:b].tobytes())


def _unpacked(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    raw, width = zstandard.ZstdDecompressor().decompress(blob), 2 * REACH + 1
    return np.frombuffer(raw, np.int32, width * n).reshape(width, n).T, np.frombuffer(raw, np.int64, n, 4 * width * n)


def _rare_windows(tokens: list[bytes], at: Iterator[int], known: dict[bytes, int]) -> Iterator[tuple[bytes, bytes, bytes]]:
    """(left, word, right) for words out of the head, all rarer than those in it; among themselves they go by their bytes."""
    for i in at:
        w, left, right = tokens[i], [], []
        for side, out in ((-1, left), (1, right)):
            j = i + side
            while 0 <= j < len(tokens) and len(out) < REACH and (x := tokens[j]) != b"\n" and (x in known or x < w or side > 0 and x == w):
                out.append(x)
                j += side
        if left or right:
            yield b" ".join(reversed(left)), w, b" ".join(right)


def _fragments(sent, buckets: int, tail: bool, hold: int = 600_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks_of: dict[str, dict[bytes, int]] = {}
        for rank, (lang, word) in enumerate(sent.value):
            ranks_of.setdefault(lang, {b"\n": WALL})[word.encode()] = rank
        schema = pa.schema([("bucket", pa.int64()), ("n", pa.int64()), ("blob", pa.binary()), ("lang", pa.string()), ("word", pa.string()), ("left", pa.string()), ("right", pa.string())])
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flushed() -> Iterator[pa.RecordBatch]:
            rows, counts = merged(np.concatenate([r for r, _ in held]), np.concatenate([c for _, c in held]))
            held.clear()
            found = list(_blobs(rows, counts, buckets)) if len(rows) else []
            if found:
                b, n, blob = map(list, zip(*found, strict=True))
                none = pa.nulls(len(b), pa.string())
                yield common.as_batch({"bucket": b, "n": n, "blob": blob, "lang": none, "word": none, "left": none, "right": none}, schema)

        for whole in batches:
            for batch in common.slices(whole, most=2 << 20):
                for lang, text in _by_lang(batch).items():
                    known = ranks_of.get(lang, {})
                    tokens = [w for w in text.replace(b"\n", b" \n ").split(b" ") if w]
                    ranks = np.fromiter(map(known.get, tokens, repeat(WALL)), np.int32, len(tokens))
                    rows = windows(ranks)
                    held.append(merged(rows, np.ones(len(rows), np.int64)))
                    if tail:
                        at = (int(i) for i in np.flatnonzero(ranks == WALL) if tokens[i] != b"\n")
                        rare = Counter(_rare_windows(tokens, at, known))
                        for chunk in _chunks(list(rare.items()), 20_000):
                            left, word, right = (pa.array(list(c), pa.binary()).cast(pa.string()) for c in zip(*[x for x, _ in chunk], strict=True))
                            yield common.as_batch({"bucket": pa.nulls(len(chunk), pa.int64()), "n": [c for _, c in chunk], "blob": pa.nulls(len(chunk), pa.binary()), "lang": [lang] * len(chunk), "word": word, "left": left, "right": right}, schema)
                if sum(len(r) for r, _ in held) > hold:
                    yield from flushed()
        if held:
            yield from flushed()

    return run


def _chunks(items: list, n: int) -> Iterator[list]:
    return (items[i : i + n] for i in range(0, len(items), n))


def mine(rows: np.ndarray, counts: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, counts) of the n-grams that hold the fragments' pivots and occur `least` times or more, from short to long: an n-gram is
    looked at only where both n-grams in it that are a word shorter and hold the pivot are frequent."""
    names = {(0, 0): rows[:, REACH].astype(np.int64)}
    for n in range(1, LONGEST):
        shorter, names = names, {}
        for a in range(n + 1):
            b = n - a
            from_ = shorter.get((a - 1, b) if a else (0, b - 1))
            word = rows[:, REACH - a if a else REACH + b]
            if from_ is None:
                continue
            ok = (from_ >= 0) & (word >= 0)
            if a and b:
                other = shorter.get((a, b - 1))
                ok = ok & (other >= 0) if other is not None else ok & False
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            _, first, group = np.unique((from_[at] << 31) | word[at], return_index=True, return_inverse=True)
            total = np.bincount(group, weights=counts[at]).astype(np.int64)
            enough = total >= least
            if not enough.any():
                continue
            kept = enough[group]
            names[a, b] = np.full(len(rows), -1, np.int64)
            names[a, b][at[kept]] = group[kept]
            yield rows[at[first[enough]], REACH - a : REACH + b + 1], total[enough]


def _mined(sent, least: int):
    """The n-grams of a bucket, or of a part of one: then partial counts, whatever they are."""

    def run(key: tuple, blobs: pa.Table) -> pa.Table:
        words = sent.value
        parts = [_unpacked(b, n) for b, n in zip(blobs.column("blob").to_pylist(), blobs.column("n").to_pylist(), strict=True)]
        rows, counts = merged(np.concatenate([r for r, _ in parts]), np.concatenate([c for _, c in parts]))
        del parts
        langs, phrases, times = [], [], []
        for found, total in mine(rows, counts, least if blobs.column("parts")[0].as_py() == 1 else 1):
            langs += [words[r[0]][0] for r in found]
            phrases += [" ".join([words[i][1] for i in r]) for r in found]
            times += total.tolist()
        common.release()
        return pa.table({"lang": pa.array(langs, pa.string()), "phrase": pa.array(phrases, pa.string()), "times": pa.array(times, pa.int64())})

    return run


def _mined_rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-grams around words out of the head, fragment by fragment."""
    for batch in batches:
        counts: Counter = Counter()
        for lang, word, left, right, n in zip(*[batch.column(c).to_pylist() for c in ("lang", "word", "left", "right", "n")], strict=True):
            before, after = left.split(" ") if left else [], right.split(" ") if right else []
            for a in range(min(len(before), REACH) + 1):
                for b in range(min(len(after), REACH - a) + 1):
                    if a + b:
                        counts[lang, " ".join([*before[len(before) - a :], word, *after[:b]])] += n
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in counts], pa.string()), pa.array([x[1] for x in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "phrase", "times"])


def frequent(docs: DataFrame, least: int = 100, budget: int = 32 << 20, share: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, times) of every contiguous phrase of one to five words that occurs `least` times or more, and (lang, n), all
    words of a language. budget: bytes of words that may be broadcast; share: fragments that a task takes."""
    spark, parts = docs.sparkSession, common.shuffle_partitions(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    words = common.written(texts.mapInArrow(_count, "lang string, word string, times long").groupBy("lang", "word").agg(F.sum("times").alias("times")), "words")
    sizes = common.written(words.groupBy("lang").agg(F.sum("times").alias("n")), "sizes")
    singles = words.where(F.col("times") >= least)
    cut, below = common.head_class(singles, "word", "times", budget)
    in_head = common.count_class("times") >= cut
    head = sorted(singles.where(in_head).collect(), key=lambda r: (-r["times"], r["lang"], r["word"].encode()))  # within the budget
    sent = spark.sparkContext.broadcast([(r["lang"], r["word"]) for r in head])
    buckets = max(parts, -(-sum(r["times"] for r in head) // share))
    fragments = common.written(texts.mapInArrow(_fragments(sent, buckets, below > 0), FRAGMENTS), "fragments")
    blobs = fragments.where("blob is not null").select("bucket", "n", "blob")
    large = blobs.groupBy("bucket").agg(F.sum("n").alias("size")).where(F.col("size") > 2 * share).select("bucket", F.ceil(F.col("size") / share).alias("parts"))
    dealt = blobs.join(large, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)).cast("long")).withColumn("part", F.pmod(F.xxhash64("blob"), "parts"))
    mined = dealt.groupBy("bucket", "part").applyInArrow(_mined(sent, least), "lang string, phrase string, times long")
    if below:
        rare = fragments.where("blob is null").join(singles.where(~in_head).select("lang", "word"), ["lang", "word"], "left_semi")
        mined = mined.unionByName(rare.mapInArrow(_mined_rare, "lang string, phrase string, times long"))
    grams = mined.groupBy("lang", "phrase").agg(F.sum("times").alias("times")).where(F.col("times") >= least)
    return common.written(grams.unionByName(singles.withColumnRenamed("word", "phrase")), "phrases"), sizes


def collocations(docs: DataFrame, least: int = 100, cover: int = 100, top: int = 2000, **how: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of a language by the lowest score of their cuts, 1000 * a * n / (l * r)
    rounded down, of equal ones the earliest cut. Phrases that a longer candidate holds with cover % of their count are left out."""
    phrases, sizes = frequent(docs, least, **how)
    split = phrases.select("lang", "phrase", F.col("times").alias("a"), F.split("phrase", " ").alias("w")).where(F.size("w") > 1)
    joined = lambda start, n: F.array_join(F.slice("w", start, n), " ")
    cuts = split.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1))).select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("head"), joined(F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
    part = lambda name, value: phrases.select("lang", F.col("phrase").alias(name), F.col("times").alias(value))
    whole = cuts.join(part("head", "l"), ["lang", "head"]).join(part("rest", "r"), ["lang", "rest"]).join(sizes, "lang")
    exact = lambda c: f"cast({c} as decimal(19, 0))"
    scored = whole.withColumn("score", F.expr(f"(({exact('a')} * {exact('1000')}) * {exact('n')}) div ({exact('l')} * {exact('r')})"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    # every contiguous part of two words or more, with the largest count of a phrase that it is a part of
    longer = split.where(F.size("w") > 2).withColumn("m", F.explode(F.sequence(F.lit(2), F.size("w") - 1))).withColumn("i", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("m") + 1)))
    held = longer.groupBy("lang", joined(F.col("i"), F.col("m")).alias("phrase")).agg(F.max("a").alias("held"))
    left = best.join(held, ["lang", "phrase"], "left").where(F.col("held").isNull() | (100 * F.col("held").cast("decimal(19,0)") < cover * F.col("a").cast("decimal(19,0)")))
    order = [F.desc("b.score"), F.desc("a"), "phrase"]
    ranked = lambda rows, *keys: rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", *keys).orderBy(*order))).where(F.col("rank") <= top)
    some = ranked(left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(16))), "salt")  # a language's best, from its best in each of 16 parts
    return ranked(some).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "b.l", "b.r", "n", "b.score")
