"""Suffix-array deduplication by prefix doubling: every byte that lies in a `size`-byte string which also starts in a document
with a smaller id goes.

Ranking every position of a corpus would shuffle many times its size, so the rounds run over few positions and exact names:

* Round 1, prefixes of `gram` bytes. Of every window of size - gram + 1 successive positions the one with the least hash is an
  anchor, so each size-byte string holds an anchor at a place that its content alone decides. Tasks sort their anchors' names,
  Spark deals the sorted names out by bucket, and each bucket sorts them together: names of one document only are unique and
  drop out, as in any prefix doubling.
* Round 2, the full length. A string survives if its anchor is not unique. Neighbouring survivors with the same
  anchor travel as one stretch of text to the bucket of that anchor, where the strings' names (the anchor's doubled to `size`
  bytes) are sorted with their document ids: all but those of the smallest id are removed. Past the threshold there is no third.

Names only bring strings together: that two strings are equal is confirmed on their bytes, wherever one of them is to go.

Equal stretches of a bucket of documents are told apart there: only the smallest id's travels. Anchors that more than a
thousandth of the documents (and over a thousand) have are sent to all tasks - there can be no more than a thousand times a
document's mean number of anchors - and the strings around them travel one by one, each to the bucket of its own content, so that
no bucket grows with a passage that everyone quotes. A task holds one bucket of about BUCKET_BYTES of text as arrays, and sorts
the strings of about SOME bytes of stretches at a time.

Defined cases: null text counts as empty; rows with a null id lose nothing and remove nothing; rows of the same id do not remove
from each other; texts under `size` bytes lose nothing; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .neardup import mixed

BASE = 0x9E3779B97F4A7C15
NAME = np.uint64((1 << 48) - 1)
PART = 1 << 16  # bytes that are hashed at a time: what a step makes of them stays in a core's cache
BUCKET_BYTES = 4 << 20  # text of a bucket of documents, and text whose stretches make up a bucket of round 2: their number follows the data alone
FILE_BYTES = 16 << 20  # text whose findings make up a file, where shuffles have far more partitions than that
SOME = 1 << 17  # bytes of stretches whose strings are sorted at a time
FLUSH = 1 << 19  # anchors that a task sorts before it sends them on
U = np.uint64


def power(n: int) -> np.uint64:
    return U(pow(BASE, n, 1 << 64))


def names(text: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hashes of all n-byte strings, by doubling: the name at 2k is made of the names at k and k further on."""
    with np.errstate(over="ignore"):
        have, k, out = 0, 1, None
        step = text.astype(np.uint64)
        step += U(1)
        while True:  # powers of two from small to large; those that n is made of are put together, the larger to the left
            if n & k:
                if out is None:
                    out, have = step, k
                else:
                    size = max(0, len(text) - have - k + 1)
                    left = step[:size] * power(have)
                    left += out[k : k + size]
                    out, have = left, have + k
            if 2 * k > n:
                return out
            if len(step) <= k:
                step = step[:0]
            else:
                right, step = step[k:], step[:-k] * power(k)
                step += right
            k *= 2


def parts(texts: list[bytes], size: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text, offset, bytes) in lots of about PART bytes; a longer text is cut, overlapping by size - 1 bytes."""
    lot, total = [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(0, len(text) - size + 1), PART):
            piece = text[at : at + PART + size - 1]
            if lot and total + len(piece) > PART:
                yield lot
                lot, total = [], 0
            lot.append((i, at, piece))
            total += len(piece)
    if lot:
        yield lot


def anchored(lot: list[tuple[int, int, bytes]], size: int, gram: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A lot's bytes, and its runs of successive starts of size-byte strings of one anchor name: name, text, place in the bytes, count,
    start in the text. Pieces have `size` bytes at least."""
    lengths = np.array([len(b) for _, _, b in lot])
    ends = np.cumsum(lengths)
    buffer = b"".join(b for _, _, b in lot)
    name = mixed(names(np.frombuffer(buffer, np.uint8), gram))
    width, want = 1, size - gram + 1
    while width < want:  # least hash of each window
        step = min(width, want - width)
        name = np.minimum(name[step:], name[:-step])
        width += step
    begins, fits = np.ones(len(name) + 1, bool), np.ones(len(name), bool)
    np.not_equal(name[1:], name[:-1], out=begins[1:-1])
    for end, length in zip(ends.tolist(), lengths.tolist(), strict=True):
        begins[end - length] = begins[end - size + 1] = True
        fits[end - size + 1 : end] = False
    at = np.flatnonzero(begins)
    count, at = np.diff(at), at[:-1]
    keep = fits[at]
    at, count = at[keep], count[keep]
    owner = np.searchsorted(ends, at, "right")
    text, offset = np.array([i for i, _, _ in lot]), np.array([o for _, o, _ in lot]) - (ends - lengths)
    return buffer, name[at] & NAME, text[owner], at, count, at + offset[owner]


def sorted_pairs(name: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The order by name, and by document where names are equal."""
    order = np.argsort(name)
    equal = name[order[1:]] == name[order[:-1]]
    several = np.flatnonzero(np.r_[False, equal] | np.r_[equal, False])
    some = order[several]
    order[several] = some[np.lexsort((doc[some], name[some]))]
    return order


def packed(values: np.ndarray) -> bytes:
    """64-bit integers, byte by byte of significance, so that the shuffle's compression finds the empty bytes."""
    return np.ascontiguousarray(values, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: list[bytes]) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, np.uint8).reshape(8, -1).T.copy().view("<i8").ravel() for x in data]) if data else np.zeros(0, np.int64)


def by_bucket(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """Each bucket with what the columns have for it. They are sorted once: where buckets are many, little is left to do for one."""
    if not len(bucket):
        return
    order = np.argsort(bucket.astype(np.uint16) if bucket.max() < 1 << 16 else bucket, kind="stable")  # small numbers are sorted by their digits
    bucket = bucket[order]
    at = [*np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]).tolist(), len(bucket)]
    columns = [c[order] for c in columns]
    for v, a, b in zip(bucket[at[:-1]].tolist(), at[:-1], at[1:], strict=True):
        yield v, *(c[a:b] for c in columns)


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the known ones, which are sorted."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def home(doc_ids: np.ndarray, homes: int) -> np.ndarray:
    """The bucket of a document, as with_texts has it."""
    return (doc_ids ^ (doc_ids >> 17)) % homes


CENSUS = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("names", pa.binary()), ("docs", pa.binary()), ("counts", pa.binary())])
CENSUS_DDL = "kind int, bucket int, names binary, docs binary, counts binary"
COUNTED, FORWARD, HOT = 0, 1, 2


def _anchors(size: int, gram: int, buckets: int, homes: int):
    """Round 1, before the shuffle: names of anchors. One that several documents here share is sent on once, as counted, and to its
    documents directly."""

    def flush(found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        name, doc = np.concatenate([a for a, _ in found]), np.concatenate([d for _, d in found])
        order = sorted_pairs(name, doc)
        name, doc = name[order], doc[order]
        first = np.r_[True, (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])]
        name, doc = name[first], doc[first]
        begins = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
        count = np.diff(np.r_[begins, len(name)])
        several = np.repeat(count > 1, count)
        rows = []
        for b, *own in by_bucket((name[begins] % U(buckets)).astype(np.int64), name[begins].view(np.int64), doc[begins], count):
            rows.append((COUNTED, b, *map(packed, own)))
        shared_name, shared_doc = name[several], doc[several]
        if len(shared_name):
            rows += [(FORWARD, b, packed(n), packed(d), None) for b, n, d in by_bucket(home(shared_doc, homes), shared_name.view(np.int64), shared_doc)]
        for i in range(0, len(rows), 64):
            yield common.as_batch(dict(zip(CENSUS.names, map(list, zip(*rows[i : i + 64], strict=True)), strict=True)), CENSUS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.alone()
        found, held = [], 0
        for whole in batches:
            for batch in common.slices(whole):
                doc_ids = np.array(common.ids(batch), np.int64)
                for lot in parts([t or b"" for t in common.texts(batch)], size):
                    _, name, text, *_ = anchored(lot, size, gram)
                    found.append((name, doc_ids[text]))
                    held += len(name)
                    if held > FLUSH:
                        yield from flush(found)
                        found, held = [], 0
        if found:
            yield from flush(found)
        found = None
        common.release()

    return run


REPLY = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("names", pa.binary()), ("docs", pa.binary())])


def _census(homes: int, hot: int):
    """Round 1, after it: names that are not unique go to their documents' buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in common.groups(batches, ["kind", "bucket"]):
            name, doc = unpacked(group.column("names").to_pylist()).view(np.uint64), unpacked(group.column("docs").to_pylist())
            rows = []
            if group.column("kind")[0].as_py() == FORWARD:
                rows.append((FORWARD, group.column("bucket")[0].as_py(), packed(name.view(np.int64)), packed(doc)))
            else:
                count = unpacked(group.column("counts").to_pylist())
                order = np.argsort(name)
                name, doc, count = name[order], doc[order], count[order]
                begins = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
                total = np.add.reduceat(count, begins)
                reply = (np.repeat(total, np.diff(np.r_[begins, len(name)])) > 1) & (count == 1)  # the others know already
                if reply.any():
                    rows += [(FORWARD, b, packed(n), packed(d)) for b, n, d in by_bucket(home(doc[reply], homes), name[reply].view(np.int64), doc[reply])]
                if (total > hot).any():
                    rows.append((HOT, -1, packed(name[begins[total > hot]].view(np.int64)), b""))
            for i in range(0, len(rows), 64):
                yield common.as_batch(dict(zip(REPLY.names, map(list, zip(*rows[i : i + 64], strict=True)), strict=True)), REPLY)

    return run


STRETCH = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("content", pa.binary()), ("lengths", pa.binary()), ("docs", pa.binary()), ("keys", pa.binary()), ("starts", pa.binary()), ("parts", pa.binary())])
STRETCH_DDL = "bucket int, kind int, content binary, lengths binary, docs binary, keys binary, starts binary, parts binary"
TEXT, DONE = 0, 1


def with_texts(docs: DataFrame, replies: DataFrame, columns: list[str], homes: int) -> DataFrame:
    """Texts and what was found out about them, met by the bucket of the document's id, the findings first."""
    place = F.pmod(F.col("doc_id").bitwiseXOR(F.shiftright("doc_id", 17)), F.lit(homes)).cast("int")
    rest = dict(docs.dtypes).get("rest")  # what goes with a text
    texts = docs.select(place.alias("bucket"), F.lit(1).alias("is_text"), "doc_id", "key", "text", *[F.lit(None).cast("binary").alias(c) for c in columns], *(["rest"] if rest else []))
    found = replies.select("bucket", F.lit(0).alias("is_text"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("key"), F.lit(None).cast("string").alias("text"), *columns, *([F.lit(None).cast(rest).alias("rest")] if rest else []))
    return texts.unionByName(found).repartition(common.shuffle_partitions(docs.sparkSession), "bucket").sortWithinPartitions("bucket", "is_text")


def met(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[list[np.ndarray], list[int], list[int], list[bytes], pa.Array | None]]:
    """By bucket: the findings' columns as arrays, then ids, keys, texts and what goes with them."""
    for group in common.groups(batches, ["bucket"]):
        flags = group.column("is_text").to_numpy()
        n = int((flags == 0).sum())
        found = [unpacked(group.column(c).slice(0, n).to_pylist()) for c in columns]
        rest = group.slice(n)
        more = pa.concat_arrays(rest.column("rest").chunks) if "rest" in rest.column_names and len(rest) else None
        yield found, rest.column("doc_id").to_pylist(), rest.column("key").to_pylist(), [(t or b"") for t in rest.column("text").cast(pa.binary()).to_pylist()], more


def within(counts: np.ndarray) -> np.ndarray:
    """0, 1, 2 ... anew for each count."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def gathered(raw: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of all pieces, one after another."""
    return raw[np.repeat(at, lengths) + within(lengths)]


def content_hashes(buffer: bytes, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    out = np.empty(len(at), np.uint64)
    for i in range(0, len(at), 50_000):
        ends = (at[i : i + 50_000] + lengths[i : i + 50_000]).tolist()
        out[i : i + 50_000] = [xxhash.xxh3_64_intdigest(buffer[a:b]) for a, b in zip(at[i : i + 50_000].tolist(), ends, strict=True)]
    return out


def same(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Whether the size-byte strings at a and at b are equal, eight bytes at a time."""
    eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    out = np.ones(len(a), bool)
    for k in (*range(0, size - 7, 8), size - 8):
        out &= eight[a + k] == eight[b + k]
    return out


def ranked(raw: np.ndarray, at: np.ndarray, doc: np.ndarray, name: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The strings in order of name, of equal ones one of the smallest id first, and where each string's run begins. Equal names are
    confirmed on the bytes; unequal strings of one name are told apart by their bytes."""
    order = np.argsort(name)
    new = np.r_[True, name[order[1:]] != name[order[:-1]]]
    again = np.flatnonzero(~new)
    differ = again[~same(raw, at[order[again]], at[order[again - 1]], size)]
    if len(differ):
        rows = np.flatnonzero(np.isin(name, name[order[differ]]))
        strings = [raw[i : i + size].tobytes() for i in at[rows].tolist()]
        rank = {x: i for i, x in enumerate(sorted(set(strings)))}
        second = np.zeros(len(name), np.int64)
        second[rows] = [rank[x] for x in strings]
        order = np.lexsort((second, name))
        new = np.r_[True, (name[order[1:]] != name[order[:-1]]) | (second[order[1:]] != second[order[:-1]])]
    begins = np.flatnonzero(new)
    # the first string of the smallest id changes places with the one that its run begins with
    ids, each = doc[order], np.diff(np.r_[begins, len(order)])
    least = np.flatnonzero(ids == np.repeat(np.minimum.reduceat(ids, begins), each))
    run = np.searchsorted(begins, least, "right")
    least = least[np.r_[True, run[1:] != run[:-1]]]
    order[begins], order[least] = order[least], order[begins]
    return order, begins


def _stretches(size: int, gram: int, buckets: int, homes: int, sent_hot):
    """Round 2, before the shuffle: surviving strings as stretches of text by anchor, the smallest id's of equal ones alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = sent_hot.value
        for (name, doc), doc_ids, keys, texts, _ in met(batches, ["names", "docs"]):
            if not len(name):
                continue
            known, which = np.unique(doc, return_inverse=True)
            shared = np.unique(name.view(np.uint64) ^ mixed(which.astype(np.uint64)))
            all_ids, all_keys = np.array(doc_ids, np.int64), np.array(keys, np.int64)
            mine = np.flatnonzero(np.isin(all_ids, known))
            number, buffers, found, base = np.searchsorted(known, all_ids[mine]), [], [], 0
            for lot in parts([texts[i] for i in mine.tolist()], size):
                buffer, *columns = anchored(lot, size, gram)
                left = np.flatnonzero(among(columns[0] ^ mixed(number[columns[1]].astype(np.uint64)), shared))  # whose anchor is not unique
                if len(left):
                    name, text, at, count, start = (c[left] for c in columns)
                    found.append((name, mine[text], at + base, count, start))
                    buffers.append(buffer)
                    base += len(buffer)
            if not found:
                continue
            name, row, at, count, start = (np.concatenate(c) for c in zip(*found, strict=True))
            found, alone = None, among(name, hot)
            if alone.any():  # around an anchor that very many documents have, each string goes by itself
                each = np.where(alone, count, 1)
                alone, inside = np.repeat(alone, each), within(each)
                name, row, at, start, count = (np.repeat(c, each) for c in (name, row, at, start, count))
                at, start, count = at + inside * alone, start + inside * alone, np.where(alone, 1, count)
            buffer, lengths, doc = b"".join(buffers), count + size - 1, all_ids[row]
            buffers = None
            content = content_hashes(buffer, at, lengths)
            order = np.argsort(content)
            equal = (content[order[1:]] == content[order[:-1]]) & (lengths[order[1:]] == lengths[order[:-1]])
            again = np.flatnonzero(equal)
            for i, a, b, n in zip(again.tolist(), *(c.tolist() for c in (at[order[again]], at[order[again + 1]], lengths[order[again]])), strict=True):
                if buffer[a : a + n] != buffer[b : b + n]:
                    equal[i] = False
            begins = np.flatnonzero(np.r_[True, ~equal])
            smallest = np.empty(len(order), np.int64)
            smallest[order] = np.repeat(np.minimum.reduceat(doc[order], begins), np.diff(np.r_[begins, len(order)]))
            done = np.flatnonzero(doc > smallest)
            rows = Rows()
            for b, *columns in by_bucket(home(doc[done], homes), count[done], doc[done], all_keys[row[done]], start[done]):
                yield from rows.add(b, DONE, b"", *columns, np.zeros(0, np.int64))
            goes = np.flatnonzero(doc == smallest)
            goes = goes[np.argsort(name[goes], kind="stable")]  # stretches of an anchor side by side: they compress well
            target = np.where(alone, content, name)[goes]
            raw, part = np.frombuffer(buffer, np.uint8), (mixed(target) >> U(56)).astype(np.int64)
            for b, where, *columns in by_bucket((target % U(buckets)).astype(np.int64), at[goes], lengths[goes], doc[goes], all_keys[row[goes]], start[goes], part):
                yield from rows.add(b, TEXT, gathered(raw, where, columns[0]).tobytes(), *columns)
            yield from rows.rest()
            common.release()

    return run


class Rows:
    """Stretches by bucket as rows, of which some go out together: the more buckets there are, the less a row holds."""

    def __init__(self):
        self.rows, self.held = [], 0

    def add(self, bucket: int, kind: int, content: bytes, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.rows.append((bucket, kind, pa.compress(content, "zstd", asbytes=True), *(packed(c) for c in columns)))
        self.held += sum(map(len, self.rows[-1][2:]))
        if self.held > 1 << 20 or len(self.rows) >= 1000:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield common.as_batch(dict(zip(STRETCH.names, map(list, zip(*self.rows, strict=True)), strict=True)), STRETCH)
        self.rows, self.held = [], 0


SPANS = pa.schema([("bucket", pa.int32()), ("docs", pa.binary()), ("keys", pa.binary()), ("starts", pa.binary()), ("counts", pa.binary())])


def removed_strings(raw: np.ndarray, lengths: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of stretches that follow each other: runs of strings of other than the smallest id, as stretch, place in it and count."""
    each = lengths - size + 1
    owner, inside = np.repeat(np.arange(len(doc)), each), within(each)
    at = (np.cumsum(lengths) - lengths)[owner] + inside
    order, begins = ranked(raw, at, doc[owner], mixed(names(raw, size))[at], size)
    gone = np.empty(len(order), bool)
    gone[order] = doc[owner[order]] > np.repeat(doc[owner[order[begins]]], np.diff(np.r_[begins, len(order)]))
    where = np.flatnonzero(gone)
    if not len(where):
        return where, where, where
    first = np.flatnonzero(np.r_[True, (where[1:] != where[:-1] + 1) | (owner[where[1:]] != owner[where[:-1]])])
    return owner[where[first]], inside[where[first]], np.diff(np.r_[first, len(where)])


def _spans(size: int, homes: int):
    """Round 2, after it: the strings sorted with their ids, those of some anchors at a time; runs of strings of other than the
    smallest id come out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in common.groups(batches, ["kind", "bucket"]):
            lengths, doc, key, start, part = (unpacked(group.column(c).to_pylist()) for c in ("lengths", "docs", "keys", "starts", "parts"))
            if group.column("kind")[0].as_py() == DONE:
                rows = [(doc, key, start, lengths)]
            else:
                ends = np.cumsum([0, *(len(x) // 8 for x in group.column("lengths").to_pylist())])
                sizes = np.add.reduceat(lengths, ends[:-1]).tolist()
                raw = np.frombuffer(b"".join(pa.decompress(c, n, "zstd", asbytes=True) for c, n in zip(group.column("content").to_pylist(), sizes, strict=True)), np.uint8)
                origin, order = np.cumsum(lengths) - lengths, np.argsort(part.astype(np.uint8), kind="stable")
                part = part[order]
                totals, rows, a = np.cumsum(np.bincount(part, weights=lengths[order], minlength=256)), [], 0
                for p in range(256):  # parts of the anchors until about SOME bytes are together
                    if p == 255 or totals[p + 1] - (totals[a - 1] if a else 0) > SOME:
                        i = order[np.searchsorted(part, a) : np.searchsorted(part, p, "right")]
                        a = p + 1
                        if len(i):
                            of, place, count = removed_strings(gathered(raw, origin[i], lengths[i]), lengths[i], doc[i], size)
                            rows.append((doc[i[of]], key[i[of]], start[i[of]] + place, count))
            doc, key, start, count = (np.concatenate(c) for c in zip(*rows, strict=True))
            rows = [(b, *map(packed, columns)) for b, *columns in by_bucket(home(doc, homes), doc, key, start, count)]
            for i in range(0, len(rows), 64):
                yield common.as_batch(dict(zip(SPANS.names, map(list, zip(*rows[i : i + 64], strict=True)), strict=True)), SPANS)
            common.release()

    return run


def removed_runs(starts: np.ndarray, counts: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the strings cover."""
    out: list[list[int]] = []
    for s, n in sorted(zip(starts.tolist(), counts.tolist(), strict=True)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s + n - 1 + size)
        else:
            out.append([s, s + n - 1 + size])
    return [(a, b) for a, b in out]


def _cut(size: int, keep_text: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (doc, key, start, count), doc_ids, keys, texts, rest in met(batches, ["docs", "keys", "starts", "counts"]):
            order = np.lexsort((key, doc))
            doc, key, start, count = doc[order], key[order], start[order], count[order]
            begins = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])]) if len(doc) else np.zeros(0, np.int64)
            of = {(int(doc[a]), int(key[a])): (a, b) for a, b in zip(begins, [*begins[1:], len(doc)], strict=False)}
            out = []
            for d, k, text in zip(doc_ids, keys, texts, strict=True):
                a, b = of.get((d, k), (0, 0))
                runs = removed_runs(start[a:b], count[a:b], size)
                kept = b"".join(text[x:y] for x, y in zip([0, *(y for _, y in runs)], [*(x for x, _ in runs), len(text)], strict=True))
                row = (d, k, len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest())
                out.append((*row, without(text, runs) if keep_text else None))
            for i in range(0, len(out), 1000):
                columns = dict(zip(schema.names, map(list, zip(*out[i : i + 1000], strict=True)), strict=True))
                if rest is None:
                    yield common.as_batch(columns, schema)
                else:
                    yield common.as_batch(columns | {"rest": rest.slice(i, 1000)}, schema.append(pa.field("rest", rest.type)))

    return run


def without(text: bytes, runs: list[tuple[int, int]]) -> str:
    """The text without the runs; a character that a run's end would split stays whole."""
    inside = lambda i: 0 < i < len(text) and 0x80 <= text[i] < 0xC0
    out, at = [], 0
    for a, b in runs:
        while inside(a):
            a += 1
        while inside(b):
            b -= 1
        if b > a:
            out.append(text[at:a])
            at = b
    return b"".join([*out, text[at:]]).decode()


def remove_repeats(docs: DataFrame, size: int = 50, gram: int = 24, keep_text: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and key and the remaining text, with what is to be carried along in `rest`) of every document."""
    spark = docs.sparkSession
    own = [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("key"), "text"]
    carried = docs.select(*own, *([F.struct(*carry).alias("rest")] if carry else []))
    docs = carried.select("doc_id", "key", "text")
    known = docs.where("doc_id is not null")
    count, n_bytes = known.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    hot, buckets = max(1000, count // 1000), max(1, -(-n_bytes // BUCKET_BYTES))
    homes, partitions = buckets | 1, common.shuffle_partitions(spark)  # odd: ids often share a factor of two
    census = known.select("doc_id", "text").mapInArrow(_anchors(size, gram, buckets, homes), CENSUS_DDL).repartition(partitions, "kind", "bucket").sortWithinPartitions("kind", "bucket")
    files = max(spark.sparkContext.defaultParallelism, -(-n_bytes // FILE_BYTES))
    fewer = lambda df: df.repartition(files) if 4 * files <= partitions else df
    replies = common.written(fewer(census.mapInArrow(_census(homes, hot), "kind int, bucket int, names binary, docs binary")), "shared-anchors")
    hot_names = unpacked([r["names"] for r in replies.where(F.col("kind") == HOT).select("names").collect()]).view(np.uint64)
    sent = spark.sparkContext.broadcast(np.unique(hot_names))
    stretches = with_texts(known, replies.where(F.col("kind") == FORWARD), ["names", "docs"], homes).mapInArrow(_stretches(size, gram, buckets, homes, sent), STRETCH_DDL)
    spans = stretches.repartition(partitions, "kind", "bucket").sortWithinPartitions("kind", "bucket").mapInArrow(_spans(size, homes), "bucket int, docs binary, keys binary, starts binary, counts binary")
    spans = common.written(fewer(spans), "repeat-spans")
    more = f", rest {dict(carried.dtypes)['rest']}" if carry else ""
    out = with_texts(carried.where("doc_id is not null"), spans, ["docs", "keys", "starts", "counts"], homes).mapInArrow(_cut(size, keep_text), f"doc_id long, key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string{more}")
    alone = carried.where("doc_id is null").withColumn("bytes", F.coalesce("text", F.lit("")).cast("binary"))
    whole = alone.select("doc_id", "key", F.octet_length("bytes").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("bytes", 256).alias("kept_sha256"), F.coalesce("text", F.lit("")).alias("text"), *(["rest"] if carry else []))
    both = out.unionByName(whole)
    common.discard(replies)
    return both if keep_text else both.drop("key", "text", "rest")
