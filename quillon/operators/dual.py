"""Regularised logistic and softmax regression on sparse features of any number, with a number per row and class on the driver.

The coefficients at the optimum are sums of rows, w = X'a, so the fit looks for a alone. A damped Newton step is solved by conjugate
gradients, each of which needs one product with XX': features lie in chunks, all entries of a feature in one, so that a task adds
x (x . a) up over its features and Spark adds up what the tasks have; nothing is shuffled but those sums. A task holds a chunk and one
vector; the driver some vectors. No place holds all coefficients. Every product reads all chunks, so they are kept small and near: of a
feature's entries those of one value are a run, which has its value once, and the executors hold the chunks while a fit goes on, in
memory or else on their disks.

Objective: c * sum(log loss) + |w|^2 / 2, intercepts free. Two classes have one vector of coefficients, for the second; more one each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import new_path

CHUNKS = "grams array<string>, idf array<double>, sizes binary, lengths binary, raw binary, docs binary"
CELLS = ("sizes", "lengths", "raw", "docs")  # runs of a feature; entries and value of a run; the entries' places
#: Entries of a chunk from which on it is closed, at a feature's end; places of a vector that travel together; bytes of chunks that a task reads.
ENTRIES, BLOCK, PART = 1 << 16, 1 << 16, 64 << 20


def _chunked(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Chunks from a partition's entries (gram, idf, doc, raw), which are sorted by gram."""
    schema = pa.schema([("grams", pa.list_(pa.string())), ("idf", pa.list_(pa.float64())), *((c, pa.binary()) for c in CELLS)])
    grams: list[str] = []
    idf: list[float] = []
    sizes: list[int] = []
    docs: list[np.ndarray] = []
    raw: list[np.ndarray] = []
    total = 0

    def closed() -> pa.RecordBatch:
        of, d, r = np.repeat(np.arange(len(sizes)), sizes), np.concatenate(docs).astype(np.int32), np.concatenate(raw).astype(np.float64)
        order = np.lexsort((d, r, of))
        of, d, r = of[order], d[order], r[order]
        begins = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (r[1:] != r[:-1])])
        runs, lengths = np.bincount(of[begins], minlength=len(sizes)), np.diff(np.r_[begins, len(d)])
        cells = [runs.astype(np.int32).tobytes(), lengths.astype(np.int32).tobytes(), r[begins].tobytes(), d.tobytes()]
        out = pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([grams, idf, *cells], schema.types, strict=True)], schema=schema)
        for part in (grams, idf, sizes, docs, raw):
            part.clear()
        return out

    for batch in batches:
        if not batch.num_rows:
            continue
        coded = batch.column("gram").dictionary_encode()
        at, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        i, d, r = (batch.column(c).to_numpy() for c in ("idf", "doc", "raw"))
        bounds = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            name = names[at[a]]
            if grams and grams[-1] == name:
                sizes[-1] += b - a
            else:
                if total >= most:
                    yield closed()
                    total = 0
                grams.append(name)
                idf.append(float(i[a]))
                sizes.append(b - a)
            total += b - a
            docs.append(d[a:b])
            raw.append(r[a:b])
    if sizes:
        yield closed()


def chunks(entries: DataFrame, most: int = ENTRIES) -> DataFrame:
    """entries (gram, idf, doc: places from 0, raw), each gram in one partition, as a table of chunks in the shared folder."""
    path = new_path(entries.sparkSession, "chunks")
    entries.select("gram", "idf", "doc", "raw").sortWithinPartitions("gram").mapInArrow(lambda batches: _chunked(batches, most), CHUNKS).write.parquet(path)
    return entries.sparkSession.read.schema(CHUNKS).parquet(path)


def _read(cells: tuple) -> tuple[np.ndarray, ...]:
    return tuple(np.frombuffer(x, t) for x, t in zip(cells, (np.int32, np.int32, np.float64, np.int32), strict=True))


def _sums(sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of values by feature, or by run."""
    return np.add.reduceat(values, np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64))


def held(kept: DataFrame) -> RDD:
    """The chunks' cells with the executors, dealt out evenly; to be given back by unpersist."""
    spark = kept.sparkSession
    cells = kept.select(*CELLS)
    size = cells.agg(F.sum(sum(F.octet_length(c) for c in CELLS).cast("long"))).first()[0] or 0
    cores = spark.sparkContext.defaultParallelism
    return cells.repartition(cores * max(1, -(-size // (cores * PART)))).rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)


def product(cells: RDD, n: int, a: np.ndarray | None) -> np.ndarray:
    """XX'a of the chunks' raw values, for a with a column per class; without a, the rows' squared lengths."""
    columns, block = 1 if a is None else a.shape[1], BLOCK
    sent = cells.context.broadcast(None if a is None else np.ascontiguousarray(a.T))

    def run(chunks_: Iterator[tuple]) -> Iterator[tuple[int, np.ndarray]]:
        out, own = np.zeros((columns, n)), sent.value
        for chunk in chunks_:
            sizes, lengths, raw, docs = _read(chunk)
            for k in range(columns):
                value = raw * raw if own is None else raw * np.repeat(_sums(sizes, raw * _sums(lengths, own[k][docs])), sizes)
                out[k] += np.bincount(docs, np.repeat(value, lengths), minlength=n)
        yield from ((i, out[:, s : s + block]) for i, s in enumerate(range(0, n, block)))

    out, parts = np.zeros((columns, n)), cells.mapPartitions(run)
    # a vector of one block comes from each task; of longer ones the tasks' blocks are added up first
    for i, part in (parts if n <= block else parts.reduceByKey(np.add, cells.getNumPartitions())).collect():
        out[:, i * block : (i + 1) * block] += part
    sent.destroy()
    return out.T


def _loss(z: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Log loss and the probabilities: of the second of two classes, or of each."""
    if z.shape[1] == 1:
        return float(np.logaddexp(0, np.where(y[:, None] == 1, -z, z)).sum()), 1 / (1 + np.exp(-np.clip(z, -700, 700)))
    top = z - z.max(1, keepdims=True)
    e = np.exp(top)
    return float((np.log(e.sum(1)) - top[np.arange(len(y)), y]).sum()), e / e.sum(1, keepdims=True)


def _curved(p: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The loss's second derivative, row by row, times v."""
    return p * (1 - p) * v if p.shape[1] == 1 else p * (v - (p * v).sum(1, keepdims=True))


def fitted(kept: DataFrame, y: np.ndarray, classes: int, c: float, most: int = 30, inner: int = 100, tol: float = 1e-7) -> tuple[np.ndarray, np.ndarray]:
    """a (rows, free classes) so that the coefficients of the raw features are X'a, and the intercepts. Rows count at length 1; those
    without a feature do not take part. y: places of the classes, 0 to classes - 1."""
    cells = held(kept)
    try:
        return _fitted(cells, y, classes, c, most, inner, tol)
    finally:
        cells.unpersist()


def _fitted(cells: RDD, y: np.ndarray, classes: int, c: float, most: int, inner: int, tol: float) -> tuple[np.ndarray, np.ndarray]:
    n, free = len(y), 1 if classes == 2 else classes
    length = np.sqrt(product(cells, n, None))
    on = (length[:, 0] > 0).astype(float)[:, None]
    scale = np.where(length > 0, 1 / np.where(length > 0, length, 1), 0)
    times = lambda v: scale * product(cells, n, scale * v)
    true = (y[:, None] == 1).astype(float) if free == 1 else np.eye(classes)[y]
    used = np.flatnonzero(on[:, 0])
    told = lambda z: _loss(z[used], y[used])[0] * c
    a, z, b = np.zeros((n, free)), np.zeros((n, free)), np.zeros(free)
    first = None
    for _ in range(most):
        p = _loss(z + b, y)[1]
        pull = c * on * (p - true)
        # the gradient is (X'g, h) and every vector of the search X'v too, so that inner products are v . XX'v
        g, h = a + pull, pull.sum(0)
        kg = times(g)
        norm = float((g * kg).sum() + (h * h).sum() / (c * n))
        first = norm if first is None else first
        if norm <= tol * tol * max(first, 1e-300):
            break
        curved = lambda v: c * on * _curved(p, v)  # noqa: B023, E731
        soft = max(float(curved(np.ones((n, free)))[:, 0].sum()) if free == 1 else c * n / classes, 1e-9)  # how curved intercepts are
        x, kx, xb = np.zeros_like(a), np.zeros_like(a), np.zeros_like(b)
        r, kr, rb = -g, -kg, -h
        d, kd, db = r.copy(), kr.copy(), rb / soft
        rho = start = float((r * kr).sum() + (rb * rb).sum() / soft)
        goal = min(0.1, (norm / first) ** 0.25) ** 2 * start
        for _ in range(inner):
            bent = curved(kd + db)
            hd, hb = d + bent, bent.sum(0)
            curve = float((hd * kd).sum() + (hb * db).sum())
            if curve <= 0:
                break
            step = rho / curve
            x, kx, xb = x + step * d, kx + step * kd, xb + step * db
            r, rb = r - step * hd, rb - step * hb
            kr = times(r)
            new = float((r * kr).sum() + (rb * rb).sum() / soft)
            if new <= goal:
                break
            d, kd, db = r + new / rho * d, kr + new / rho * kd, rb / soft + new / rho * db
            rho = new
        slope, now, t = float((g * kx).sum() + (h * xb).sum()), told(z + b) + 0.5 * float((a * z).sum()), 1.0
        while t > 1e-10 and told(z + b + t * (kx + xb)) + 0.5 * float(((a + t * x) * (z + t * kx)).sum()) > now + 1e-4 * t * slope + 1e-12 * abs(now):
            t /= 2
        a, z, b = a + t * x, z + t * kx, b + t * xb
    return scale * a, b


def coefficients(kept: DataFrame, a: np.ndarray) -> DataFrame:
    """gram, idf, weights (an array, a number per free class): X'a."""
    sent = kept.sparkSession.sparkContext.broadcast(a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, cells in enumerate(zip(*(batch.column(c) for c in CELLS), strict=True)):
                sizes, lengths, raw, docs = _read(tuple(x.as_buffer() for x in cells))
                w = np.column_stack([_sums(sizes, raw * _sums(lengths, sent.value[docs, k])) for k in range(sent.value.shape[1])])
                rows = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1]), pa.int32()), pa.array(w.ravel(), pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column("grams")[i].values, batch.column("idf")[i].values, rows], ["gram", "idf", "weights"])

    return kept.mapInArrow(run, "gram string, idf double, weights array<double>")
