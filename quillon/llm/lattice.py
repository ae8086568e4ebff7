"""Language-model scores: a word's probability is the sum over all its segmentations into known pieces.

The pieces are those of an existing public vocabulary; a unigram weight for each is estimated from the training documents
(pieces of the vocabulary's own segmentation, weighted by how often a word occurs, with add-half smoothing), since that
vocabulary carries merge ranks in place of probabilities. Pieces never cross white space, so the marginal probability of a
text is the product over its words and its end, and the forward recursion runs once for each distinct word.

Spark counts the words of all documents. Every distinct word gets its training count and its marginal log probability once. The
most frequent words, as far as they fit a `budget` of bytes by sums over classes of counts, are looked up inside the tasks that
read the texts; all rarer words are joined with the vocabulary by a shuffle and summed up by document. Both ways are exact.

Defined cases: null text counts as empty and has the end only; repeated rows are scored each, repeated ids too; a corpus without
training documents has N = V = 0 and every token is unknown; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PIECES = "piece_bpe_32k.model"
LOG10 = math.log(10)
SPACE = "▁"


def tokens_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()  # bytes.lower changes A-Z alone, bytes.split cuts at x20 and x09-x0D


def _word_counts(folds: int, held_out: int):
    schema = pa.schema([("word", pa.binary()), ("times", pa.int64()), ("training", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums up what a bounded stretch of texts holds before the shuffle."""
        both, size = (Counter(), Counter()), 0

        def flush():
            words = list(both[0].keys() | both[1].keys())
            return common.as_batch({"word": words, "times": [both[0][w] + both[1][w] for w in words], "training": [both[1][w] for w in words]}, schema)

        for batch in batches:
            for text, doc_id in zip(common.texts(batch), common.ids(batch), strict=True):
                both[common.fold_of(doc_id, folds) != held_out].update(tokens_of(text))
                size += len(text or b"")
                if size > 32 << 20:
                    yield flush()
                    both, size = (Counter(), Counter()), 0
        yield flush()

    return run


class Lattice:
    """log10 of the marginal probability of a word under unigram piece weights (natural logs)."""

    def __init__(self, weights: dict[str, float], bytes_of: list[float]):
        self.weights, self.bytes_of = {k: math.exp(v) for k, v in weights.items()}, bytes_of
        self.longest = max(map(len, weights), default=1)

    def fallback(self, c: str) -> float:
        return math.exp(max(-600.0, sum(self.bytes_of[b] for b in c.encode())))

    def word(self, word: bytes) -> float:
        text = SPACE + word.decode()
        n, get, longest = len(text), self.weights.get, self.longest
        if n > 20:
            return self.long_word(text)
        forward = [1.0]
        for end in range(1, n + 1):
            total = forward[end - 1] * (get(text[end - 1]) or self.fallback(text[end - 1]))
            for start in range(max(0, end - longest), end - 1):
                if (w := get(text[start:end])) is not None:
                    total += forward[start] * w
            forward.append(total)
        return math.log(forward[n]) / LOG10 if forward[n] > 1e-290 else self.long_word(text)

    def long_word(self, text: str) -> float:
        """The same recursion on logarithms, for words whose probability a double may not hold."""
        forward, get = [0.0], self.weights.get
        for end in range(1, len(text) + 1):
            terms = [forward[end - 1] + math.log(get(text[end - 1]) or self.fallback(text[end - 1]))]
            terms += [forward[start] + math.log(w) for start in range(max(0, end - self.longest), end - 1) if (w := get(text[start:end])) is not None]
            top = max(terms)
            forward.append(top + math.log(sum(math.exp(x - top) for x in terms)))
        return forward[-1] / LOG10


def _piece_counts(vocabulary: str):
    schema = pa.schema([("piece", pa.int64()), ("times", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor, total = _processor(vocabulary), np.zeros(0, np.int64)
        for batch in batches:
            words, times = common.texts(batch, "word"), np.array(common.ids(batch, "training"), np.int64)
            found = processor.encode([w.decode() for w in words], num_threads=1)
            total = np.zeros(processor.get_piece_size(), np.int64) if not len(total) else total
            np.add.at(total, np.fromiter((i for f in found for i in f), np.int64), np.repeat(times, [len(f) for f in found]))
        at = np.flatnonzero(total)
        yield common.as_batch({"piece": pa.array(at), "times": pa.array(total[at])}, schema)

    return run


def _processor(vocabulary: str):
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))


def fit_lattice(words: DataFrame, documents: int, vocabulary: str = PIECES) -> tuple[Lattice, float]:
    """The lattice and the end's log10 probability. What comes to the driver is a count per piece of the fixed vocabulary."""
    processor = _processor(vocabulary)
    found = words.where("training > 0").select("word", "training").mapInArrow(_piece_counts(vocabulary), "piece long, times long").groupBy("piece").agg(F.sum("times").alias("times")).collect()
    times = np.zeros(processor.get_piece_size())
    for r in found:
        times[r["piece"]] = r["times"]
    total = math.log(times.sum() + documents + 0.5 * (len(times) + 1))
    logs = np.log(times + 0.5) - total
    weights = {processor.id_to_piece(i): float(logs[i]) for i in range(len(times)) if not (processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i))}
    by_byte = [float(logs[processor.piece_to_id(f"<0x{b:02X}>")]) for b in range(256)]
    return Lattice(weights, by_byte), (math.log(documents + 0.5) - total) / LOG10


def language_scores(docs: DataFrame, budget: int = 32 << 20, folds: int = 5, held_out: int = 1, vocabulary: str = PIECES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text. budget: bytes of words that may be
    broadcast with their values, the most frequent first; the values of the others are joined."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    counted = docs.mapInArrow(_word_counts(folds, held_out), "word binary, times long, training long").groupBy("word").agg(F.sum("times").alias("times"), F.sum("training").alias("training"))
    words = common.written(counted, "words")
    trained = docs.where(common.key_fold("doc_id", folds) != held_out).count()
    n, v = words.agg(F.coalesce(F.sum("training"), F.lit(0)), F.count_if(F.col("training") > 0)).first()
    n, v = n + trained, v + (trained > 0)
    lattice, end_score = fit_lattice(words, trained, vocabulary)
    base_total = math.log10(n + 0.5 * (v + 1))
    sent = spark.sparkContext.broadcast(lattice)

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("word", pa.binary()), ("times", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("marginal", pa.float64())])
        for batch in batches:
            found, training = common.texts(batch, "word"), common.ids(batch, "training")
            yield common.as_batch({"word": found, "times": common.ids(batch, "times"), "known": [int(c > 0) for c in training], "base": [math.log10(c + 0.5) - base_total for c in training], "marginal": [sent.value.word(w) for w in found]}, schema)

    values = common.written(words.mapInArrow(valued, "word binary, times long, known long, base double, marginal double"), "word-values")
    cut, _ = common.head_class(values, "word", "times", budget, each=200)
    top = values.where(common.count_class("times") >= cut).toArrow()  # within the budget
    in_head = {w: i for i, w in enumerate(top["word"].to_pylist())}
    sent_head = spark.sparkContext.broadcast((in_head, np.column_stack([top["known"].to_numpy(), top["base"].to_numpy(), top["marginal"].to_numpy()]) if top.num_rows else np.zeros((0, 3))))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per text for its end and its head words (word null), and one per distinct rarer word."""
        schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("word", pa.binary()), ("times", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("marginal", pa.float64())])
        index, table = sent_head.value
        end = (int(trained > 0), math.log10(trained + 0.5) - base_total, end_score)
        for whole in batches:
            for batch in common.slices(whole, most=4 << 20):
                out: list[tuple] = []
                for row, doc_id, text in zip(common.ids(batch, "row"), common.ids(batch), common.texts(batch), strict=True):
                    found = tokens_of(text)
                    at = np.fromiter((index.get(w, -1) for w in found), np.int64, len(found))
                    sums = table[at[at >= 0]].sum(0) + end
                    out.append((row, doc_id, None, len(found) + 1, int(sums[0]), float(sums[1]), float(sums[2])))
                    if (at < 0).any():
                        out += [(row, doc_id, w, k, None, None, None) for w, k in Counter(found[i] for i in np.flatnonzero(at < 0)).items()]
                yield common.as_batch(dict(zip(schema.names, map(list, zip(*out, strict=True)) if out else [[]] * 7, strict=True)), schema)

    rows = docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(first, "row long, doc_id long, word binary, times long, known long, base double, marginal double")
    rows = common.written(rows, "text-words")  # read twice, and the row numbers must stay the same
    rare = rows.where("word is not null").select("row", "doc_id", "word", F.col("times").alias("k")).join(values.where(common.count_class("times") < cut), "word")
    sums = rare.groupBy("row", "doc_id").agg(F.sum(F.col("k") * F.col("known")).alias("known"), F.sum(F.col("k") * F.col("base")).alias("base"), F.sum(F.col("k") * F.col("marginal")).alias("marginal"))
    whole = rows.where("word is null").select("row", "doc_id", "times", "known", "base", "marginal").unionByName(sums.select("row", "doc_id", F.lit(0).cast("long").alias("times"), "known", "base", "marginal"))
    return whole.groupBy("row", "doc_id").agg(F.sum("times").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("marginal").alias("score")).select(
        "doc_id", (common.key_fold("doc_id", folds) == held_out).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score"
    )
