"""Language identification by known words first, backing off to shorter and shorter character n-grams.

Word and n-gram frequencies by language are counted in Spark over a bounded sample of the labelled rows (`sample_rows` per
language, drawn by a hash of the id; the bound makes the model small enough to send to every task). What occurs there fewer
than `min_times` times in a language is not part of the model: seen once, it tells chance from language badly. A known word adds
its smoothed log frequency in each language. An unseen one takes the longest n for which any of its n-grams is known, and adds
the mean log frequency of those. The prediction is the language with the largest sum, ties to the name that sorts first;
the score is its share of the posterior.

Defined cases: null text and text without a letter are `und` with score 0, as is every text when nothing can be learned;
rows with a null language or id teach nothing (a null id predicts as usual); repeated rows count each; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import Generations

LONGEST = 5
LETTERS = re.compile(r"[^\W\d_]+").findall
ASCII_LETTER = re.compile(rb"[A-Za-z]").search
GRAMS = pa.schema([("lang", pa.string()), ("n", pa.int32()), ("gram", pa.string()), ("times", pa.int64())])
PREDICTED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words (n = 0) and n-grams by language, summed up for each batch before the shuffle."""
    for whole in batches:
        for batch in common.slices(whole, most=4 << 20):
            words: Counter = Counter()
            for text, lang in zip(common.texts(batch), common.ids(batch, "lang"), strict=True):
                words.update((lang, w) for w in LETTERS((text or b"").decode().lower()))
            found: Counter = Counter()
            for (lang, w), times in words.items():
                found[lang, 0, w] += times
                for n in range(1, LONGEST + 1):
                    for g in grams(w, n):
                        found[lang, n, g] += times
            rows = list(zip(*((*k, v) for k, v in found.items()), strict=True)) or [()] * 4
            yield common.as_batch(dict(zip(GRAMS.names, map(list, rows), strict=True)), GRAMS)


class LanguageModel:
    """Log frequencies by gram; `rows` holds (lang, n, gram, times)."""

    def __init__(self, rows: list[tuple[str, int, str, int]]):
        self.langs = sorted({r[0] for r in rows})
        self.known: list[dict[str, tuple[float, ...]]] = []
        for n in range(LONGEST + 1):
            times: dict[str, Counter] = {}
            for lang, k, gram, v in rows:
                if k == n:
                    times.setdefault(gram, Counter())[lang] += v
            total = Counter()
            for c in times.values():
                total.update(c)
            base = [math.log(total[x] + 0.5 * (len(times) + 1)) for x in self.langs]
            self.known.append({g: tuple(math.log(c[x] + 0.5) - b for x, b in zip(self.langs, base, strict=True)) for g, c in times.items()})

    def word(self, word: str) -> tuple[float, ...]:
        if (got := self.known[0].get(word)) is not None:
            return got
        for n in range(LONGEST, 0, -1):
            known = self.known[n]
            if found := [known[g] for g in grams(word, n) if g in known]:
                return tuple(sum(x) / len(found) for x in zip(*found, strict=True))
        return (0.0,) * len(self.langs)


class Scorer(Generations):
    """From a raw word to its log likelihood by language."""

    def __init__(self, model: LanguageModel):
        super().__init__()
        self.model = model

    def made(self, word: bytes) -> tuple[float, ...]:
        parts = [self.model.word(w) for w in LETTERS(word.decode().lower())]
        return parts[0] if len(parts) == 1 else tuple(map(sum, zip(*parts, strict=True))) if parts else (0.0,) * len(self.model.langs)

    def predict(self, text: bytes | None) -> tuple[str, float]:
        if not text or not self.model.langs or not (ASCII_LETTER(text) or any(map(str.isalpha, text.decode()))):
            return "und", 0.0
        values = np.array([self[w] for w in text.split()]).sum(0)
        best = int(values.argmax())
        return self.model.langs[best], float(1 / np.exp(values - values[best]).sum())


def fit(docs: DataFrame, sample_rows: int = 2000, min_times: int = 2, folds: int = 5, held_out: int = 0) -> LanguageModel:
    """Learns from documents outside the held-out fold: about sample_rows of each language, a share drawn by a hash of the id."""
    train = docs.where("lang is not null and text is not null and doc_id is not null").where(common.key_fold("doc_id", folds) != held_out)
    counts = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}
    if not counts:
        return LanguageModel([])
    share = F.create_map(*[x for k, v in counts.items() for x in (F.lit(k), F.lit(min(1.0, sample_rows / v)))])
    drawn = train.where(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
    found = drawn.select("lang", "text").mapInArrow(_count, "lang string, n int, gram string, times long").groupBy("lang", "n", "gram").agg(F.sum("times").alias("times"))
    return LanguageModel([tuple(r) for r in found.where(F.col("times") >= min_times).toArrow().to_pandas().itertuples(index=False)])


def identify(docs: DataFrame, model: LanguageModel, folds: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text; reads no column but doc_id and text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            doc_ids = common.ids(batch)
            found = [scorer.predict(t) for t in common.texts(batch)]
            yield common.as_batch({"doc_id": doc_ids, "held_out": [common.fold_of(i, folds) == held_out for i in doc_ids], "lang_pred": [x for x, _ in found], "score": [x for _, x in found]}, PREDICTED)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def language_id(docs: DataFrame, **parameters) -> DataFrame:
    return identify(docs, fit(docs.select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string")), **parameters))
