"""Quality rules with risk-controlled thresholds.

Whole texts are measured once; labelled holdouts then decide, per stratum and rule, which cutoffs are safe. A cutoff is
certified when the exact binomial test rejects "it drops more than `risk` of the good documents" at a level corrected for
all strata, rules and cutoffs tried (Bonferroni). The strictest certified cutoff that drops more bad than good is used;
with too few labels nothing is certified and the rule stays off.

Defined cases: null text has no words and fails the base rule; a null or unseen stratum gets no rule; several labels of
one document count as its lowest quality; repeated documents are judged row by row; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MEASURES = pa.schema([("doc_id", pa.int64()), ("stratum", pa.string()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("n_lines", pa.int64())])
MEASURES_DDL = "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


@dataclass(frozen=True)
class Rule:
    """Drops documents whose metric is above the cutoff; cutoffs run from strict to lenient."""

    name: str
    metric: str
    cutoffs: tuple[float, ...]


RULES = (
    Rule("symbols", "n_symbols / greatest(word_chars, 1)", (0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3, 0.5)),
    Rule("duplicate_lines", "n_dup_lines / greatest(n_lines, 1)", (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.6, 0.8)),
    Rule("repeated_words", "n_repeat_words / greatest(n_words, 1)", (0.02, 0.04, 0.06, 0.08, 0.1, 0.12, 0.15, 0.18)),
    Rule("long_words", "word_chars / greatest(n_words, 1)", (7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0, 30.0)),
    Rule("few_words", "-cast(n_words as double)", (-80.0, -60.0, -50.0, -40.0, -30.0, -25.0, -20.0, -15.0)),
)


def repeat_words(words: list[bytes]) -> int:
    """Words inside 5-word windows that occur twice or more in the text, the first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    codes = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    size, key = len(seen), codes[: len(codes) - 1] * len(seen) + codes[1:]
    if size > 6000:  # five codes don't fit into 63 bits: number the pairs, then the fours, exactly
        _, key = np.unique(key, return_inverse=True)
        _, key = np.unique(key[:-2] * (int(key.max()) + 1) + key[2:], return_inverse=True)
        key = key[:n] * size + codes[4:]
    else:
        key = ((key[:-3] * size + codes[2:-2]) * size + codes[3:-1]) * size + codes[4:]
    _, at, times = np.unique(key, return_inverse=True, return_counts=True)
    twice = times[at] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += twice
    edge[WINDOW:] -= twice
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure_text(text: bytes | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.split()  # bytes.split cuts at x20 and x09-x0D, no more
    chars = sum(len(w) for w in words) if text.isascii() else len(b"".join(words).decode())
    earlier: set[bytes] = set()
    lines = dup = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            dup += line in earlier
            earlier.add(line)
    return len(words), chars, sum(map(text.count, (bytes([c]) for c in SYMBOLS))), dup, repeat_words(words), lines


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = list(zip(*map(measure_text, common.texts(batch)), strict=True)) or [()] * 6
        yield common.as_batch({"doc_id": common.ids(batch), "stratum": common.ids(batch, "stratum")} | dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"), map(list, rows), strict=True)), MEASURES)


def measure(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """One row per document with the counts of its whole text."""
    return docs.select(F.col("doc_id").cast("long"), F.col(stratum).cast("string").alias("stratum"), "text").mapInArrow(_measure, MEASURES_DDL)


def tail(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k). The terms are summed from k, or from the likeliest below it, outwards until they no longer count in
    double precision: a multiple of the deviation of them, whatever n."""
    if k >= n:
        return 1.0
    top = min(k, math.floor((n + 1) * p))
    terms, odds = [1.0], p / (1 - p)
    for step, last in ((-1, 0), (1, k)):
        i, term = top, 1.0
        while i != last and term > 1e-20:
            term *= i / (n - i + 1) / odds if step < 0 else (n - i) / (i + 1) * odds
            i += step
            terms.append(term)
    log = math.lgamma(n + 1) - math.lgamma(top + 1) - math.lgamma(n - top + 1) + top * math.log(p) + (n - top) * math.log1p(-p)
    return min(1.0, math.exp(log) * math.fsum(terms))


def certify(measured: DataFrame, labels: DataFrame, risk: float = 0.05, level: float = 0.05, rules: tuple[Rule, ...] = RULES) -> dict[str, dict[str, float]]:
    """Cutoffs by stratum and rule. The risk is shared out over the rules, so that all together drop at most `risk` of the good."""
    quality = labels.where("quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    hit = lambda r, c: F.expr(f"({r.metric}) > {c}D")
    known = measured.where("stratum is not null").join(quality, "doc_id")
    tests = [(r, i, c) for r in rules for i, c in enumerate(r.cutoffs)]
    found = known.groupBy("stratum").agg(
        F.count_if(F.col("quality") == 1).alias("good"),
        *[F.count_if(hit(r, c) & (F.col("quality") == q)).alias(f"{r.name}_{i}_{q}") for r, i, c in tests for q in (0, 1)],
    ).collect()
    most = level / max(1, len(tests) * len(found))
    chosen: dict[str, dict[str, float]] = {}
    for row in found:
        safe = [(r, c) for r, i, c in tests if row["good"] and row[f"{r.name}_{i}_0"] > row[f"{r.name}_{i}_1"] and tail(row[f"{r.name}_{i}_1"], row["good"], risk / len(rules)) <= most]
        chosen[row["stratum"]] = {r.name: min(c for s, c in safe if s is r) for r in {s for s, _ in safe}}
    return chosen


def apply_rules(measured: DataFrame, chosen: dict[str, dict[str, float]], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """base_failed, rejected_by and kept from the counts. The cutoffs are a row per stratum: broadcasting them is safe."""
    rows = [(s, *(float(v[r.name]) if r.name in v else None for r in rules)) for s, v in chosen.items()]
    cut = measured.sparkSession.createDataFrame(rows, "stratum string, " + ", ".join(f"cut_{r.name} double" for r in rules))
    out = measured.join(F.broadcast(cut), "stratum", "left")
    base = F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")
    reasons = F.array_compact(F.array(*[F.when(F.expr(f"({r.metric}) > cut_{r.name}"), F.lit(r.name)) for r in rules]))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & (F.size(reasons) == 0)).alias("kept"), reasons.alias("rejected_by"))


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = 0.05, level: float = 0.05, stratum: str = "lang") -> DataFrame:
    measured = common.written(measure(docs, stratum), "quality")
    return apply_rules(measured, certify(measured, labels, risk, level))
