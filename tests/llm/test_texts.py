"""Operators that judge a text by itself, or by a model: packing, quality, toxicity, tokens, likelihood, language."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm import common, decontaminate, language, lattice, packing, quality, tokens, toxicity

from .conftest import EDGES


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def encoded(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def check_packing(got, docs, tokenizer, size):
    want, seen = defaultdict(list), defaultdict(list)
    for d, t in docs:
        want[d].append([*encoded(tokenizer, t), 2])
    sequences = defaultdict(list)
    for r in got:
        assert r.length >= 1
        piece = np.array(next(x for x in want[r.doc_id] if len(x) == r.doc_tokens)[r.start : r.start + r.length], "<u4")
        assert len(piece) == r.length and zlib.crc32(piece.tobytes()) == r.ids_crc32
        seen[r.doc_id] += range(r.start, r.start + r.length)
        sequences[r.sequence_id].append((r.offset, r.length))
    for d, texts in want.items():
        assert sorted(seen[d]) == sorted(i for x in texts for i in range(len(x)))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= size
    lengths = [sum(n for _, n in p) for p in sequences.values()]
    return sum(0 if n & (n - 1) == 0 else size - n for n in lengths) / max(1, sum(lengths))


def test_packing(documents, rows, tokenizer):
    assert check_packing(packing.pack(documents).collect(), rows, tokenizer, 4096) < 0.05


def test_packing_of_edges(edges, tokenizer):
    assert check_packing(packing.pack(edges, size=64).collect(), [r[:2] for r in EDGES], tokenizer, 64) < 0.2
    assert packing.pack(edges.limit(0)).count() == 0


def brute_measures(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text or "") if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    repeated = {i + k for i, w in enumerate(windows) if w in twice for k in range(5)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated)


def test_quality_measures(documents, labels, rows, edges):
    got = quality.quality_rules(documents, labels).collect()
    text_of = dict(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_measures(text_of[r.doc_id])
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed and not r.rejected_by)
    assert len(got) == len(rows)
    assert quality.quality_rules(edges, labels).count() == len(EDGES)
    assert quality.quality_rules(edges.limit(0), labels.limit(0)).count() == 0


def test_binomial_tail_is_exact():
    for k, n, p in ((0, 10, Fraction(1, 20)), (3, 40, Fraction(1, 10)), (7, 7, Fraction(1, 2)), (12, 300, Fraction(1, 50))):
        exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert quality.tail(k, n, float(p)) == pytest.approx(float(exact), rel=1e-9)


def test_cutoffs_are_certified_only_with_enough_labels(spark):
    measured = [(i, "en", 100, 500, 200 if i % 2 else 0, 0, 0, 5) for i in range(4000)]
    measured += [(10_000 + i, "few", 100, 500, 200 if i % 2 else 0, 0, 0, 5) for i in range(40)]
    frame = spark.createDataFrame(measured, "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long")
    labelled = spark.createDataFrame([(r[0], int(r[4] == 0), 0) for r in measured], "doc_id long, quality int, toxic int")
    chosen = quality.certify(frame, labelled)
    assert chosen["en"] == {"symbols": 0.02} and chosen["few"] == {}
    false_drops = quality.apply_rules(frame, chosen).where("not kept").join(labelled, "doc_id").where("quality = 1").count()
    assert false_drops == 0


def test_toxicity_learns_and_restores(spark, edges, labels):
    clean, foul = "garden river market winter letter", "scumbag vermin garbage"
    rows = [(i, f"{clean} {foul} number {i}" if i % 3 == 0 else f"{clean} number {i}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(600)], "doc_id long, quality int, toxic int"))
    tried = ["garden vermin", "garden v3rm1n", "garden v e r m i n today", "garden verrrrmin", "garden winter", "", None]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(list(enumerate(tried)), "doc_id long, text string"), model).collect()}
    assert all("vermin" in got[i].evidence for i in range(4))
    assert all(got[i].score < 0.7 and got[i].predicted == 0 for i in (4, 5, 6))
    assert toxicity.toxicity(edges, labels).count() == len(EDGES)
    assert {r.score for r in toxicity.toxicity(edges, labels.limit(0)).collect()} == {toxicity.Scorer(toxicity.ToxicityModel({}, -700.0, {})).score(None)[0]}


def test_toxicity_on_the_held_out(documents, labels, data, spark):
    big = data.replace("sf0.001", "sf0.01")
    docs, truth = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    found = [(r.toxic, r.score) for r in toxicity.toxicity(docs, truth).where("held_out").join(truth, "doc_id").select("toxic", "score").collect()]
    pos, neg = [s for t, s in found if t], [s for t, s in found if not t]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert auc > 0.8


def test_token_counts(documents, rows, edges, tokenizer):
    for docs, given in ((documents, rows), (edges, [r[:2] for r in EDGES])):
        want = Counter((d, len((t or "").encode()), len(encoded(tokenizer, t)), len(encoded(tokenizer, t)) > 2048) for d, t in given)
        assert Counter(map(tuple, tokens.token_counts(docs, huge=5000).collect())) == want
    assert tokens.token_counts(edges.limit(0)).count() == 0


def test_resynchronisation_on_short_chunks(tokenizer):
    draw, enc = random.Random(7), tokens.encoder()
    for _ in range(60):
        text = "".join(draw.choice(["word", " ", "Don't", "12", "é", "漢字", "<|endoftext|>", "🙂", "\n", "aaaa", "...", "é"]) for _ in range(draw.randrange(1, 300)))
        assert tokens.resync_count(text, enc.starts, size=120, overlap=16)[0] == len(encoded(tokenizer, text))
    solid = "漢" * 700
    count, widened = tokens.resync_count(solid, enc.starts, size=100, overlap=8)
    assert count == len(encoded(tokenizer, solid)) and widened > 0


def test_lattice_sums_over_all_segmentations():
    weights = {p: math.log(w) for p, w in {"▁": 0.1, "▁a": 0.2, "a": 0.1, "b": 0.15, "ab": 0.05, "▁ab": 0.07, "ba": 0.03}.items()}
    model = lattice.Lattice(weights, [math.log(0.001)] * 256)

    def total(text):
        if not text:
            return 1.0
        return sum(math.exp(w) * total(text[len(p) :]) for p, w in weights.items() if text.startswith(p)) or 0.001 ** len(text[0].encode()) * total(text[1:])

    for word in ("a", "ab", "abba", "babab"):
        assert model.word(word.encode()) == pytest.approx(math.log10(total("▁" + word)), rel=1e-9)
        assert model.long_word("▁" + word) == pytest.approx(model.word(word.encode()), rel=1e-9)


@pytest.mark.parametrize("budget", [0, 900, 32 << 20])
def test_language_scores(spark, edges, budget):
    given = [r[:2] for r in EDGES]
    split = lambda t: (t or "").encode().lower().split()
    fold = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 5
    counts = Counter(w for d, t in given if fold(d) != 1 for w in [*split(t), None])
    n, v = sum(counts.values()), len(counts)
    value = lambda w: math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1)))
    want = sorted((str(d), fold(d) == 1, len(split(t)) + 1, sum(counts[w] > 0 for w in [*split(t), None]), n, round(sum(map(value, [*split(t), None])), 6)) for d, t in given)
    got = lattice.language_scores(edges, budget=budget).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    # the score: each word's probability under the lattice that is fitted to the training words, and the end's, once a text
    words = spark.createDataFrame([(bytearray(w), c) for w, c in counts.items() if w], "word binary, training long")
    model, end = lattice.fit_lattice(words, counts[None])
    scores = sorted((str(d), round(sum(model.word(w) for w in split(t)) + end, 6)) for d, t in given)
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in got) == scores
    assert lattice.language_scores(edges.limit(0)).count() == 0


def test_language_id(documents, edges):
    found = language.language_id(documents).where("held_out").join(documents.select("doc_id", "lang"), "doc_id").where("lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in found) / len(found) > 0.9
    got = {r.doc_id: r for r in language.language_id(edges).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.language_id(edges.limit(0)).count() == 0


def test_unseen_words_back_off():
    rows = [("en", 0, "the", 5), ("en", 3, "ing", 4), ("fr", 3, "ois", 4), ("fr", 0, "le", 5)]
    model = language.LanguageModel(rows)
    assert np.argmax(model.word("running")) == 0 and np.argmax(model.word("francois")) == 1


def spelled(restorer, token):
    """All readings of a token with their best scores, by enumeration."""
    texts = {"": 0.0}
    runs, i = [], 0
    while i < len(token):
        n = next((k for k in range(1, len(token) - i) if token[i + k] != token[i]), len(token) - i)
        runs.append((token[i], n))
        i += n
    for at, (c, n) in enumerate(runs):
        if c in toxicity.MASKS:
            ways = [("".join(x), -3.0 * n) for x in itertools.product(restorer.letters, repeat=n)] + ([("", -1.0 * n)] if 0 < at < len(runs) - 1 else [])
        else:
            ways = restorer.options(c, n)
        after = {}
        for text, s in texts.items():
            for x, cost in ways:
                after[text + x] = max(after.get(text + x, -math.inf), s + cost)
        texts = after
    log = lambda t: sum(restorer.model.log(("^^" + t)[i : i + 2], (t + "$")[i]) for i in range(len(t) + 1))
    return {t: s + log(t) for t, s in texts.items()}


def foul_model():
    words = {"vermin": 3.0, "scumbag": 2.5, "idiot": 2.0, "fugk": 2.0, "brat-": 1.5, "bratish": 1.0}
    trigrams = Counter(g for w in ["vermin", "scumbag", "idiot", "fugk", "bratish", "bratful", "garden", "river", "market", "winter", "letter"] * 20 for g in map("".join, zip("^^" + w, "^" + w + "$", w + "$")))
    return toxicity.ToxicityModel(words, -3.0, dict(trigrams))


def test_restoration_leaves_no_reading_out():
    model, draw = foul_model(), random.Random(3)
    tokens = ["f**k", "v3rm*n", "*diot", "idio*", "br4tly", "v-e-rm1n", "verrmiin", "br@t*", "letter", "1d1ot", "w1n*er", "vv3rmin"]
    for _ in range(150):
        word = list(draw.choice(["vermin", "idiot", "fugk", "bratly", "scumbag", "garden", "letter"]))
        for i in draw.sample(range(len(word)), 2):
            word[i] = draw.choice([word[i] * 3, word[i] + "-", "*" if "*" not in word else word[i], {"i": "1", "a": "4", "e": "3", "o": "0"}.get(word[i], word[i]), "x"])
        tokens.append("".join(word))
    for token in tokens:
        texts = spelled(model.restorer, token)
        best, want = max(texts.values()), set()
        for t, s in texts.items():
            if s >= best - 2.0 - 1e-9:
                want |= {x for x in (t, *toxicity.stems(t)) if x in model.weights}
        assert set(model.restorer.read_as(token)) == want, token


@pytest.mark.parametrize("token,word", [("br4tly", "brat-"), ("idio*", "idiot"), ("*diot", "idiot"), ("**iot", "idiot"), ("idi**", "idiot"), ("f**k", "fugk"), ("good/v3rm1n/" * 30, "vermin"), ("v3r" + "r" * 300 + "min", "vermin"), ("river,v3rm1n", "vermin"), ("**v3rm1n**", "vermin"), ("vermin/1d1ot", "idiot"), ("idio*,", "idiot"), ("river-v3rm1n", "vermin"), ("you/v-e-r-m-i-n", "vermin")])
def test_disguises_are_decoded(token, word):
    assert word in foul_model().evidence_of(token)


def test_plain_tokens_show_nothing():
    model = foul_model()
    for token in ["garden", "letter", "winter?", "river/market", "w1nter", "50%", "a*b", "*" * 5000 + "a", "a" + "*" * 5000 + "b", "x/" * 5000]:
        assert model.evidence_of(token) == ()
    assert model.evidence_of("v3rmin" + "*" * 5000) == ("vermin",)


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="another vocabulary"):
        tokens.encoder("other.json")


def test_toxicity_learns_from_all_labelled_rows(spark):
    n = 36_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("zqx w"), F.col("id").cast("string")).alias("text"))
    model = toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") % 7 == 0).cast("int").alias("toxic")))
    learnt = sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(n))
    assert learnt > 20_000 and model.restorer.model.three["zqx"] == learnt


def test_a_worker_keeps_one_operators_cache():
    one, two = {"a": 1}, {"b": 2}
    common.alone(one)
    common.alone(two)
    assert not one and two
    common.CACHES[:] = [c for c in common.CACHES if c is not one and c is not two]


def test_labelled_texts_are_found_without_a_shuffle_of_all_texts(spark):
    """One text of each sketch and label, the one of the least id; rows that are repeated count once, and of a repeated id every sketch."""
    rows = [(i, f"a{i} b{i} c{i} d{i}") for i in range(300)]
    rows += [(1, rows[1][1]), (2, "another text of the second id"), (400, rows[7][1]), (401, rows[7][1]), (None, "a text without an id"), (402, None), (403, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    truth = spark.createDataFrame([(i, int(i in (401, 3))) for i in (*range(0, 300, 2), 1, 3, 7, 400, 401, 402, 403, 999)], "doc_id long, toxic int")
    got = sorted((r.text or "", r.toxic) for r in toxicity.observed(docs, truth).collect())
    odd = [(rows[i][1], int(i == 3)) for i in (1, 3, 7)]
    assert got == sorted([*((rows[i][1], 0) for i in range(0, 300, 2)), *odd, (rows[7][1], 1), ("another text of the second id", 0), ("", 0)])
    kept = toxicity._among(docs, truth, "doc_id")
    assert kept.where(F.col("doc_id") < 300).count() < 250 and "Exchange" not in kept._jdf.queryExecution().executedPlan().toString()


def test_words_of_test_items_are_runs_of_letters_and_digits():
    text = bytes(range(256)) * 2 + "Größe, 12ab'cd\nÉ".encode()
    assert decontaminate.words_of(text) == re.findall(rb"[0-9a-z\x80-\xff]+", text.lower()) and decontaminate.words_of(None) == []


def test_batches_of_long_texts_are_bounded_by_bytes(spark):
    """A worker process gets a few MB of text at a time, however long the texts are."""
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    texts = spark.range(0, 400, 1, 1).selectExpr("repeat('long text ', 10000) AS text")
    assert max(r.n for r in common.written(texts.mapInArrow(sizes, "n long"), "sizes").collect()) < 8 << 20


def test_ids_are_kept_as_bytes():
    enc = tokens.encoder()
    text = "Don't pack <|x|> naïve 漢字 12345 words, words!"
    assert enc.ids(text.encode()).tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids and enc.count(text.encode()) == len(enc.ids(text.encode()))
    assert all(isinstance(x, bytes) for x in enc.words.values())
