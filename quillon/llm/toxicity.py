"""Toxicity by noisy-channel deobfuscation: restore what the writer disguised, then score the restored text.

Learning (in Spark, over all labelled rows outside the held-out fold; of rows whose least hash of three words is the same, copies and
near copies, one for each label):
document frequencies of words by label, and a character trigram model of words (trigrams seen less than three times are left to its
smoothing). A word or stem is toxic evidence when an exact binomial test, corrected for the number of words tested, rejects that it
is as common in clean rows, and its log odds outweigh the prior: a text with that word alone is toxic rather than not. (Words of weaker
odds say more about which texts have copies than about their tone.) Its weight is the lower 99 % bound of its log odds. What is seen so seldom that
the test could not reject it even without a clean row stays in Spark, words of three toxic rows excepted: a stem counts only if three
or more such words, commoner in toxic rows than in clean ones, have it.

Scoring: a token that is disguised (leetspeak, symbols inside, long letter runs, letters set apart) becomes a lattice: each
character may stand for itself, for the letters it imitates, for any letter (a mask such as *), for nothing (a separator), and
a run may be one letter or two, a run of masks as many letters. Viterbi search under the character model finds what was meant: the
evidence whose best reading is at most 2 less likely than the best of all. The document's log odds are the prior plus the weights of
the distinct toxic words of its plain and its restored tokens. Lattices that no toxic word or stem can come out of, which a search
along a trie of the evidence tells exactly, need no search over all texts. Masks at the ends of a token stand for letters or are
decoration; a question mark there is punctuation.

Defined cases: null and empty texts get the prior alone; a document with several labels counts as toxic if one says so; without
labels of both kinds nothing is evidence and all score the prior (0 without labels); repeated rows are scored each.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .quality import tail
from .tokens import Generations

WORDS = re.compile(r"[^\W\d_]+").findall
#: Words that must have a stem, and toxic rows that such a word must be in.
FORMS = 3
#: Letters that a character may stand for besides itself (fixed values).
IMITATES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "¡": "i"}
MASKS = "*#%&?"
SEPARATORS = ".-_~,:;'/\\ *+"
DISGUISED = re.compile(r"[^\W\d_](?:.*[0-9@$!|+€£(¡*#%&?.\-_~'].*)[^\W_]|[0-9@$!|€£(¡*#%&?].*[^\W\d_]|[^\W\d_].*[0-9@$!|€£(¡*#%&]|(\w)\1").search
RUNS = re.compile(r"(.)\1*").finditer
PUNCTUATION = re.compile(r"[,;:/\\\"()\[\]{}<>=…–—]+|[.-]{2,}")
PARTING = re.compile(r"[^\w@$!|+€£(¡*#%&?]+|_+")
SPACED = re.compile(r"(?<!\S)(?:[^\s][ ._\-~*]{1,3}){3,}[^\s](?!\S)")
SPACED_BYTES = re.compile(rb"(?<!\S)\S{1,2}[ ._\-~*]{1,3}\S{1,2}[ ._\-~*]{1,3}\S{1,2}[ ._\-~*]").search
DOUBLED = re.compile(r"(\w)\1").search
HEAD = 4
SURE = 2.58
COST = {"itself": 0.0, "imitates": -1.5, "mask": -3.0, "nothing": -1.0, "dropped": -12.0, "merged": -0.5}
SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("evidence", pa.list_(pa.string()))])


def stems(word: str) -> list[str]:
    """Proper beginnings of four to eight letters, marked by a hyphen."""
    return [word[:n] + "-" for n in range(4, min(9, len(word)))]


class CharacterModel:
    """Trigram model of words' letters with backoff; ^ starts and $ ends a word."""

    def __init__(self, trigrams: dict[str, int]):
        self.three, self.two, self.pairs, self.ones = trigrams, Counter(), Counter(), Counter()
        for g, v in trigrams.items():
            self.two[g[:2]] += v
            self.pairs[g[1:]] += v
            self.ones[g[1]] += v
        self.size = max(2, len(self.ones) + 1)
        self.memo: dict[tuple[str, str], float] = {}

    def log(self, history: str, c: str) -> float:
        if (got := self.memo.get((history, c))) is None:
            low = (self.pairs[history[1] + c] + 1) / (self.ones[history[1]] + self.size)
            got = self.memo[history, c] = math.log((self.three.get(history + c, 0) + 3 * low) / (self.two[history] + 3))
        return got


class FreeSearch:
    """The best reading of all of a lattice, over any letters. The scores of all histories are one matrix (last letter but one, last
    letter). A trigram that was never seen scores by its pair alone, and a seen one higher, so that a step is the pairs' maximum and
    the seen trigrams on top. Letters the model doesn't know are alike and share an index."""

    def __init__(self, model: CharacterModel, letters: list[str]):
        self.at = {c: i for i, c in enumerate(["^", *letters])}
        self.other, self.n = len(self.at), len(self.at) + 1
        size = self.n + 1  # the last column is the end of the word
        name = lambda c: self.n if c == "$" else self.at[c]
        ones = np.zeros(self.n)
        low = np.ones((self.n, size))
        seen = np.full((self.n, self.n), 3.0)
        for c, v in model.ones.items():
            if c in self.at:
                ones[self.at[c]] = v
        for g, v in model.pairs.items():
            if g[0] in self.at:
                low[self.at[g[0]], name(g[1])] += v
        for g, v in model.two.items():
            seen[self.at[g[0]], self.at[g[1]]] += v
        self.low = np.log(3 * low / (ones[:, None] + model.size))
        self.seen = -np.log(seen)
        found = [(self.at[g[0]], self.at[g[1]], name(g[2]), model.log(g[:2], g[2])) for g in model.three]
        found.sort(key=lambda t: t[2])
        self.trigrams = tuple(np.array(c) for c in zip(*found, strict=True)) if found else tuple(np.zeros(0, t) for t in (int, int, int, float))
        self.starts = np.searchsorted(self.trigrams[2], np.arange(size + 1))

    def start(self) -> np.ndarray:
        out = np.full((self.n, self.n), -np.inf)
        out[0, 0] = 0.0
        return out

    def column(self, states: np.ndarray, pairs: np.ndarray, x: int) -> np.ndarray:
        """Scores after the letter x, by the letter before it."""
        out = pairs + self.low[:, x]
        part = slice(self.starts[x], self.starts[x + 1])
        first, second, _, value = (t[part] for t in self.trigrams)
        np.maximum.at(out, second, states[first, second] + value)
        return out

    def letter(self, states: np.ndarray, c: str) -> np.ndarray:
        x = self.at.get(c, self.other)
        out = np.full_like(states, -np.inf)
        out[:, x] = self.column(states, (states + self.seen).max(0), x)
        return out

    def any_letter(self, states: np.ndarray) -> np.ndarray:
        """After any of the model's letters."""
        out = (states + self.seen).max(0)[:, None] + self.low[:, : self.n]
        first, second, third, value = (t[: self.starts[self.n]] for t in self.trigrams)
        np.maximum.at(out, (second, third), states[first, second] + value)
        out[:, [0, self.other]] = -np.inf
        return out

    def end(self, states: np.ndarray) -> float:
        return float(self.column(states, (states + self.seen).max(0), self.n).max())


class Restorer:
    """Viterbi over a token's lattice. A state is the last two letters and where the text stands in a trie of the evidence: a node of
    the trie, or the stem that it has behind it. No state is left out. FreeSearch is the same search without the trie."""

    def __init__(self, model: CharacterModel, evidence: Iterable[str]):
        self.model, self.letters = model, [c for c in model.ones if c not in "^$"]
        self.kids: list[dict[str, int]] = [{}]
        self.word_at: dict[int, str] = {}
        self.stem_at: dict[int, str] = {}
        self.first: dict[str, bool] = {}
        self.memo: dict[tuple[str, bool], list[tuple[str, float]]] = {}
        self.free = FreeSearch(model, self.letters)
        self.heads: dict[str, dict] = {}
        self.longest = 0
        for e in evidence:
            node = 0
            for c in e.removesuffix("-"):
                if c not in self.kids[node]:
                    self.kids[node][c] = len(self.kids)
                    self.kids.append({})
                node = self.kids[node][c]
            (self.stem_at if e.endswith("-") else self.word_at)[node] = e
            self.longest = max(self.longest, len(e))
        # the least log of a letter; a run of masks changes the histories of at most three
        least = math.log(3 / (max(model.ones.values(), default=0) + model.size) / (max(model.two.values(), default=0) + 3))
        self.no_letters = 3 * -least / (COST["nothing"] - COST["mask"])

    def options(self, c: str, run: int) -> list[tuple[str, float]]:
        out = []
        if c.isalpha():
            out = [(c, COST["itself"] if run == 1 else COST["merged"])] + ([(c * 2, COST["itself"])] if run > 1 else [])
        for x in IMITATES.get(c, ""):
            out += [(x, COST["imitates"])] + ([(x * 2, COST["imitates"])] if run > 1 else [])
        if c in SEPARATORS or not c.isalnum():
            out.append(("", COST["dropped"] if c in IMITATES else COST["nothing"]))
        return out or [("", COST["mask"])]

    def step(self, states: dict, letters: Iterable[str] | None, cost: float) -> dict:
        """The states after one more letter: any of `letters`, or any at all."""
        after: dict[tuple[int | str, str], float] = {}
        for (node, h), s in states.items():
            kids, free = ({}, node) if isinstance(node, str) else (self.kids[node], self.stem_at.get(node))
            for x in letters or (kids if free is None else self.letters):
                kid = kids.get(x)
                if kid is None and free is None:
                    continue
                new, key = s + cost + self.model.log(h, x), h[1] + x
                if kid is not None and new > after.get((kid, key), -math.inf):
                    after[kid, key] = new
                if free is not None and new > after.get((free, key), -math.inf):
                    after[free, key] = new
        return after

    def ways(self, c: str, n: int) -> list[tuple[str, float]]:
        if (key := (c, n > 1)) not in self.memo:
            self.memo[key] = self.options(c, n)
        return self.memo[key]

    def best(self, token: str) -> float:
        """The score of the likeliest of all readings."""
        free, states = self.free, self.free.start()
        for m in RUNS(token):
            c, n, after = m[1], m.end() - m.start(), None
            if c in MASKS:
                inside, lots = 0 < m.start() and m.end() < len(token), []
                if not inside or n <= self.no_letters:
                    now = states
                    for _ in range(n):
                        now = free.any_letter(now) + COST["mask"]
                    lots.append(now)
                if inside:
                    lots.append(states + n * COST["nothing"])
            else:
                lots = []
                for letters, cost in self.ways(c, n):
                    now = states
                    for x in letters:
                        now = free.letter(now, x)
                    lots.append(now + cost)
            for now in lots:
                after = now if after is None else np.maximum(after, now)
            states = after
        return free.end(states)

    def forward(self, token: str) -> dict[str, float]:
        """The best score of each piece of evidence that the token can be read as. Most tokens share their first HEAD characters with
        others, so that what comes of those is kept."""
        head = token[:HEAD]
        if len(token) <= HEAD or token[HEAD] == head[-1] or any(c in MASKS for c in head):
            states = self.advance({(0, "^^"): 0.0}, token, 0)
        else:
            if (states := self.heads.get(head)) is None:
                if len(self.heads) > 10_000:
                    self.heads.clear()
                states = self.heads[head] = self.advance({(0, "^^"): 0.0}, head, 0)
            states = self.advance(states, token, HEAD) if states else states
        found: dict[str, float] = {}
        for (node, h), s in states.items():
            if (e := node if isinstance(node, str) else self.word_at.get(node)) is not None:
                found[e] = max(found.get(e, -math.inf), s + self.model.log(h, "$"))
        return found

    def advance(self, states: dict, token: str, at: int) -> dict:
        """The states after the rest of the token from `at`, where a run begins."""
        for m in RUNS(token, at):
            c, n, ways = m[1], m.end() - m.start(), []
            if c in MASKS:  # as many letters; inside a word also nothing
                inside = 0 < m.start() and m.end() < len(token)
                if not inside or n <= self.no_letters:  # else leaving out is likelier, whatever comes next
                    now = states
                    for _ in range(n):
                        now = self.step(now, None, COST["mask"])
                    ways.append(now)
                if inside:
                    ways.append({k: s + n * COST["nothing"] for k, s in states.items()})
            else:
                for letters, cost in self.ways(c, n):
                    now = states if not cost else {k: s + cost for k, s in states.items()}
                    for x in letters:
                        now = self.step(now, (x,), 0.0)
                    ways.append(now)
            states = dict(ways[0])
            for way in ways[1:]:
                for k, s in way.items():
                    if s > states.get(k, -math.inf):
                        states[k] = s
            if not states:
                break
        return states

    def starts(self, c: str) -> bool:
        """Whether evidence may start at a first character c."""
        if (got := self.first.get(c)) is None:
            got = self.first[c] = c in MASKS or any(not letters or letters[0] in self.kids[0] for letters, _ in self.options(c, 2))
        return got

    def read_as(self, token: str) -> list[str]:
        """The evidence that a reading shows which is at most 2 less likely than the best one. The search along the evidence comes
        first: where it ends nowhere, no reading shows any, and the search over all texts is not needed."""
        if not self.starts(token[0]) or not (found := self.forward(token)):
            return []
        best = self.best(token)
        return [e for e, s in found.items() if s >= best - 2.0]


class ToxicityModel:
    def __init__(self, weights: dict[str, float], prior: float, trigrams: dict[str, int]):
        self.weights, self.prior, self.name = weights, prior, uuid.uuid4().hex
        self.restorer = Restorer(CharacterModel(trigrams), sorted(weights))
        self.heads = {x.rstrip("-")[:4] for x in weights}

    def lookup(self, word: str) -> str | None:
        """The strongest evidence in a word: itself or one of its stems, written with a hyphen."""
        if word[:4] not in self.heads:
            return None
        found = [x for x in (word, *stems(word)) if x in self.weights]
        return max(found, key=self.weights.__getitem__) if found else None

    def restored(self, token: str) -> set[str]:
        """Evidence that a disguised token shows; of a word and its stems the strongest alone."""
        found = {x if x.endswith("-") else self.lookup(x) for x in self.restorer.read_as(token)}
        kin = lambda x: [y for y in found if y.rstrip("-").startswith(x.rstrip("-")) or x.rstrip("-").startswith(y.rstrip("-"))]
        return {max(kin(x), key=lambda y: (self.weights[y], y)) for x in found}

    def parts(self, token: str) -> set[str]:
        """What may be disguised in a token: the whole, with the masks at its ends and without, and what inner punctuation and
        separators part. Runs of masks at the ends that are longer than any evidence can only be decoration."""
        if token.isalpha():
            return {token}
        out = set()
        for part in {token, *PUNCTUATION.split(token), *PARTING.split(token)}:
            kept = part.strip("\"'()[]{}<>,.;:?-_~/\\").rstrip("!")
            bare = kept.strip("\"'()[]{}<>,.;:?#%&*-_~/\\").rstrip("!")
            out.add(bare)
            if len(kept) - len(bare) <= self.restorer.longest:
                out.add(kept)
        return {x for x in out if DISGUISED(x)}

    def evidence_of(self, token: str) -> tuple[str, ...]:
        """Toxic words that a token holds, as written or restored."""
        token = token.lower()
        found = {x for w in WORDS(token) if (x := self.lookup(w))}
        if self.weights and (DOUBLED if token.isalpha() else DISGUISED)(token):
            for part in self.parts(token):
                if not (found and any(map(self.lookup, WORDS(part)))):
                    found |= self.restored(part)
        return tuple(sorted(found))


class Scorer(Generations):
    """From a raw token to its evidence."""

    def __init__(self, model: ToxicityModel):
        super().__init__(most=100_000)
        self.model = model

    def made(self, word: bytes) -> tuple[str, ...]:
        return self.model.evidence_of(word.decode())

    def score(self, text: bytes | None) -> tuple[float, list[str]]:
        found: set[str] = set()
        if text:
            for got in filter(None, map(self.__getitem__, text.split())):
                found.update(got)
            if SPACED_BYTES(text):
                for m in SPACED.finditer(text.decode()):
                    found.update(self.spaced(m[0].lower()))
        odds = self.model.prior + sum(self.model.weights[w] for w in found)
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds)))), sorted(found)

    def spaced(self, run: str) -> set[str]:
        """Words among letters set apart: every stretch of the run as long as evidence can be is restored."""
        letters = [c for c in run if c not in " .-_~*"]
        found, longest = set(), self.model.restorer.longest
        for i in range(len(letters)):
            for j in range(i + 3, min(len(letters), i + longest) + 1):
                found |= self.model.restored("".join(letters[i:j]))
        return found


_scorers: dict[str, Scorer] = {}


def scorer_of(model: ToxicityModel) -> Scorer:
    """A worker process' scorer: what it knows about tokens stays for its next task with the same model."""
    if model.name not in _scorers:
        _scorers.clear()
        common.alone(_scorers)
        _scorers[model.name] = Scorer(model)
    return _scorers[model.name]


#: Bits of a filter over hashes of keys, 4 MB: what it lets through beside the keys only costs time.
BITS = 1 << 25


def _among(docs: DataFrame, keys: DataFrame, *names: str, then=iter, ddl: str | None = None) -> DataFrame:
    """The rows of docs whose key may be among the keys, found without a shuffle of docs; `then` makes them into others with the columns
    `ddl`, in the same worker process."""
    at = F.pmod(F.xxhash64(*names), F.lit(BITS))
    words = keys.select(at.alias("at")).groupBy(F.floor(F.col("at") / 32768).alias("word")).agg(F.bitmap_construct_agg(F.col("at") % 32768).alias("bits")).toArrow()  # 4 KB each, and 1,024 at most
    bits = np.zeros(BITS // 8, np.uint8)
    for word, some in zip(words["word"].to_pylist(), words["bits"].to_pylist(), strict=True):
        bits[word * 4096 : word * 4096 + len(some)] = np.frombuffer(some, np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array((sent.value[at >> 3] >> (at & 7)) & 1 == 1))

    return docs.withColumn("_at", at).mapInArrow(lambda batches: then(kept(batches)), ddl or docs.withColumn("_at", at).schema).drop("_at")


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least hash of three words that follow each other; of all words if there are fewer."""
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("sketch", pa.int64())])
    for batch in batches:
        least = []
        for text in common.texts(batch):
            words = (text or b"").lower().split()
            least.append(min(xxhash.xxh3_64_intdigest(b" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))) >> 1)
        yield common.as_batch({"doc_id": common.ids(batch), "digest": common.ids(batch, "digest"), "sketch": least}, schema)


def observed(docs: DataFrame, truth: DataFrame) -> DataFrame:
    """text, toxic: the labelled texts, of those with one sketch and label the one of the least id. What is sought among the documents goes
    to them as bits, and only texts that are taken (and some more) are shuffled, once."""
    own = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null").withColumn("digest", F.xxhash64("text"))
    marks = _among(own, truth, "doc_id", then=_sketched, ddl="doc_id long, digest long, sketch long").join(truth.hint("merge"), "doc_id")
    taken = marks.groupBy("sketch", "toxic").agg(F.min(F.struct("doc_id", "digest")).alias("first")).select("first.*", "toxic")
    taken = common.written(taken.coalesce(common.parts_for(docs.sparkSession, docs.count())), "toxicity-rows")  # read twice
    # rows that are repeated, id and text, are one
    return _among(own, taken, "doc_id", "digest").join(taken.hint("merge"), ["doc_id", "digest"]).groupBy("doc_id", "digest", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, level: float = 0.01, folds: int = 3, held_out: int = 1) -> ToxicityModel:
    truth = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).where(common.key_fold("doc_id", folds) != held_out)
    # copies and near copies of a text are one observation, however many they are
    rows = observed(docs, truth)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums up what a bounded stretch of texts holds before the shuffle."""
        schema = pa.schema([("kind", pa.string()), ("gram", pa.string()), ("clean", pa.int64()), ("toxic", pa.int64())])
        found = {k: [Counter(), Counter()] for k in ("rows", "word", "trigram")}

        def flushed() -> Iterator[pa.RecordBatch]:
            for k, (a, b) in found.items():
                grams = list(a.keys() | b.keys())
                for i in range(0, len(grams), 50_000):
                    some = grams[i : i + 50_000]
                    yield common.as_batch({"kind": [k] * len(some), "gram": some, "clean": [a[g] for g in some], "toxic": [b[g] for g in some]}, schema)
                a.clear()
                b.clear()

        for whole in batches:
            for batch in common.slices(whole):
                for text, toxic in zip(common.texts(batch), common.ids(batch, "toxic"), strict=True):
                    words, y = set(WORDS((text or b"").decode().lower())), int(toxic > 0)
                    found["rows"][y][""] += 1
                    found["word"][y].update(words | {x for w in words for x in stems(w)})
                    for w in words:
                        found["trigram"][y].update(map("".join, zip("^^" + w, "^" + w + "$", w + "$", strict=False)))
                if sum(map(len, found["word"])) > 200_000:
                    yield from flushed()
        yield from flushed()
        common.release()

    sums = rows.mapInArrow(counted, "kind string, gram string, clean long, toxic long").groupBy("kind", "gram").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    sums = common.written(sums.coalesce(common.parts_for(docs.sparkSession, docs.count())), "toxicity-counts")  # read twice below
    clean, toxic = sums.where("kind = 'rows'").agg(F.coalesce(F.sum("clean"), F.lit(0)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    share = toxic / max(1, clean + toxic)
    tested = sums.where("kind = 'word' and clean + toxic >= 3").count()
    # the tail is the smallest without a clean row, and there it is share ** n
    least = math.ceil(math.log(level / max(1, tested)) / math.log(share)) if 0 < share < 1 else 1
    commoner = (F.col("toxic") * F.lit(clean).cast("double") > F.col("clean") * F.lit(toxic).cast("double")) & (F.col("toxic") >= max(1, min(FORMS, least)))
    found = sums.where((F.col("kind") == "trigram") & (F.col("clean") + F.col("toxic") >= 3) | (F.col("kind") == "word") & commoner).toArrow().to_pandas()
    by = {k: [(r.gram, int(r.clean), int(r.toxic)) for r in g.itertuples()] for k, g in found.groupby("kind")}
    prior = math.log((toxic + 0.5) / (clean + 0.5)) if clean + toxic else -700.0
    weights, forms = {}, Counter(x for word, _, _ in by.get("word", []) if not word.endswith("-") for x in stems(word))
    for word, c, t in by.get("word", []):
        if clean and toxic and tail(c, c + t, 1 - share) * tested <= level and (not word.endswith("-") or forms[word] >= FORMS):
            odds = math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))
            weight = odds - SURE * math.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
            if weight > 0 and odds + prior > 0:
                weights[word] = weight
    return ToxicityModel(weights, prior, {g: c + t for g, c, t in by.get("trigram", [])})


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7, folds: int = 3, held_out: int = 1) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(sent.value)
        for batch in batches:
            doc_ids = common.ids(batch)
            found = [scorer.score(t) for t in common.texts(batch)]
            yield common.as_batch({"doc_id": doc_ids, "held_out": [common.fold_of(i, folds) == held_out for i in doc_ids], "score": [s for s, _ in found], "predicted": [int(s >= threshold) for s, _ in found], "evidence": [e for _, e in found]}, SCORES)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, evidence array<string>")


def toxicity(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    return score(docs, fit(docs, labels, **parameters))


def without_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """The rows whose text scores below the threshold, with all their columns; no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(sent.value)
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(t)[0] < threshold for t in common.texts(batch)], pa.bool_()))
        common.release()

    return docs.mapInArrow(run, docs.schema)
