"""URL filter: rules for hosts and paths first, then naive Bayes over the words of host and path.

Names in hosts are run together, so each letter run of a host or path is split into words by Viterbi under unigram frequencies, those of
the words in the pages' own text. Labels come from seed words: a site (a host) that has one among its words is a blocked one, the others
are allowed ones. The multinomial model counts words once a site, so it also learns the words that go with the seeds; each class starts
from `belief` words as they are usual on all sites, of a blocked one a share of seeds, so that a word seldom seen says little. Words out of the vocabulary count as one word, digits and other characters part words. A url is
blocked if that is likelier than not.

How it scales: words are counted with partial sums, and all of them are the vocabulary. Those that fit `budget` bytes, the most frequent
first by a sum over classes of counts, are looked up inside the tasks; if there are rarer ones, the stretches of the urls' distinct runs
are joined with them, and the runs that hold any are split with those that they hold. The words' odds go the same two ways. Both are
exact. Pairs of site and word combine before the shuffle, so that a site with a third of all pages is a row per word and task. The html
is read for the counts alone.

Defined cases: a null url, or one without `://`, has an empty host and path and is judged by what is expected of any site; a host keeps
its port and user; of rules of one length the first by name wins; repeated rows are judged each; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

LONGEST = 24
TAG, WORD = re.compile(rb"<[^>]*>"), re.compile(rb"[a-z\x80-\xff]+")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
SEEDS = tuple(
    "adult bet bets betting bingo cams casino cialis crack escort gambling hack jackpot loans malware nude payday phishing pills pirate poker porn replica roulette sex slots spam torrent viagra warez webcam xxx".split()
)
OTHER = b"?"
#: What share of a blocked site's words is expected to be seeds, and how many times rarer than usual they are on an allowed one.
SEEDED, RARER = 0.3, 20


def parsed(url: Column) -> tuple[Column, Column]:
    """Host and path of a url, empty without `://`."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*+", 0)
    return F.translate(host, UPPER, UPPER.lower()), F.regexp_extract(rest, "^[^/?#]*+([^?#]*+)", 1)


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none does. The rules are part of the plan: a list of hundreds."""
    if not rules:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    given = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(-len((h + p).encode())).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")) for h, p, v in rules])
    fits = F.filter(given, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    return F.array_min(F.transform(fits, lambda r: F.struct(r["size"].alias("size"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))


@dataclass
class Splitter:
    """Words of a run of letters, the likeliest by their frequencies; a stretch that is no word costs more the longer it is."""

    times: dict[bytes, int]
    total: int
    logs: dict[bytes, float] = field(default_factory=dict)
    known: dict[bytes, list[bytes]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.logs = {w: math.log(n / self.total) for w, n in self.times.items()}
        self.unknown = [-math.log(self.total) - (k - 1) * math.log(10.0) for k in range(LONGEST + 1)]

    def split(self, run: bytes, rarer: dict[bytes, int] | None = None) -> list[bytes]:
        """`rarer`: how often the words of the run occur that are not in `times`."""
        found = None if rarer else self.known.get(run)
        if found is None:
            best, back, logs = [0.0], [0], self.logs
            if rarer:
                logs = {w: logs[w] for w in stretches(run, 0, len(run)) if w in logs} | {w: math.log(n / self.total) for w, n in rarer.items()}
            for end in range(1, len(run) + 1):
                top, at = -math.inf, 0
                for start in range(max(0, end - LONGEST), end):
                    x = best[start] + logs.get(run[start:end], self.unknown[end - start])
                    if x > top:
                        top, at = x, start
                best.append(top)
                back.append(at)
            found, end = [], len(run)
            while end:
                found.append(run[back[end] : end])
                end = back[end]
            found.reverse()
            if not rarer and len(self.known) < 100_000 and len(run) < 100:
                self.known[run] = found
        return found

    def words(self, text: str | None) -> list[bytes]:
        return [w for run in runs((text or "").encode()) for w in self.split(run)]


def runs(text: bytes | None) -> list[bytes]:
    """The letter runs of a host or path."""
    return WORD.findall((text or b"").translate(LOWER))


def stretches(run: bytes, start: int, end: int) -> Iterator[bytes]:
    """What words may be in a run and start in a part of it."""
    return (run[i:j] for i in range(start, min(end, len(run))) for j in range(i + 1, min(len(run), i + LONGEST) + 1))


def _text_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often a word occurs in the pages' text, tags left out."""
    counts: Counter = Counter()

    def flushed() -> Iterator[pa.RecordBatch]:
        words = list(counts)
        for i in range(0, len(words), 50_000):
            some = words[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), pa.array([counts[w] for w in some], pa.int64())], ["word", "times"])
        counts.clear()

    for whole in batches:
        for batch in common.slices(whole, "html"):
            for html in common.texts(batch, "html"):
                if html:
                    counts.update(w for w in WORD.findall(TAG.sub(b" ", html.translate(LOWER))) if len(w) <= LONGEST)
            if len(counts) > 300_000:
                yield from flushed()
    yield from flushed()


def splitter(pages: DataFrame, budget: int = 8 << 20, seeds: Sequence[str] = SEEDS) -> tuple[Splitter, DataFrame | None]:
    """The frequencies of the words that fit the budget and of the seeds, and a table (word, times) of all others; None if there are none.
    Seeds are words in any case, as frequent as the average word at least."""
    counted = pages.where("html is not null").select("html").mapInArrow(_text_words, "word binary, times long")
    counts = common.written(counted.groupBy("word").agg(F.sum("times").alias("times")), "page-words")
    cut, below = common.head_class(counts, "word", "times", budget)
    marks = [s.encode() for s in seeds]
    is_mark = F.col("word").isin(*[F.lit(m) for m in marks]) if marks else F.lit(False)
    total, size = counts.agg(F.coalesce(F.sum("times"), F.lit(0)), F.count("*")).first()
    times = {bytes(r["word"]): r["times"] for r in counts.where((common.count_class("times") >= cut) | is_mark).collect()}  # within the budget
    usual = max(1, total // max(1, size))
    for m in marks:
        total += max(0, usual - times.get(m, 0))
        times[m] = max(times.get(m, 0), usual)
    return Splitter(times, max(1, total)), counts.where((common.count_class("times") < cut) & ~is_mark) if below else None


def rarely_split(urls: DataFrame, sent, rarer: DataFrame) -> DataFrame:
    """row, splits (run, words, known: whether each is in the vocabulary) of the runs of a url that hold rarer words. urls: row, host, path."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for row, host, path in zip(common.ids(batch, "row"), common.texts(batch, "host"), common.texts(batch, "path"), strict=True):
                own = {*runs(host), *runs(path)}
                rows += [row] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(found, pa.binary())], ["row", "run"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times, ids, found = sent.value.times, [], []
        as_batch = lambda: pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], ["id", "word"])
        for batch in batches:
            for i, run in zip(common.ids(batch, "id"), common.texts(batch, "run"), strict=True):
                for at in range(0, len(run), 1000):
                    some = {w for w in stretches(run, at, at + 1000) if w not in times}
                    ids += [i] * len(some)
                    found += some
                    if len(found) > 50_000:
                        yield as_batch()
                        ids, found = [], []
        yield as_batch()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = [{bytes(x["word"]): x["times"] for x in xs} for xs in common.ids(batch, "rarer")]
            found = [sent.value.split(run, own) for run, own in zip(common.texts(batch, "run"), given, strict=True)]
            known = [[w in sent.value.times or w in own for w in ws] for ws, own in zip(found, given, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("run").cast(pa.binary()), pa.array(found, pa.list_(pa.binary())), pa.array(known, pa.list_(pa.bool_()))], ["run", "words", "known"])

    pairs = urls.mapInArrow(held, "row long, run binary")
    once = common.written(pairs.select("run").distinct().withColumn("id", F.monotonically_increasing_id()), "url-runs")  # the ids must stay
    found = once.mapInArrow(parts, "id long, word binary").join(rarer, "word").groupBy("id").agg(F.collect_set(F.struct("word", "times")).alias("rarer"))
    splits = once.join(found, "id").select("run", "rarer").mapInArrow(split, "run binary, words array<binary>, known array<boolean>")
    return pairs.join(splits, "run").groupBy("row").agg(F.collect_list(F.struct("run", "words", "known")).alias("splits"))


def worded(urls: DataFrame, split: Splitter, rarer: DataFrame | None, seeds: Sequence[str] = SEEDS) -> DataFrame:
    """page_id, host, path, row (a number), words (split, those of the host first), keys (the words, OTHER for those out of the vocabulary) and bad
    (whether the host has a seed word); written."""
    sent, marks = urls.sparkSession.sparkContext.broadcast(split), {s.encode() for s in seeds}
    urls = urls.withColumn("row", F.monotonically_increasing_id())
    if rarer is None:
        given = urls.withColumn("splits", F.lit(None).cast("array<struct<run:binary,words:array<binary>,known:array<boolean>>>"))
    else:
        urls = common.written(urls, "urls")  # read twice, and the row numbers must stay the same
        given = urls.join(rarely_split(urls, sent, rarer), "row", "left")
    given = given.select("page_id", "host", "path", "row", "splits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = sent.value
        for batch in batches:
            words, keys, bad = [], [], []
            for host, path, splits in zip(common.texts(batch, "host"), common.texts(batch, "path"), common.ids(batch, "splits"), strict=True):
                own = {x["run"]: (x["words"], x["known"]) for x in splits or ()}

                def of(text: bytes | None, own: dict = own) -> list[tuple[bytes, bool]]:
                    return [pair for r in runs(text) for pair in (zip(*own[r], strict=True) if r in own else ((w, w in split.times) for w in split.split(r)))]

                both = of(host), of(path)
                words.append([w.decode(errors="replace") for ws in both for w, _ in ws])
                keys.append([w if known else OTHER for ws in both for w, known in ws])
                bad.append(any(w in marks for w, _ in both[0]))
            made = [pa.array(words, pa.list_(pa.string())), pa.array(keys, pa.list_(pa.binary())), pa.array(bad, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("page_id", "host", "path", "row")], *made], ["page_id", "host", "path", "row", "words", "keys", "bad"])

    kind = urls.schema["page_id"].dataType.simpleString()
    return common.written(given.mapInArrow(run, f"page_id {kind}, host string, path string, row long, words array<string>, keys array<binary>, bad boolean"), "url-words")


def bayes(sites: DataFrame, seeds: Sequence[str] = SEEDS, belief: int = 100, budget: int = 8 << 20) -> tuple[dict[bytes, float], DataFrame | None]:
    """Log odds of block to allow of the words that most sites have, as many as fit the budget, of the seeds and of OTHER, and under b"" those
    of any site; and a table (word, odds) of the words of fewer sites, None if there are none. sites: host, keys, bad."""
    marks = {s.encode() for s in seeds}
    kept = [b"", OTHER, *sorted(marks)]
    once = sites.select("host", "bad", F.explode(F.array_append("keys", F.lit(b""))).alias("word")).distinct()
    counts = common.written(once.groupBy("word").agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")), "site-words")
    counts = counts.withColumn("sites", F.col("bad") + F.col("good"))
    is_kept = F.col("word").isin(*[F.lit(k) for k in kept])
    cut, below = common.head_class(counts, "word", "sites", budget)
    top = {bytes(r["word"]): (r["bad"], r["good"]) for r in counts.where((common.count_class("sites") >= cut) | is_kept).collect()}  # within the budget
    any_bad, any_good = top.pop(b"", (0, 0))
    all_bad, all_good, size = counts.where(F.col("word") != F.lit(b"")).agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0)), F.count("*")).first()
    size += len(marks | {OTHER}) - len(top.keys() & (marks | {OTHER}))

    def odds_of(w: bytes, bad: int, good: int) -> float:
        usual = (bad + good + 1) / (all_bad + all_good + size)
        seeded = (1 - SEEDED) * usual + SEEDED * (w in marks) / max(1, len(marks))
        return math.log((bad + belief * seeded) / (all_bad + belief)) - math.log((good + belief * usual / (RARER if w in marks else 1)) / (all_good + belief))

    odds = {w: odds_of(w, *top.get(w, (0, 0))) for w in top.keys() | marks | {OTHER}} | {b"": math.log((any_bad + 1) / (any_good + 1))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = common.texts(batch, "word")
            values = [odds_of(*x) for x in zip(words, common.ids(batch, "bad"), common.ids(batch, "good"), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(values, pa.float64())], ["word", "odds"])

    return odds, counts.where((common.count_class("sites") < cut) & ~is_kept).mapInArrow(run, "word binary, odds double") if below else None


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, seeds: Sequence[str] = SEEDS, budget: int = 8 << 20, belief: int = 100) -> DataFrame:
    """page_id, host, path, words (those of host and path, split), log_odds (of block), rule and verdict. budget: bytes of words that may
    be broadcast, the most frequent first; the others are joined."""
    host, path = parsed(F.col("url"))
    urls = worded(pages.select("page_id", host.alias("host"), path.alias("path")), *splitter(pages, budget, seeds), seeds)
    model, fewer = bayes(urls, seeds, belief, budget)
    odds = pages.sparkSession.sparkContext.broadcast(model)
    given = urls.withColumn("own", F.lit(None).cast("array<struct<word:binary,odds:double>>"))
    if fewer is not None:
        own = urls.select("row", F.explode(F.array_distinct("keys")).alias("word")).join(fewer, "word").groupBy("row").agg(F.collect_list(F.struct("word", "odds")).alias("own"))
        given = urls.join(own, "row", "left")
    given = given.select("page_id", "host", "path", "words", "keys", "own")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = odds.value
        for batch in batches:
            values = []
            for keys, more in zip(common.ids(batch, "keys"), common.ids(batch, "own"), strict=True):
                own = {x["word"]: x["odds"] for x in more or ()}
                values.append(model[b""] + sum(own[k] if k in own else model[k] for k in keys))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("page_id", "host", "path", "words")], pa.array(values, pa.float64())], ["page_id", "host", "path", "words", "log_odds"])

    kind = pages.schema["page_id"].dataType.simpleString()
    scored = given.mapInArrow(score, f"page_id {kind}, host string, path string, words array<string>, log_odds double")
    rule = ruled(F.col("host"), F.col("path"), rules)
    return scored.withColumn("r", rule).select("page_id", "host", "path", "words", "log_odds", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.when(F.col("log_odds") > 0, "block").otherwise("allow")).alias("verdict"))
