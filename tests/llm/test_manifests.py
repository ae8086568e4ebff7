"""Merkle manifests, phrases and the url filter: brute force on small tables, and the edges."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from quillon.llm import merkle, phrases, queries, urls

from .conftest import EDGES

LOW = str.maketrans(queries.UPPER, queries.UPPER.lower())


def tree(nodes):
    """The root, and for each leaf its place and siblings level by level."""
    paths, groups = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(a, min(a + 16, len(nodes))) for a in range(0, len(nodes), 16)]
        for run in runs:
            for j in run:
                for i in groups[j]:
                    paths[i].append((j - run[0], "".join(nodes[k] for k in run if k != j)))
        nodes, groups = [merkle.parent([nodes[k] for k in run]) for run in runs], [[i for k in run for i in groups[k]] for run in runs]
    return nodes[0], paths


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 300, 4095, 4096])
def test_walks_through_a_block(n):
    leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
    root, paths = tree(leaves)
    depth = merkle.depth_of(n, 0)
    assert list(merkle.walk(leaves, depth)) == paths
    stack = merkle.Treehash()
    for x in leaves:
        stack.add(x)
        assert all(len(run) < 16 for run in stack.runs[:-1])
    assert stack.close(depth) == [root]


def brute_manifest(rows, altered):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: hashlib.sha256("".join(map(field, (r.doc_id, r.source, r.lang, r.n_chars, text))).encode()).hexdigest()
    by = defaultdict(list)
    for r in rows:
        by[r.source].append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in sources]
    root, tops = tree([t[0] for t in trees])
    out = []
    for s, (sub, paths), top in zip(sources, trees, tops, strict=True):
        for (*_, own, r), path in zip(sorted(by[s], key=lambda x: x[:3]), paths, strict=True):
            hit = zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 0
            node = leaf(r, altered(r.text)) if hit and r.text is not None else own
            for place, others in path + top:
                node = hashlib.sha256((others[: 64 * place] + node + others[64 * place :]).encode()).hexdigest()
            out.append((r.doc_id, own, sub, root, hashlib.sha256("".join(o for _, o in path + top).encode()).hexdigest(), node, node == root))
    return sorted(out, key=str)


def test_manifest_and_tampering(spark, data, documents, edges):
    lower = lambda c: F.translate(c, queries.UPPER, queries.UPPER.lower())
    for docs in (documents, edges, edges.withColumn("source", F.when(F.col("doc_id") > 4, F.col("lang"))), edges.where("doc_id = 9")):
        got = sorted(map(tuple, merkle.verified(docs, lower).collect()), key=str)
        assert got == brute_manifest(docs.collect(), lambda t: t.translate(LOW))
    assert merkle.verified(edges.limit(0), lower).count() == 0
    assert not all(r.verified for r in merkle.verified(documents, lower).collect()) and all(r.verified for r in merkle.verified(documents, F.col).collect())


def test_places_in_trees(spark):
    rows = spark.range(700).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), F.col("id") % 40)).alias("source"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"), F.col("id").cast("string").alias("text"))
    got = merkle.placed(rows.select(F.coalesce("source", F.lit("-")).alias("tree"), "doc_id"), ["doc_id"]).collect()
    by = defaultdict(list)
    for r in got:
        by[r.tree].append((r.doc_id, r.pos))
    assert all([p for _, p in sorted(v)] == list(range(len(v))) for v in by.values())


def test_matches_sql(spark, data):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    for name in ("op11_merkle_manifest", "op12_collocations"):
        got = queries.queries()[name](spark, data).toArrow()
        db.register("got", got)
        columns = ", ".join(got.column_names)
        db.execute(f"CREATE OR REPLACE TEMP TABLE want AS SELECT {columns} FROM ({queries.oracle_sql()[name]})")
        assert db.execute("SELECT count(*) FROM want").fetchall() == [(got.num_rows,)]
        assert db.execute(f"SELECT count(*) FROM (SELECT {columns} FROM want EXCEPT ALL SELECT {columns} FROM got)").fetchall() == [(0,)]


def brute_phrases(rows, least, top):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for n in range(1, 6):
                counts[lang or "und"].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        held = defaultdict(int)
        for p, a in often.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    held[p[i : i + n]] = max(held[p[i : i + n]], a)
        best = []
        for p, a in often.items():
            if held[p] < a:
                score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("how", [{}, {"budget": 3000}, {"budget": 250}, {"budget": 0}, {"share": 50}])
def test_phrases_by_brute_force(documents, how):
    """Also where few words or none are broadcast, and where every partition is split."""
    docs = documents.where("doc_id < 60")
    got = sorted(map(tuple, phrases.collocations(docs, 4, top=300, **how).collect()))
    assert got == brute_phrases([(r.lang, r.text) for r in docs.collect()], 4, 300) and len(got) > 100


def test_phrases_of_edges(spark, edges):
    got = sorted(map(tuple, phrases.collocations(edges, 2).collect()))
    assert got == brute_phrases([(r[2], r[1]) for r in EDGES], 2, 2000) and ("xx" in {g[0] for g in got})
    assert phrases.collocations(edges.limit(0)).count() == 0 and phrases.collocations(edges.where("text is null")).count() == 0


def test_partial_covers(spark):
    rows = [("en", "a b c x")] * 8 + [("en", "a b d")] * 2
    docs = spark.createDataFrame(rows, "lang string, text string")
    named = lambda cover: {r.phrase for r in phrases.collocations(docs, 2, cover=cover).collect()}
    assert "a b" in named(100) and "a b" not in named(80) and "b c" not in named(100)


def test_urls(spark):
    rows = [
        (1, "http://m.casino-win.example.com/en/4"), (2, "https://WWW.FreeBets.example.com?x"), (3, "http://weather.example.com/en/"), (4, None), (5, "no url"), (6, "HTTP://A.Example.NET/en/x#f"), (7, "http://net?q"), (8, "http://x.org/fr/y"),
        (9, "ftp://b.net/z"), (10, "http://example.com/de/"), (11, "http://notexample.com/de/"), (12, "http://u@b.net:80/"), (13, "://"), (3, "http://weather.example.com/en/"), (None, "http://t.net/"), (15, "http://" + "freebets" * 3000 + ".com/" + "a" * 50000),
    ]
    words = " ".join(["weather", "free", "bets", "win", "news", "the"] * 20)
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"html": F.lit(f"<p class='x'>{words}</p>"), "host": F.lit(1), "words": F.lit("w"), "verdict": F.lit(2)})
    got = {(r.page_id, r.host): r for r in urls.judged(pages).collect()}
    by = {k[0]: v for k, v in got.items()}
    assert urls.judged(pages).count() == len(rows) and by[2].words[:3] == ["www", "free", "bets"] and by[1].words[:3] == ["m", "casino", "win"]
    assert [(by[i].host, by[i].path, by[i].rule, by[i].verdict) for i in (6, 8, 9, 10)] == [("a.example.net", "/en/x", "example.net/en/", "allow"), ("x.org", "/fr/y", "org/fr/", "allow"), ("b.net", "/z", "net/", "block"), ("example.com", "/de/", "example.com/de/", "block")]
    assert [(by[i].host, by[i].path, by[i].rule) for i in (2, 4, 5, 7, 11, 12, 13)] == [("www.freebets.example.com", "", None), ("", "", None), ("", "", None), ("net", "", None), ("notexample.com", "/de/", None), ("u@b.net:80", "/", None), ("", "", None)]
    assert {i: by[i].verdict for i in (1, 2, 3)} == {1: "block", 2: "block", 3: "allow"} and by[None].verdict == "block"
    assert urls.judged(pages.limit(0)).count() == 0


def test_words_are_split_as_the_likeliest_words():
    times = {b"free": 50, b"bets": 20, b"be": 100, b"ts": 2, b"freeb": 1, b"online": 9}
    split = urls.Splitter(times, 1000)

    def readings(run):
        yield from ([run],)
        for i in range(1, len(run)):
            yield from ([run[:i], *rest] for rest in readings(run[i:]))

    for run in (b"freebets", b"freebetsonline", b"xfreey", b"zzz"):
        value = lambda words: sum(split.logs.get(w, split.unknown[len(w)]) for w in words)
        assert value(split.split(run)) == pytest.approx(max(map(value, readings(run))))
    assert split.split(b"freebetsonline") == [b"free", b"bets", b"online"]


def test_blocked_sites_of_the_table(spark):
    got = urls.judged(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")).where("rule is null").select("host", "verdict").distinct().collect()
    bad = {r.host for r in got if re.search("casino|bets|spam|pills", r.host)}
    assert len(bad) > 2 and {r.host for r in got if r.verdict == "block"} == bad


def test_words_beyond_the_budget_are_looked_up_too(spark):
    """Which words are broadcast and which are joined makes no difference."""
    words = " ".join(["weather"] * 40 + ["free"] * 30 + ["bets"] * 20 + ["bet"] * 3 + ["sun", "shine", "quince"] * 2 + ["medlar"])
    rows = [(i, f"http://{h}.example.com/{p}/{i}") for i, (h, p) in enumerate([("freebets", "x"), ("quincemedlar", "sunshine"), ("QuinceWeather", "medlarsun"), ("betsquince", "zzz"), ("medlar" * 3000, ""), ("medlarcasino", "quince")] * 2)]
    pages = spark.createDataFrame([*rows, (None, None), (1, rows[1][1])], "page_id long, url string").withColumn("html", F.lit(words))
    found = lambda budget: sorted((r.page_id or -1, r.host, r.path, tuple(r.words), round(r.log_odds, 9), r.verdict) for r in urls.judged(pages, budget=budget).collect())
    whole = found(8 << 20)
    assert {w for r in whole if r[0] == 1 for w in r[3]} >= {"quince", "medlar", "sun", "shine"}
    assert found(0) == whole and found(250) == whole
