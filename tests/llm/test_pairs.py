"""Operators between documents: WARC deduplication, repeats, decontamination, near duplicates; and the pipeline."""

import hashlib
import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import common, decontaminate, neardup, queries, repeats, warc

from .conftest import EDGES


def test_warc_matches_sql(spark, data):
    got = queries.op6_warc(spark, data).toArrow()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{data}/pages.parquet'")
    db.register("got", got)
    db.execute(f"CREATE TABLE want AS {queries.oracle_sql()['op6_warc']}")
    columns = "page_id, payload_bytes, payload_digest, record_type, refers_to"
    assert db.execute(f"SELECT count(*) FROM (SELECT {columns} FROM want EXCEPT ALL SELECT {columns} FROM got)").fetchone() == (0,)
    assert db.execute("SELECT count(*) FROM want").fetchone() == (got.num_rows,)


def test_warc_round_trip_and_pushdown(spark, tmp_path):
    long = "x" * 1500
    rows = [(1, "u1", long), (2, None, long), (3, "u3", None), (4, "u4", "kurz é"), (4, "u4", "kurz é"), (None, "u5", "y" * 1200), (7, "u7", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.archive(pages, f"file://{tmp_path}/w")
    back = warc.read(spark, f"file://{tmp_path}/w")
    assert back.count() == len(rows)
    only = back.where("record_type = 'revisit'")
    assert [(r.record_id, r.refers_to) for r in only.collect()] == [("<urn:page:1>", "<urn:page:2>")]
    assert bytes(back.where("record_id = '<urn:page:2>'").first().payload) == long.encode()
    got = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archived_pages(pages).collect()}
    assert got == {(1, 1500, "revisit", 2), (2, 1500, "response", None), (3, 0, "response", None), (4, 7, "response", None), (None, 1200, "response", None), (7, 0, "response", None)}
    assert warc.archived_pages(pages.limit(0)).count() == 0


def brute_runs(docs, size):
    first = {}
    for d, t in docs:
        for i in range(len(t) - size + 1):
            s = t[i : i + size]
            first[s] = min(first.get(s, d), d)
    out = {}
    for d, t in docs:
        runs = []
        for i in range(len(t) - size + 1):
            if first[t[i : i + size]] < d:
                if runs and i <= runs[-1][1]:
                    runs[-1] = (runs[-1][0], i + size)
                else:
                    runs.append((i, i + size))
        out[d] = runs
    return out


def brute_repeats(docs, size):
    first = {}
    for d, t in docs:
        for i in range(len(t) - size + 1):
            s = t[i : i + size]
            first[s] = min(first.get(s, d), d)
    out = []
    for d, t in docs:
        gone = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if first[t[i : i + size]] < d:
                gone[i : i + size] = b"\1" * size
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [False, True])
def test_repeats(spark, rows, hot, monkeypatch):
    if hot:  # as with anchors that very many documents have
        monkeypatch.setattr(repeats, "max", lambda a, b: 2 if a == 1000 else max(a, b), raising=False)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(map(tuple, repeats.remove_repeats(docs).collect()))
    assert got == brute_repeats([(d, (t or "").encode()) for d, t in rows], 50)


def test_repeats_of_edges(edges):
    got = [tuple(r) for r in repeats.remove_repeats(edges).collect()]
    known = brute_repeats([(d, (t or "").encode()) for d, t, _ in EDGES if d is not None], 50)
    assert sorted(r for r in got if r[0] is not None) == known
    assert [r[1:4] for r in got if r[0] is None] == [(len(EDGES[9][1]), 0, 0)]
    assert repeats.remove_repeats(edges.limit(0)).count() == 0


def test_cut_characters_stay_whole():
    assert repeats.without("aé漢b".encode(), [(2, 4)]) == "aé漢b"
    assert repeats.without("aé漢b".encode(), [(1, 6)]) == "ab"


def test_tiles_are_longest_first_and_never_overlap():
    import numpy as np

    draw = random.Random(3)
    for _ in range(60):
        a, b = (np.array([draw.randrange(1, 4) for _ in range(draw.randrange(3, 18))]) for _ in range(2))
        found = decontaminate.tiles(a, b, 2)
        used_a, used_b = [i for k, p, _ in found for i in range(p, p + k)], [i for k, _, t in found for i in range(t, t + k)]
        assert len(set(used_a)) == len(used_a) and len(set(used_b)) == len(used_b)
        assert [k for k, *_ in found] == sorted((k for k, *_ in found), reverse=True)
        assert all((a[p : p + k] == b[t : t + k]).all() for k, p, t in found)
        longest = max((k for k in range(2, len(a) + 1) for p in range(len(a) - k + 1) for t in range(len(b) - k + 1) if (a[p : p + k] == b[t : t + k]).all()), default=0)
        assert (found[0][0] if found else 0) == longest
        free_a, free_b = set(range(len(a))) - set(used_a), set(range(len(b))) - set(used_b)
        assert not any(a[p] == b[t] and a[p + 1] == b[t + 1] for p in free_a if p + 1 in free_a for t in free_b if t + 1 in free_b)


def test_decontamination(spark, edges):
    items = spark.createDataFrame([(1, "Which of the seven rivers in the old north runs past the mill before it meets the sea at dawn?"), (2, None), (3, ""), (None, "short item")], "item_id long, text string")
    docs = spark.createDataFrame(
        [
            (1, "And. it meets the sea at dawn, runs past the mill before; WHICH OF THE SEVEN RIVERS IN THE OLD NORTH and so on"),
            (2, "The seven rivers in the old town are not the same, of which none runs."),
            (3, "Nothing of the kind."),
            (4, None),
            (5, "a Short, ITEM here"),
        ],
        "doc_id long, text string",
    )
    for block_bytes in (16 << 20, 20):  # one pass over the documents, and several
        got = {r.doc_id: r for r in decontaminate.decontaminate(docs, items, block_bytes=block_bytes).collect()}
        assert [got[i].contaminated for i in range(1, 6)] == [True, False, False, False, True]
        assert got[1].leaked == [1] and got[5].leaked == [None] and got[1].coverage > 0.9
    assert sorted(r.doc_id for r in decontaminate.without_leaks(docs, items).collect()) == [2, 3, 4]
    assert decontaminate.decontaminate(edges, items.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminate(edges.limit(0), items).count() == 0


def brute_classes(rows, k):
    sets = []
    for _, t in rows:
        words = (t or "").encode().lower().split()
        sets.append({tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = defaultdict(lambda: float("inf"))
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least[root(i)], d)
    return sorted((d, len(sets[i]), int(least[root(i)]), d == least[root(i)]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("parameters", [{}, {"hot": 2, "block": 3}, {"k": 5}])
def test_near_duplicates(spark, rows, parameters):
    draw = random.Random(11)
    base = [f"w{draw.randrange(500)}" for _ in range(120)]
    family = []
    for i in range(25):  # a chain: each text changes one more word than the one before
        base = [*base]
        base[draw.randrange(120)] = f"new{i}"
        family.append((5000 + i, " ".join(base)))
    given = [*rows, *family]
    docs = spark.createDataFrame(given, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, neardup.near_duplicates(docs, **parameters).collect())) == brute_classes(given, parameters.get("k", 2))


def test_near_duplicates_of_edges(edges):
    got = [tuple(r) for r in neardup.near_duplicates(edges).collect()]
    assert sorted(r for r in got if r[0] is not None) == brute_classes([r[:2] for r in EDGES if r[0] is not None], 2)
    assert [r[2:] for r in got if r[0] is None] == [(None, False)]
    assert neardup.near_duplicates(edges.limit(0)).count() == 0


def test_strings_of_one_name_are_told_apart():
    import numpy as np

    draw = random.Random(5)
    for _ in range(20):
        raw = np.frombuffer(bytes(draw.choice(b"ab") for _ in range(60)), np.uint8)
        at = np.array([draw.randrange(40) for _ in range(200)])
        doc = np.array([draw.randrange(9) for _ in at])
        order, begins = repeats.ranked(raw, at, doc, np.zeros(len(at), np.uint64) + np.uint64(draw.randrange(2)), 12)
        groups = [order[a:b] for a, b in zip(begins, [*begins[1:], len(order)], strict=True)]
        found = [{raw[at[i] : at[i] + 12].tobytes() for i in g} for g in groups]
        assert all(len(x) == 1 for x in found) and len(set().union(*found)) == len(found)
        assert all(doc[g[0]] == min(doc[g]) for g in groups)


def test_pipeline_stages(spark, data, tmp_path):
    data = data.replace("sf0.001", "sf0.01")  # where enough documents are labelled for toxic ones to be told
    documents = spark.read.parquet(f"{data}/documents.parquet")
    docs, kept = documents, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, data).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(docs.count())
        if name != "packing":
            assert docs.columns == documents.columns
        if name == "near_duplicates":
            before = spark.read.parquet(f"{tmp_path}/toxicity")
            want = [r[0] for r in brute_classes([(r.doc_id, r.text) for r in before.collect()], 5) if r[3]]
            assert sorted(r.doc_id for r in docs.collect()) == want
        if name == "repeats":
            before = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{tmp_path}/near_duplicates").collect()]
            runs = brute_runs(before, 50)
            assert {r.doc_id: r.text or "" for r in docs.collect()} == {d: repeats.without(t, runs[d]) for d, t in before}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "repeats", "decontamination", "packing"]
    assert documents.count() > kept[0] > kept[1] == kept[2] >= kept[3] > 0
    assert docs.select(F.countDistinct("doc_id")).first()[0] == kept[3]


def test_pipeline_of_edges(spark, data, edges):
    for docs, rows in ((edges, 1), (edges.limit(0), 0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, data).cache()
            assert docs.columns == edges.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, data).count() >= rows


def test_pipeline_with_clashing_columns(spark, data, edges):
    clash = edges.withColumns({c: F.lit("x") for c in ("kept", "KEPT_ID", "copy", "key", "key_of", "id_of", "text_of", "text_of_", "_copy", "_key", "_id", "_text", "component_id", "score")})
    for name, stage in corpus_pipeline.STAGES[1:3]:
        plain, extra = (stage(spark, docs, data) for docs in (edges, clash))
        assert extra.columns == clash.columns, name
        assert {r.kept for r in extra.select("kept").collect()} == {"x"}
        seen = lambda df: sorted(map(str, df.select("doc_id", "text").collect()))
        assert seen(extra) == seen(plain), name


def test_small_tables_are_few_files(spark, edges, monkeypatch):
    """Tables of a few rows aren't as many files as a shuffle has partitions, and no task runs two workers one after another."""
    was = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    files, chained, write = {}, [], common.written

    def written(df, label):
        out = write(df, label)
        files[label] = max(files.get(label, 0), len(out.inputFiles()))
        plan = [x.lstrip(" :+-") for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n")]
        chained.extend(label for a, b in zip(plan, plan[1:]) if a.startswith("MapInArrow") and b.startswith("MapInArrow"))
        return out

    monkeypatch.setattr(common, "written", written)
    try:
        for c, v in zip(was, ("40", "false"), strict=True):
            spark.conf.set(c, v)
        neardup.near_duplicates(edges.union(edges), block=1).collect()
        pairs = spark.createDataFrame([(bytes([0, i]), bytes([0, i + 1])) for i in range(0, 200, 1)], "a binary, b binary").repartition(40)
        assert {bytes(r.label) for r in common.components(pairs).collect()} == {bytes([0, 0])}
    finally:
        for c, v in was.items():
            spark.conf.set(c, v)
    most = spark.sparkContext.defaultParallelism
    assert {"nodes", "postings", "near", "taken", "labels", "links"} <= files.keys()
    assert not chained and {k: n for k, n in files.items() if k not in ("signatures", "hub-links", "edges") and n > most} == {}


def test_stretches_go_out_together_and_repetition_as_one(monkeypatch):
    """The more buckets there are, the less a row to one of them holds: rows share batches. Strings of one repeated letter are one stretch."""
    import numpy as np
    import pyarrow as pa

    draw = random.Random(8)
    texts = ["".join(draw.choice("abcdefgh") for _ in range(3000)) for _ in range(20)] + ["a" * 3000, "a" * 3000 + "b"]
    docs = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    sent = [r for b in repeats._anchors(50, 24, 101, 1)(iter([docs])) for r in b.to_pylist() if r["kind"] == repeats.COUNTED]
    names = repeats.unpacked([r["names"] for r in sent])
    names, owners = np.tile(names, len(texts)), np.repeat(np.arange(len(texts)), len(names))  # as if no anchor were unique
    columns = {"bucket": [0] * (1 + len(texts)), "is_text": [0] + [1] * len(texts), "doc_id": [None, *range(len(texts))], "key": [None, *range(len(texts))], "text": [None, *texts]}
    blank = [None] * len(texts)
    given = pa.RecordBatch.from_pydict(columns | {"names": [repeats.packed(names), *blank], "docs": [repeats.packed(owners), *blank]})
    none = type("Sent", (), {"value": np.zeros(0, np.uint64)})
    out = list(repeats._stretches(50, 24, 101, 1, none)(iter([given])))
    rows = [r for b in out for r in b.to_pylist()]
    assert len(rows) > 50 and len(out) <= 3
    lengths = repeats.unpacked([r["lengths"] for r in rows if r["kind"] == repeats.TEXT])
    assert lengths.max() >= 3000 and lengths.sum() < 20 * sum(map(len, texts))
