"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language, lattice, merkle, neardup, packing, phrases, quality, repeats, tokens, toxicity, urls, warc
from .common import table

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def op5_language_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.language_scores(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_id(table(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"), lambda c: F.translate(c, UPPER, UPPER.lower()))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2:3].isdigit()}


#: The unsigned crc32 of a decimal number's digits.
CRC32 = """xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(CAST({0} AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST({0} AS VARCHAR), i, 1)) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""


def merkle_sql(levels: int = 6, top: int = 3) -> str:
    """Levels of the sources' trees and of the tree above them; a tree that is one node stays as it is."""
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    low = f"CASE WHEN {CRC32.format('doc_id')} % 5 = 0 THEN translate(text, '{UPPER}', '{UPPER.lower()}') ELSE text END"
    leaf = lambda text: "sha256(" + " || ".join([*map(part, ("doc_id", "source", "lang", "n_chars")), part(text)]) + ")"
    run = "PARTITION BY tree, i // 16 ORDER BY i ROWS BETWEEN"
    step = lambda of: f"""SELECT *, count(*) OVER (PARTITION BY tree) AS c, coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
        coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {of}"""  # noqa: E731
    up = lambda of: f"SELECT tree, i // 16 AS i, CASE WHEN max(c) = 1 THEN min(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d FROM {of} GROUP BY 1, 2"
    parts = [f"t AS (SELECT doc_id, source, {leaf('text')} AS leaf, {leaf('low')} AS claim FROM (SELECT *, {low} AS low FROM documents))", "a0 AS (SELECT doc_id, leaf, claim, coalesce('=' || source, '-') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS d FROM t)"]
    for name, n in (("a", levels), ("b", top)):
        for k in range(n):
            parts += [f"{name}s{k} AS ({step(f'{name}{k}')})", f"{name}{k + 1} AS ({up(f'{name}s{k}')})"]
        if name == "a":
            parts.append(f"b0 AS (SELECT '' AS tree, tree AS member, row_number() OVER (ORDER BY tree) - 1 AS i, d FROM a{levels})")
    proof, joins = [], []
    for name, n, at in (("a", levels, "as0.i"), ("b", top, "bs0.i")):
        for k in range(n):
            s = f"{name}s{k}"
            if k:
                joins.append(f"JOIN {s} ON {s}.tree = {name}s0.tree AND {s}.i = {at} // {16**k}")
            elif name == "b":
                joins.append("JOIN bs0 ON bs0.member = as0.tree")
            proof.append(f"CASE WHEN {s}.c = 1 THEN '' ELSE {s}.l || {s}.r END")
    steps = [f"a{k}" for k in range(levels)] + [f"b{k}" for k in range(top)]
    kept = "".join(f", {x[0]}s{x[1:]}.c AS c{x}, {x[0]}s{x[1:]}.l AS l{x}, {x[0]}s{x[1:]}.r AS r{x}" for x in steps)
    parts.append(f"f0 AS (SELECT doc_id, leaf, claim AS f0, bs0.d AS subroot, (SELECT d FROM b{top}) AS root, sha256({' || '.join(proof)}) AS proof_sha256{kept} FROM as0 {' '.join(joins)})")
    parts += [f"f{j + 1} AS (SELECT *, CASE WHEN c{x} = 1 THEN f{j} ELSE sha256(l{x} || f{j} || r{x}) END AS f{j + 1} FROM f{j})" for j, x in enumerate(steps)]
    last = f"f{len(steps)}"
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, root, proof_sha256, {last} AS folded_root, {last} = root AS verified FROM {last}"


def oracle_sql() -> dict[str, str]:
    return {
        "op11_merkle_manifest": merkle_sql(),
        "op12_collocations": f"""
            WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
            w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM p),
            g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w), (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE i + m - 1 <= len(w)),
            f AS (SELECT lang, phrase, m, count(*) AS c FROM g GROUP BY ALL HAVING count(*) >= 100), n AS (SELECT lang, count(*) AS n FROM g WHERE m = 1 GROUP BY lang),
            c AS (SELECT lang, phrase, c AS a, m, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
            k AS (SELECT k.lang, k.phrase, a, k, l.c AS l, r.c AS r, n, 1000::HUGEINT * a * n // (l.c::HUGEINT * r.c) AS score FROM (SELECT *, unnest(range(1, m)) AS k FROM c) k
                  JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(w[1:k], ' ') JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(w[k + 1:k.m], ' ') JOIN n ON n.lang = k.lang),
            b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
            h AS (SELECT lang, array_to_string(w[i:i + j - 1], ' ') AS phrase, max(a) AS held FROM (SELECT *, unnest(range(1, m - j + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS j FROM c)) GROUP BY 1, 2)
            SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
            FROM (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN h ON h.lang = b.lang AND h.phrase = b.phrase WHERE held IS NULL OR 100 * held < 100 * a) WHERE rank <= 2000
        """,
        "op6_warc": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
            d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS keep FROM p)
            SELECT page_id, payload_bytes, payload_digest,
                   CASE WHEN payload_bytes >= 1000 AND page_id < keep THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN payload_bytes >= 1000 AND page_id < keep THEN keep END AS refers_to
            FROM d
        """,
    }
