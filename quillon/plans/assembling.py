"""Registered queries: redacted and full names, replies as JSON, matrices and fit ids, shortlists by share and arm, engines side by side."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rewrites as R
from ..functions import scalars as S
from ..operators import fitting, metrics, paired, resampling, shortlist
from ..registry import query
from . import worlds as W
from .answering import CACHE, NAMES, cache, questions
from .curating import TWINS, twins
from .measure import SUMMARY, ece_sql, fairness_sql, rounded
from .rewriting import ENGLISH, english

FIRST_NAMES = sorted({n for names in R.NAMES.values() for n in names})
SURNAMES = ("Jones", "Smith")
LEAD, TAIL = "Emily Smith and Greg met. ", " Ask [name] or Ms Jones."


@query("t07_redact_names", f"WITH {ENGLISH}, x AS (SELECT doc_id, '{LEAD}' || text AS x FROM en) SELECT doc_id, len(regexp_extract_all(x, '\\b(?:{'|'.join(FIRST_NAMES)})\\b'))::INTEGER AS redacted, md5(regexp_replace(x, '\\b(?:{'|'.join(FIRST_NAMES)})\\b', '[name]', 'g')) AS digest FROM x")
def t07(spark, d):
    """T7, by list."""
    rows = english(spark, d).select("doc_id", R.redact_names(F.concat(F.lit(LEAD), "text"), FIRST_NAMES).alias("r"))
    return rows.select("doc_id", "r.redacted", F.md5("r.text").alias("digest"))


@query("t10_full_name", f"""WITH {ENGLISH}, x AS (SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN '{LEAD}' || text || '{TAIL}' ELSE text END AS x FROM en),
    y AS (SELECT doc_id, x, replace(regexp_replace(x, '\\b(?:Jones|Smith)\\b', 'Banks', 'g'), '[name]', 'Jamal') AS y, regexp_matches(x, '{R.PRONOUN}') AS pronoun, ((length(x) - length(replace(x, '[name]', ''))) // 6)::INTEGER AS placeholders,
          len(regexp_extract_all(x, '\\b(?:Jones|Smith)\\b'))::INTEGER AS surnames FROM x)
    SELECT doc_id, pronoun, placeholders, surnames, CASE WHEN pronoun OR placeholders > 0 OR surnames > 0 THEN md5(regexp_replace(y, '{R.PRONOUN}', '\\1Jamal Banks\\3')) END AS digest FROM y""")  # fmt: skip
def t10(spark, d):
    """Surnames by list."""
    x = F.when(F.col("doc_id") % 3 < 2, F.concat(F.lit(LEAD), "text", F.lit(TAIL))).otherwise(F.col("text"))
    rows = english(spark, d).select("doc_id", R.with_full_name(x, "Jamal", "Banks", SURNAMES).alias("v"))
    return rows.select("doc_id", "v.pronoun", "v.placeholders", "v.surnames", F.md5("v.text").alias("digest"))


#: Replies by doc_id % 6; the text goes where it says TEXT.
REPLIES = (
    'Sure:\n```json\n{"label": "yes", "n": 12}\n```\nDone {x}.', 'TEXT {"n": 12, "why": {"a": [1, 2]}} TEXT', "none: TEXT", '{"a": 1} and {"b": 2}', '```\n{broken}\n``` {"n": 3}', '[1, 2] {"n": 5}',
)


#: An object between fences, for the oracle.
FENCED = r"(?s)```\s*(?:json)?\s*(\{[^`]*\})\s*```"


@query("t14_json_reply", f"""WITH x AS (SELECT doc_id, replace(([{", ".join(f"'{r}'" for r in REPLIES)}])[doc_id % 6 + 1], 'TEXT', coalesce(text, '')) AS x FROM documents),
    c AS (SELECT doc_id, regexp_extract(x, '{FENCED}', 1) AS fenced, regexp_extract(x, '(?s)\\{{.*\\}}') AS plain FROM x)
    SELECT doc_id, CASE WHEN json_valid(fenced) AND json_type(CASE WHEN json_valid(fenced) THEN fenced END) = 'OBJECT' THEN fenced WHEN json_valid(plain) AND json_type(CASE WHEN json_valid(plain) THEN plain END) = 'OBJECT' THEN plain END AS reply FROM c""")  # fmt: skip
def t14(spark, d):
    """T14."""
    x = F.replace(F.element_at(F.array(*map(F.lit, REPLIES)), (F.col("doc_id") % 6 + 1).cast("int")), F.lit("TEXT"), F.coalesce("text", F.lit("")))
    return W.table(spark, d, "documents").select("doc_id", S.json_reply(x).alias("reply"))


@query("t03_fit_ids", f"""WITH {W.FEEDBACK}, s AS (SELECT label_source, count(*) AS n, sum(('0x' || substr(sha256(item_id || chr(31) || final), 1, 15))::BIGINT::HUGEINT) AS labels FROM feedback GROUP BY 1)
    SELECT label_source, n, 'dh-' || substr(sha256(n || '|' || labels || '|' || '{",".join(NAMES)}' || '|' || '0.3'), 1, 10) AS fit_id FROM s""")  # fmt: skip
def t03(spark, d):
    return fitting.fit_ids(W.feedback(spark, d).select("label_source", "item_id", F.col("final").alias("label")), ["label_source"], NAMES, 0.3)


@query("f02_matrix", f"""WITH {CACHE}, a AS (SELECT item_id, {", ".join(f"max(noul) FILTER (name = '{n}') AS {n}" for n in NAMES)} FROM cache JOIN questions USING (name, qhash) GROUP BY 1)
    SELECT item_id, concat_ws(',', {", ".join(f"CASE WHEN {n} IS NULL THEN '{n}' END" for n in NAMES)}) AS missing, {", ".join(f"CASE WHEN {' AND '.join(f'{m} IS NOT NULL' for m in NAMES)} THEN round({n}, 6) END AS x{i}" for i, n in enumerate(NAMES))} FROM a""")  # fmt: skip
def f02(spark, d):
    """what rows lack, and the vectors of those that lack nothing; `complete_matrix` refuses the others."""
    now = cache(spark, d).join(F.broadcast(questions(spark)), ["name", "qhash"])
    wide = now.groupBy("item_id").agg(*[F.max(F.when(F.col("name") == n, F.col("noul"))).alias(n) for n in NAMES])
    return rounded(fitting.matrix(wide, NAMES).select("item_id", F.array_join("missing", ",").alias("missing"), *[F.get("vector", F.lit(i)).alias(f"x{i}") for i in range(len(NAMES))]))


@query("c16_flip_mismatches", f"""WITH {TWINS} SELECT v.item_id AS source_id, v.predicted AS we_said, round(greatest(v.p, 1 - v.p), 4) AS confidence_when_shown, t.predicted AS human_said, 'only the pronouns differ' AS human_comment
    FROM verdicts v JOIN twins t ON t.source_id = v.item_id WHERE v.predicted <> t.predicted""")  # fmt: skip
def c16(spark, d):
    return paired.flip_mismatches(paired.pair_up(W.verdicts(spark, d).select("item_id", "p", "predicted"), twins(spark, d)))


#: Without a man on the list there is no ratio; DuckDB divides by 0.0 and gives infinity or nan.
WITHOUT_MEN = "CASE WHEN isfinite(ratio) THEN ratio END AS ratio, CASE WHEN isfinite(tie_fair_ratio) THEN tie_fair_ratio END AS tie_fair_ratio"
SHARES = (0.1, 0.25, 0.5)
POSITIVES = ", ".join(f"(SELECT count(*) FROM pool WHERE positive AND gender = '{g}') AS {g}_positive" for g in ("female", "male"))


@query("a38_shares", f"WITH {W.POOL} SELECT f.* REPLACE ({WITHOUT_MEN}), {POSITIVES}, (SELECT count(DISTINCT score) FROM pool) AS distinct_scores FROM (" + " UNION ALL ".join(f"SELECT * FROM {fairness_sql(f'(SELECT floor(count(*) * {s})::INTEGER FROM pool)')}" for s in SHARES) + ") f")
def a38_shares(spark, d):
    """Cuts at a tenth, a quarter and half of the pool, with the pool's positives and distinct scores."""
    pool = W.shortlist_pool(spark, d)
    n = pool.count()
    counts = pool.agg(*[F.count_if(F.col("positive") & (F.col("gender") == g)).alias(f"{g}_positive") for g in ("female", "male")], F.countDistinct("score").alias("distinct_scores"))
    return rounded(shortlist.fairness(pool, [int(n * s) for s in SHARES]).crossJoin(F.broadcast(counts)))


@query("x14_ratio_intervals")
def x14(spark, d):
    """The shortlist's ratio at a tenth, a quarter and half of the pool, with its interval over 1,000 resamples."""
    pool = W.shortlist_pool(spark, d)
    cuts = [int(pool.count() * s) for s in SHARES]
    intervals = resampling.ratio_intervals(pool, cuts)
    return rounded(shortlist.fairness(pool, cuts).select("cut", "ratio", "above", "tied").join(intervals, "cut", "left"))


AVERAGED = "averaged AS (SELECT item_id, (score + twin_score) / 2 AS score, (score + twin_score) / 2 AS twin_score, gender, positive FROM pool)"


@query("x16_arm_shortlists", f"WITH {W.POOL}, {AVERAGED} " + " UNION ALL ".join(f"SELECT '{arm}' AS arm, * REPLACE ({WITHOUT_MEN}) FROM {fairness_sql(c).replace('FROM pool)', f'FROM {table})')}" for arm, table in (("plain", "pool"), ("averaged", "averaged")) for c in (50, 75)))
def x16(spark, d):
    """The shortlist's rows for the plain scores, and for an arm that averages a score with its twin's."""
    plain = W.shortlist_pool(spark, d)
    mean = (F.col("score") + F.col("twin_score")) / 2
    averaged = plain.withColumns({"score": mean, "twin_score": mean})
    rows = [shortlist.fairness(pool, [50, 75]).select(F.lit(arm).alias("arm"), "*") for arm, pool in (("plain", plain), ("averaged", averaged))]
    return rounded(rows[0].unionByName(rows[1]))


ENGINES = f"""{W.VERDICTS}, e AS (SELECT 'first' AS engine, p, predicted, truth FROM verdicts UNION ALL SELECT 'second', twin_p, twin_predicted, truth FROM verdicts),
    judged AS (SELECT engine, greatest(p, 1 - p) AS confidence, CAST(predicted = truth AS INTEGER) AS correct, 1.0::DOUBLE AS weight FROM e)"""


@query("x27_engines", f"WITH {ENGINES} SELECT s.*, round(ece, 6) AS ece FROM (SELECT engine, {SUMMARY} FROM judged GROUP BY engine) s JOIN ({ece_sql('judged', 'engine')}) e USING (engine)")
def x27(spark, d):
    """Two engines' verdicts on the same items, each summed up; one pass over the table."""
    side = lambda name, p, call: F.struct(F.lit(name).alias("engine"), F.greatest(p, 1 - F.col(p)).alias("confidence"), (F.col(call) == F.col("truth")).cast("int").alias("correct"))
    rows = W.verdicts(spark, d).select(F.inline(F.array(side("first", "p", "predicted"), side("second", "twin_p", "twin_predicted"))))
    return rounded(metrics.summary(rows.withColumn("weight", F.lit(1.0)), ["engine"]))
