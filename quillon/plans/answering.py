"""Registered queries: sources, records, the answer cache and its joins, feature terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import records
from ..registry import query
from . import worlds as W
from .measure import rounded

NAMES = ("holistic", "tone", "claim")


def questions(spark):
    return spark.createDataFrame([(n, f"q-{n}") for n in NAMES], "name string, qhash string")


QUESTIONS = "questions AS (SELECT unnest(['holistic', 'tone', 'claim']) AS name, 'q-' || unnest(['holistic', 'tone', 'claim']) AS qhash)"


def cache(spark, d):
    """A long answer cache with holes and, for some rows, the hash of an older wording."""
    rows = W.table(spark, d, "documents").select(F.col("doc_id").alias("item_id")).crossJoin(F.broadcast(questions(spark).select("name")))
    old = S.uniform("old", "item_id", "name") < 0.05
    return rows.where(S.uniform("miss", "item_id", "name") >= 0.1).select("item_id", "name", F.concat(F.when(old, "o-").otherwise("q-"), F.col("name")).alias("qhash"), S.uniform("noul", "item_id", "name").alias("noul"))


CACHE = f"""{QUESTIONS}, cache AS (
    SELECT item_id, name, CASE WHEN {W.u('old', 'item_id', 'name')} < 0.05 THEN 'o-' ELSE 'q-' END || name AS qhash, {W.u('noul', 'item_id', 'name')} AS noul
    FROM (SELECT doc_id AS item_id, name FROM documents, questions) WHERE {W.u('miss', 'item_id', 'name')} >= 0.1)"""


@query("s04_latest", f"WITH {W.FEEDBACK} SELECT item_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(final, (ts, event_id)) AS final FROM feedback GROUP BY item_id")
def s04(spark, d):
    return records.latest_by(W.feedback(spark, d).select("item_id", "event_id", "final", "ts"), ["item_id"], ["ts", "event_id"]).select("item_id", "event_id", "final")


@query("s06_extract_import", f"WITH {QUESTIONS}, e AS (SELECT doc_id AS item_id, unnest(['tone', 'other']) AS name, unnest([{W.u('e1', 'doc_id')}, {W.u('e2', 'doc_id')}]) AS answer FROM documents) SELECT item_id, name, qhash, round(answer, 6) AS answer FROM e JOIN questions USING (name)")
def s06(spark, d):
    wide = W.table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.create_map(F.lit("tone"), S.uniform("e1", "doc_id"), F.lit("other"), S.uniform("e2", "doc_id")).alias("answers"))
    return rounded(records.wide_to_long(wide, questions(spark)))


@query("s11_slug", "SELECT DISTINCT p_brand, regexp_replace(regexp_replace(lower(p_brand || ' & Co.'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part")
def s11(spark, d):
    return W.table(spark, d, "part").select("p_brand").distinct().withColumn("slug", S.slug(F.concat("p_brand", F.lit(" & Co."))))


@query("s14_event_log", "SELECT event_type AS kind, ts AS at, event_id AS n FROM events WHERE event_type IN ('purchase', 'signup')")
def s14(spark, d):
    return W.table(spark, d, "events").where(F.col("event_type").isin("purchase", "signup")).select(F.col("event_type").alias("kind"), F.col("ts").alias("at"), F.col("event_id").alias("n"))


@query("s15_text_ingest", f"SELECT substr(sha1(text), 1, 12) AS item_id, min(line) AS line FROM (SELECT regexp_replace(text, '\\A{S.SPACE}+|{S.SPACE}+\\z', '', 'g') AS text, doc_id AS line FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN chr(9) || chr(160) ELSE '' END || text || CASE doc_id % 4 WHEN 0 THEN chr(10) ELSE '' END AS text FROM documents)) WHERE text <> '' AND NOT starts_with(text, '#') GROUP BY 1")
def s15(spark, d):
    i = F.col("doc_id")
    text = F.concat(F.when(i % 3 == 0, "\t\u00a0").otherwise(""), "text", F.when(i % 4 == 0, "\n").otherwise(""))
    return records.ingest_lines(W.table(spark, d, "documents").select(text.alias("text"), i.alias("line")), "text").select("item_id", "line")


@query("s16_semi_filter", f"WITH {CACHE} SELECT item_id, name FROM cache WHERE item_id IN (SELECT doc_id FROM labels)")
def s16(spark, d):
    return cache(spark, d).join(W.table(spark, d, "labels").select(F.col("doc_id").alias("item_id")), "item_id", "left_semi").select("item_id", "name")


@query("s18_per_label_sample", f"WITH {W.ITEMS} SELECT ref, item_id FROM items WHERE ref IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ref ORDER BY md5('seed#' || item_id), item_id) <= 25")
def s18(spark, d):
    return records.per_label(W.items(spark, d).where("ref is not null"), "ref", "item_id", 25)


@query("s19_stratified_split", f"WITH {W.ITEMS} SELECT i.item_id, CASE WHEN s.item_id IS NOT NULL THEN 'test' ELSE 'train' END AS part FROM items i LEFT JOIN (SELECT item_id FROM items WHERE ref IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ref ORDER BY md5('seed#' || item_id), item_id) <= 40) s ON i.item_id = s.item_id WHERE i.ref IS NOT NULL")
def s19(spark, d):
    rows = W.items(spark, d).where("ref is not null")
    test = records.per_label(rows, "ref", "item_id", 40).select("item_id", F.lit("test").alias("part"))
    return rows.select("item_id").join(test, "item_id", "left").select("item_id", F.coalesce("part", F.lit("train")).alias("part"))


@query("s20_anti_sample", f"WITH {W.ITEMS}, used AS (SELECT CAST(regexp_extract('bio-' || (doc_id * 3), '([0-9]+)$', 1) AS BIGINT) AS item_id FROM labels) SELECT ref, item_id FROM items WHERE ref IS NOT NULL AND item_id NOT IN (SELECT item_id FROM used) QUALIFY row_number() OVER (PARTITION BY ref ORDER BY md5('seed#' || item_id), item_id) <= 25")
def s20(spark, d):
    used = W.table(spark, d, "labels").select(F.regexp_extract(F.concat(F.lit("bio-"), (F.col("doc_id") * 3).cast("string")), "([0-9]+)$", 1).cast("bigint").alias("item_id"))
    return records.per_label(W.items(spark, d).where("ref is not null").join(used, "item_id", "left_anti"), "ref", "item_id", 25)


@query("s26_name_pools", "SELECT name, f, m, CASE WHEN f / (f + m) >= 0.55 THEN 'female' WHEN m / (f + m) >= 0.55 THEN 'male' END AS pool FROM (SELECT p_brand AS name, CAST(coalesce(sum(p_size) FILTER (p_partkey % 2 = 0), 0) AS DOUBLE) AS f, CAST(coalesce(sum(p_size) FILTER (p_partkey % 2 = 1), 0) AS DOUBLE) AS m FROM part GROUP BY 1) WHERE f + m >= 100")
def s26(spark, d):
    births = W.table(spark, d, "part").select(F.col("p_brand").alias("name"), F.when(F.col("p_partkey") % 2 == 0, "f").otherwise("m").alias("sex"), "p_size").groupBy("name").pivot("sex", ["f", "m"]).agg(F.sum("p_size").cast("double"))
    f, m = F.coalesce("f", F.lit(0.0)), F.coalesce("m", F.lit(0.0))
    return births.select("name", f.alias("f"), m.alias("m")).where(F.col("f") + F.col("m") >= 100).withColumn("pool", F.when(F.col("f") / (F.col("f") + F.col("m")) >= 0.55, "female").when(F.col("m") / (F.col("f") + F.col("m")) >= 0.55, "male"))


@query("s27_extra_answers", f"WITH {CACHE} SELECT item_id, name, qhash FROM cache WHERE NOT (item_id % 3 = 0)")
def s27(spark, d):
    have = cache(spark, d)
    return have.join(have.where("item_id % 3 = 0").select("item_id", "name", "qhash"), ["item_id", "name", "qhash"], "left_anti").select("item_id", "name", "qhash")


@query("p04_agrees", f"""WITH p AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'Yes.' WHEN 1 THEN chr(9) || 'yes' || chr(160) || chr(10) || ' please' WHEN 2 THEN 'NaN' WHEN 3 THEN 'N/A' WHEN 4 THEN '' WHEN 5 THEN 'none' ELSE 'YES' END AS a,
      CASE event_id % 5 WHEN 0 THEN chr(160) || 'yes! ' || chr(10) WHEN 1 THEN 'Yes please.' || chr(9) WHEN 2 THEN 'nan' WHEN 3 THEN 'n/a' END AS b FROM events),
    n AS (SELECT event_id, trim(regexp_replace(lower(a), '{S.SPACE}+', ' ', 'g'), ' ') AS prediction,
        regexp_replace(rtrim(regexp_replace(lower(coalesce(b, '')), '\\A{S.SPACE}+|{S.SPACE}+\\z', '', 'g'), '.!?'), '\\A{S.SPACE}+|{S.SPACE}+\\z', '', 'g') AS bare FROM p),
    m AS (SELECT event_id, prediction, CASE bare WHEN 'nan' THEN '' WHEN 'n/a' THEN 'na' ELSE bare END AS label FROM n)
    SELECT event_id, label, (CASE WHEN prediction IN ('', 'nan', 'n/a', 'none', 'null') THEN 'na' ELSE prediction END) = (CASE WHEN label IN ('', 'nan', 'n/a', 'none', 'null') THEN 'na' ELSE label END) AS agrees FROM m""")  # fmt: skip
def p04(spark, d):
    """P2, P3 and P4."""
    i = F.col("event_id")
    a = F.when(i % 7 == 0, "Yes.").when(i % 7 == 1, "\tyes\u00a0\n please").when(i % 7 == 2, "NaN").when(i % 7 == 3, "N/A").when(i % 7 == 4, "").when(i % 7 == 5, "none").otherwise("YES")
    b = F.when(i % 5 == 0, "\u00a0yes! \n").when(i % 5 == 1, "Yes please.\t").when(i % 5 == 2, "nan").when(i % 5 == 3, "n/a")
    return W.table(spark, d, "events").select("event_id", S.normalize_label(b).alias("label"), S.agrees(a, b).alias("agrees"))


LABEL = "CASE WHEN NOT is_invalid AND label_source IN ('vetted_feedback', 'regular_final_feedback') THEN rtrim(lower(final), '.') END"


@query("p05_drop_census", f"""WITH {W.FEEDBACK}, {CACHE}, l AS (SELECT item_id, arg_max(struct_pack(label := {LABEL}, propensity := propensity), (ts, event_id)) AS v FROM feedback GROUP BY 1),
    done AS (SELECT item_id FROM cache JOIN questions USING (name, qhash) GROUP BY 1 HAVING count(DISTINCT name) = 3)
    SELECT coalesce(CASE WHEN v.label IS NULL THEN 'no_trusted_label' WHEN v.label NOT IN ('positive', 'negative') THEN 'label_not_in_classes' WHEN v.propensity IS NULL THEN 'no_propensity' WHEN d.item_id IS NULL THEN 'needs_answers' END, 'kept') AS reason, count(*) AS n
    FROM l LEFT JOIN done d ON l.item_id = d.item_id GROUP BY 1""")  # fmt: skip
def p05(spark, d):
    """Latest record of each item, its trusted label, and why it can't train."""
    f = W.feedback(spark, d)
    rows = f.select("item_id", "ts", "event_id", "propensity", F.regexp_replace(F.lower(records.label_of(F.col("label_source"), F.col("final"), F.col("is_invalid"))), r"\.+$", "").alias("label"))
    last = records.latest_by(rows, ["item_id"], ["ts", "event_id"])
    done = records.complete_items(cache(spark, d), questions(spark)).withColumn("done", F.lit(True))
    reason = records.drop_reason(F.col("label"), ["positive", "negative"], F.col("propensity"), F.coalesce("done", F.lit(False)))
    return last.join(done, "item_id", "left").groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("p06_labelled", f"WITH {W.FEEDBACK}, l AS (SELECT item_id, arg_max({LABEL}, (ts, event_id)) FILTER (true) AS label, arg_max(coalesce({LABEL}, ''), (ts, event_id)) AS last FROM feedback GROUP BY 1) SELECT count(*) AS items, count(*) FILTER (last <> '') AS labelled FROM l")
def p06(spark, d):
    f = W.feedback(spark, d).select("item_id", "ts", "event_id", F.coalesce(records.label_of(F.col("label_source"), F.col("final"), F.col("is_invalid")), F.lit("")).alias("label"))
    return records.latest_by(f, ["item_id"], ["ts", "event_id"]).agg(F.count("*").alias("items"), F.count_if(F.col("label") != "").alias("labelled"))


@query("p07_complete_items", f"WITH {CACHE} SELECT item_id FROM cache JOIN questions USING (name, qhash) GROUP BY 1 HAVING count(DISTINCT name) = 3")
def p07(spark, d):
    return records.complete_items(cache(spark, d), questions(spark))


@query("p08_explained_mismatch", f"WITH {W.FEEDBACK} SELECT event_id FROM feedback WHERE initial <> rtrim(lower(final), '.') AND comment <> ''")
def p08(spark, d):
    return W.feedback(spark, d).where((S.normalize_label(F.col("initial")) != S.normalize_label(F.col("final"))) & (F.col("comment") != "")).select("event_id")


@query("j01_all_or_nothing", f"WITH {CACHE} SELECT item_id, count(*)::INTEGER AS n, round(sum(noul), 6) AS total FROM cache JOIN questions USING (name, qhash) GROUP BY 1 HAVING count(*) = 3")
def j01(spark, d):
    held = cache(spark, d).join(F.broadcast(questions(spark)), ["name", "qhash"], "left_semi")
    answers = held.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "noul"))).alias("answers")).where(F.size("answers") == len(NAMES))
    return rounded(answers.select("item_id", F.size("answers").alias("n"), F.aggregate(F.map_values("answers"), F.lit(0.0), lambda a, x: a + x).alias("total")))


@query("j02_partial", f"WITH {CACHE} SELECT d.doc_id AS item_id, count(c.name)::INTEGER AS present, round(count(c.name) / 3.0::DOUBLE, 6) AS coverage FROM documents d LEFT JOIN (SELECT * FROM cache JOIN questions USING (name, qhash)) c ON d.doc_id = c.item_id GROUP BY 1")
def j02(spark, d):
    """What is present, and its share of what is declared."""
    held = cache(spark, d).join(F.broadcast(questions(spark)), ["name", "qhash"], "left_semi").groupBy("item_id").agg(F.count("*").cast("int").alias("present"))
    items = W.table(spark, d, "documents").select(F.col("doc_id").alias("item_id"))
    return rounded(items.join(held, "item_id", "left").select("item_id", F.coalesce("present", F.lit(0)).alias("present"), (F.coalesce("present", F.lit(0)) / F.lit(3.0)).alias("coverage")))


@query("j03_missing", f"WITH {CACHE} SELECT doc_id AS item_id, name, qhash FROM documents, questions q WHERE NOT EXISTS (SELECT 1 FROM cache c WHERE c.item_id = doc_id AND c.name = q.name AND c.qhash = q.qhash)")
def j03(spark, d):
    return records.missing(W.table(spark, d, "documents").select(F.col("doc_id").alias("item_id")), questions(spark), cache(spark, d))


@query("j04_plan", f"WITH {CACHE} SELECT count(DISTINCT doc_id) AS requests, count(*)::BIGINT AS missing_answers FROM documents, questions q WHERE NOT EXISTS (SELECT 1 FROM cache c WHERE c.item_id = doc_id AND c.name = q.name AND c.qhash = q.qhash)")
def j04(spark, d):
    return records.plan(j03(spark, d))


@query("j12_override", f"WITH {CACHE}, b AS (SELECT item_id, name, 1 - noul AS noul FROM cache WHERE name = 'tone' AND item_id % 2 = 0) SELECT c.item_id, c.name, round(coalesce(b.noul, c.noul), 6) AS noul FROM cache c LEFT JOIN b ON c.item_id = b.item_id AND c.name = b.name")
def j12(spark, d):
    base = cache(spark, d).select("item_id", "name", "noul")
    return rounded(records.override(base, base.where("name = 'tone' and item_id % 2 = 0").withColumn("noul", 1 - F.col("noul")), ["item_id", "name"]))


@query("x17_reuse", "SELECT CASE WHEN o.doc_id IS NULL THEN 'new' WHEN n.text = o.text THEN 'reused' ELSE 'changed' END AS reason, count(*) AS n FROM documents n LEFT JOIN (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN text || '.' ELSE text END AS text FROM documents WHERE doc_id % 3 <> 0) o ON n.doc_id = o.doc_id GROUP BY 1")
def x17(spark, d):
    docs = W.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"), "text")
    old = docs.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("old_id"), F.when(F.col("doc_id") % 4 == 0, F.sha2(F.concat("text", F.lit(".")), 256)).otherwise(F.col("h")).alias("old_h"))
    reason = F.when(F.col("old_id").isNull(), "new").when(F.col("h") == F.col("old_h"), "reused").otherwise("changed")
    return docs.select("doc_id", "h").join(old, F.col("doc_id") == F.col("old_id"), "left").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("m14_terms", f"""WITH c AS (SELECT vec_id AS item_id, {W.u('c1', 'vec_id')} AS a, {W.u('c2', 'vec_id')} AS b, {W.u('c3', 'vec_id')} AS c FROM embeddings), n AS (SELECT *, a + b + c AS t, ln(greatest(a, 0.01)) AS la, ln(greatest(b, 0.01)) AS lb, ln(greatest(c, 0.01)) AS lc FROM c)
    SELECT item_id, round(la - (la + lb + lc) / 3, 6) AS clr_a, round(lb - (la + lb + lc) / 3, 6) AS clr_b, round(-(a / t * ln(a / t) + b / t * ln(b / t) + c / t * ln(c / t)) / ln(3.0::DOUBLE), 6) AS entropy,
           round((b + 2 * c) / t / 2, 6) AS level, CASE WHEN a >= b AND a >= c THEN 'a' WHEN b >= c THEN 'b' ELSE 'c' END AS top, round(ln(least(greatest(a, 0.01), 0.99) / (1 - least(greatest(a, 0.01), 0.99))), 6) AS logit_p FROM n""")  # fmt: skip
def m14(spark, d):
    """The terms of an answer."""
    rows = W.table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), *[S.uniform(f"c{i}", "vec_id").alias(x) for i, x in ((1, "a"), (2, "b"), (3, "c"))])
    probabilities, masses = F.create_map(*[y for x in "abc" for y in (F.lit(x), F.col(x))]), F.array("a", "b", "c")
    clr = S.centred_log_ratios(probabilities, "abc")
    return rounded(rows.select("item_id", clr[0].alias("clr_a"), clr[1].alias("clr_b"), S.normalized_entropy(masses).alias("entropy"), S.expected_level(masses).alias("level"), S.argmax_key(probabilities).alias("top"), S.logit(F.col("a")).alias("logit_p")))


@query("t02_cache_key", "SELECT doc_id, sha256('card' || chr(0) || text) AS cache_key FROM documents")
def t02(spark, d):
    return W.table(spark, d, "documents").select("doc_id", S.cache_key(F.lit("card"), F.col("text")).alias("cache_key"))


@query("m08_serving", f"""WITH z AS (SELECT vec_id AS item_id, 1.5::DOUBLE * embedding[1] - 0.5::DOUBLE * embedding[2] + 0.1::DOUBLE AS za, -0.7::DOUBLE * embedding[1] + 0.9::DOUBLE * embedding[3] AS zb, 0.3::DOUBLE * embedding[4] AS zc FROM embeddings),
    e AS (SELECT item_id, exp(za - greatest(za, zb, zc)) AS a, exp(zb - greatest(za, zb, zc)) AS b, exp(zc - greatest(za, zb, zc)) AS c FROM z), p AS (SELECT item_id, a / (a + b + c) AS a, b / (a + b + c) AS b, c / (a + b + c) AS c FROM e)
    SELECT item_id, round(a, 6) AS p_a, round(b, 6) AS p_b, round(c, 6) AS p_c, CASE WHEN a >= b AND a >= c THEN 'a' WHEN b >= c THEN 'b' ELSE 'c' END AS value, round(greatest(a, b, c), 6) AS confidence,
           (greatest(a, b, c) - (a + b + c - greatest(a, b, c) - least(a, b, c))) / 2 < 0.05 AS abstain, greatest(a, b, c) FROM p""".replace(", greatest(a, b, c) FROM p", " FROM p"))  # fmt: skip
def m08(spark, d):
    """Softmax head over vector features, ranked classes, abstain band."""
    e = lambda i: F.element_at("embedding", i).cast("double")
    rows = W.table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), (1.5 * e(1) - 0.5 * e(2) + 0.1).alias("za"), (-0.7 * e(1) + 0.9 * e(3)).alias("zb"), (0.3 * e(4)).alias("zc"))
    p = rows.select("item_id", *[x.alias(n) for n, x in zip(("p_a", "p_b", "p_c"), S.softmax([F.col("za"), F.col("zb"), F.col("zc")]), strict=True)])
    ranked = F.array_sort(F.array(*[F.struct((-F.col(f"p_{n}")).alias("m"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, n in enumerate("abc")]))
    return rounded(p.withColumn("r", ranked).select("item_id", "p_a", "p_b", "p_c", F.col("r")[0]["n"].alias("value"), (-F.col("r")[0]["m"]).alias("confidence"), ((F.col("r")[1]["m"] - F.col("r")[0]["m"]) / 2 < 0.05).alias("abstain")))


TABLE = [(i / 100) ** 1.2 for i in range(101)]


@query("f08_calibrated", f"WITH {W.SCORED} SELECT item_id, round(power(floor(least(confidence * 100, 99)) / 100, 1.2) + (confidence * 100 - floor(least(confidence * 100, 99))) * (power((floor(least(confidence * 100, 99)) + 1) / 100, 1.2) - power(floor(least(confidence * 100, 99)) / 100, 1.2)), 6) AS calibrated FROM scored")
def f08(spark, d):
    """Table lookup with linear interpolation."""
    return rounded(W.scored(spark, d).select("item_id", S.calibrated(F.col("confidence"), TABLE).alias("calibrated")))
