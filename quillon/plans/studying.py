"""Registered queries: study aggregates, twins, version diffs, answers of all types."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import studies
from ..registry import query
from . import worlds as W
from .measure import rounded


@query("a26_race_floor", f"""WITH {W.VERSIONS}, s AS (SELECT source_id, any_value(predicted) FILTER (grp = 'white' AND k = 1) AS wa, any_value(predicted) FILTER (grp = 'white' AND k = 2) AS wb, any_value(predicted) FILTER (grp = 'black' AND k = 1) AS bl FROM versions GROUP BY 1),
    r AS (SELECT avg(CAST(wa <> wb AS DOUBLE)) AS floor, avg(CAST(wa <> bl AS DOUBLE)) AS race FROM s) SELECT round(floor, 6) AS floor, round(race, 6) AS race, round(race - floor, 6) AS excess, round(race / nullif(floor, 0), 6) AS ratio FROM r""")  # fmt: skip
def a26(spark, d):
    """Flips between two white names are the floor; excess over it and ratio to it (null without a floor)."""
    pick = lambda g, k: F.max(F.when((F.col("grp") == g) & (F.col("k") == k), F.col("predicted")))
    s = W.versions(spark, d).groupBy("source_id").agg(pick("white", 1).alias("wa"), pick("white", 2).alias("wb"), pick("black", 1).alias("bl"))
    r = s.agg(F.avg((F.col("wa") != F.col("wb")).cast("double")).alias("floor"), F.avg((F.col("wa") != F.col("bl")).cast("double")).alias("race"))
    return rounded(r.select("floor", "race", (F.col("race") - F.col("floor")).alias("excess"), (F.col("race") / F.nullif("floor", F.lit(0.0))).alias("ratio")))


@query("x13_direction_share", f"""WITH {W.VERSIONS}, m AS (SELECT source_id, grp, count(*) FILTER (predicted = 'positive') AS pos, count(*) AS n, sum(p) AS total FROM versions GROUP BY 1, 2),
    c AS (SELECT source_id, grp, CASE WHEN 2 * pos > n THEN 'positive' WHEN 2 * pos < n THEN 'negative' WHEN total / n >= 0.5 THEN 'positive' ELSE 'negative' END AS call FROM m), w AS (SELECT source_id, call AS white FROM c WHERE grp = 'white')
    SELECT grp, count(*) FILTER (call <> white) AS flips, round(avg(CAST(call = 'negative' AS DOUBLE)) FILTER (call <> white), 6) AS toward_negative FROM c JOIN w USING (source_id) WHERE grp <> 'white' GROUP BY grp""")  # fmt: skip
def x13(spark, d):
    """Of the items whose majority verdict differs from the white names', the share that goes to negative; null without flips."""
    m = W.versions(spark, d).groupBy("source_id", "grp").agg(F.count_if(F.col("predicted") == "positive").alias("pos"), F.count("*").alias("n"), F.sum("p").alias("total"))
    call = F.when(2 * F.col("pos") > F.col("n"), "positive").when(2 * F.col("pos") < F.col("n"), "negative").when(F.col("total") / F.col("n") >= 0.5, "positive").otherwise("negative")
    wide = m.groupBy("source_id").agg(*[F.max(F.when(F.col("grp") == g, call)).alias(g) for g in ("white", "black", "hispanic", "asian")])
    rows = wide.select("white", F.explode(F.array(*[F.struct(F.lit(g).alias("grp"), F.col(g).alias("call")) for g in ("black", "hispanic", "asian")])).alias("c")).select("white", "c.*")
    flipped = F.col("call") != F.col("white")
    return rounded(rows.groupBy("grp").agg(F.count_if(flipped).alias("flips"), F.avg(F.when(flipped, (F.col("call") == "negative").cast("double"))).alias("toward_negative")))


@query("a41_element_by_gender", f"WITH {W.VERDICTS} SELECT gender, element, count(*) AS n, round(avg(own), 6) AS as_written, round(avg(other), 6) AS on_twin FROM (SELECT gender, 'p' AS element, p AS own, twin_p AS other FROM verdicts UNION ALL SELECT gender, 'margin', abs(p - 0.5), abs(twin_p - 0.5) FROM verdicts) GROUP BY 1, 2")
def a41(spark, d):
    """Each element's mean as written and on the twin, by gender."""
    pair = lambda n, a, b: F.struct(F.lit(n).alias("element"), a.alias("own"), b.alias("other"))
    p, t = F.col("p"), F.col("twin_p")
    rows = W.verdicts(spark, d).select("gender", F.explode(F.array(pair("p", p, t), pair("margin", F.abs(p - 0.5), F.abs(t - 0.5)))).alias("e")).select("gender", "e.*")
    return rounded(rows.groupBy("gender", "element").agg(F.count("*").alias("n"), F.avg("own").alias("as_written"), F.avg("other").alias("on_twin")))


CUES = {"first": ("th", "and"), "second": ("ing", "er")}
_has = lambda cue: "(" + " OR ".join(f"contains(lower(text), '{k}')" for k in CUES[cue]) + ")"


@query("a45_errors_by_cue", f"""WITH {W.ITEMS}, {W.ANSWERS}, t AS (SELECT tier, predicted <> ref AS wrong, {_has('first')} AS a, {_has('second')} AND NOT {_has('first')} AS b FROM answered WHERE ref IS NOT NULL AND text IS NOT NULL)
    SELECT cue, count(*) AS n, round(avg(CAST(wrong AS DOUBLE)), 6) AS wrong, count(*) FILTER (tier = 'medium') AS n_medium, round(avg(CAST(wrong AS DOUBLE)) FILTER (tier = 'medium'), 6) AS wrong_medium FROM (SELECT 'first' AS cue, * FROM t WHERE a UNION ALL SELECT 'second', * FROM t WHERE b) GROUP BY cue""")  # fmt: skip
def a45(spark, d):
    """Error rates where a cue shows; the second cue without the first."""
    low = F.lower("text")
    has = lambda cue: F.contains(low, F.lit(CUES[cue][0])) | F.contains(low, F.lit(CUES[cue][1]))
    rows = W.answers(W.items(spark, d)).where("ref is not null and text is not null").select("tier", (F.col("predicted") != F.col("ref")).cast("double").alias("wrong"), F.when(has("first"), "first").when(has("second"), "second").alias("cue")).where("cue is not null")
    middle = F.col("tier") == "medium"
    return rounded(rows.groupBy("cue").agg(F.count("*").alias("n"), F.avg("wrong").alias("wrong"), F.count_if(middle).alias("n_medium"), F.avg(F.when(middle, F.col("wrong"))).alias("wrong_medium")))


@query("a46_label_mix", f"""WITH {W.ITEMS}, f AS (SELECT DISTINCT event_id % (SELECT count(*) FROM documents) AS item_id FROM events WHERE event_type = 'purchase')
    SELECT tier, round(count(f.item_id) / sum(count(f.item_id)) OVER ()::DOUBLE, 6) AS recorded, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS pool FROM items LEFT JOIN f USING (item_id) GROUP BY tier""")  # fmt: skip
def a46(spark, d):
    """The mix of tiers among recorded labels and in the pool."""
    from pyspark.sql.window import Window

    recorded = W.feedback(spark, d).where("label_source = 'vetted_feedback'").select("item_id").distinct().withColumn("hit", F.lit(1))
    by = W.items(spark, d).join(recorded, "item_id", "left").groupBy("tier").agg(F.count("hit").alias("r"), F.count("*").alias("n"))
    whole = Window.partitionBy(F.lit(0))  # a row per tier
    return rounded(by.select("tier", (F.col("r") / F.sum("r").over(whole)).alias("recorded"), (F.col("n") / F.sum("n").over(whole)).alias("pool")))


RUNS = f"runs AS (SELECT 'd' || CAST(o_custkey % 3 AS VARCHAR) AS arm, o_custkey AS run, o_orderkey AS version, CASE WHEN o_orderkey % 2 = 0 THEN 'fit' ELSE 'rethink' END AS kind, {W.u('acc', 'o_orderkey')} AS accuracy FROM orders)"


def runs(spark, d):
    o = W.table(spark, d, "orders")
    return o.select(F.concat(F.lit("d"), F.col("o_custkey") % 3).alias("arm"), F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("version"), F.when(F.col("o_orderkey") % 2 == 0, "fit").otherwise("rethink").alias("kind"), S.uniform("acc", "o_orderkey").alias("accuracy"))


@query("a47_arm_gain", f"WITH {RUNS}, g AS (SELECT arm, run, arg_max(accuracy, version) - max(accuracy) FILTER (kind = 'fit') AS gain FROM runs GROUP BY 1, 2) SELECT arm, count(gain) AS n, round(avg(gain), 6) AS mean, round(min(gain), 6) AS least, round(max(gain), 6) AS most FROM g GROUP BY arm")
def a47(spark, d):
    return rounded(studies.gain(runs(spark, d)).groupBy("arm").agg(F.count("gain").alias("n"), F.avg("gain").alias("mean"), F.min("gain").alias("least"), F.max("gain").alias("most")))


@query("a48_learning_curve", f"WITH {RUNS} SELECT arm, kind, run % 7 AS n_labels, count(*) AS n, round(avg(accuracy), 6) AS mean, round(coalesce(stddev_samp(accuracy), 0), 6) AS deviation FROM runs GROUP BY 1, 2, 3")
def a48(spark, d):
    return rounded(studies.spread(runs(spark, d).withColumn("n_labels", F.col("run") % 7), ["arm", "kind", "n_labels"], "accuracy"))


@query("a51_raw_and_calibrated", f"WITH {W.SCORED}, b AS (SELECT tier, correct, confidence AS raw, 1 / (1 + exp(-ln(greatest(least(confidence, 1 - 1e-6), 1e-6) / (1 - greatest(least(confidence, 1 - 1e-6), 1e-6))) / 2)) AS soft FROM scored) SELECT tier, count(*) AS n, round(avg(correct), 6) AS accuracy, round(avg((raw - correct) * (raw - correct)), 6) AS raw_brier, round(avg((soft - correct) * (soft - correct)), 6) AS calibrated_brier, round(avg(raw), 6) AS raw_confidence, round(avg(soft), 6) AS calibrated_confidence FROM b GROUP BY tier")
def a51(spark, d):
    """A split as it is and at temperature 2, by tier."""
    k = F.col("correct")
    rows = W.scored(spark, d).select("tier", "correct", F.col("confidence").alias("raw"), S.temper(F.col("confidence"), 2.0).alias("soft"))
    brier = lambda c: F.avg((F.col(c) - k) * (F.col(c) - k))
    return rounded(rows.groupBy("tier").agg(F.count("*").alias("n"), F.avg("correct").alias("accuracy"), brier("raw").alias("raw_brier"), brier("soft").alias("calibrated_brier"), F.avg("raw").alias("raw_confidence"), F.avg("soft").alias("calibrated_confidence")))


@query("a52_slice_gate", f"WITH {W.SCORED} SELECT tier, lang, count(*) AS n, round(avg(correct), 6) AS student, round(avg(CAST({W.u('tc', 'item_id')} < 0.7 AS DOUBLE)), 6) AS teacher, avg(correct) >= avg(CAST({W.u('tc', 'item_id')} < 0.7 AS DOUBLE)) - 0.02 AS passes FROM scored GROUP BY 1, 2 HAVING count(*) >= 30")
def a52s(spark, d):
    rows = W.scored(spark, d).withColumn("teacher_correct", (S.uniform("tc", "item_id") < 0.7).cast("int"))
    return rounded(studies.slice_gate(rows, ["tier", "lang"], "correct", "teacher_correct"))


@query("a57_label_counts", f"WITH {W.ITEMS} SELECT ref AS label, count(*) AS n FROM items GROUP BY ref")
def a57(spark, d):
    return W.items(spark, d).groupBy(F.col("ref").alias("label")).agg(F.count("*").alias("n"))


@query("a58_element_flips", f"""WITH e AS (SELECT vec_id AS item_id, element FROM embeddings, (SELECT unnest(['tone', 'claim', 'topic']) AS element)), f AS (SELECT element, ({W.u('eb', 'item_id', 'element')} >= 0.5) <> (({W.u('eb', 'item_id', 'element')} + CASE element WHEN 'tone' THEN 0.005 WHEN 'claim' THEN 0.05 ELSE 0.2 END::DOUBLE) >= 0.5) AS flip FROM e)
    SELECT element, count(*) AS n, round(avg(CAST(flip AS DOUBLE)), 6) AS flip_rate, avg(CAST(flip AS DOUBLE)) <= 0.02 AS passes FROM f GROUP BY element""")  # fmt: skip
def a58(spark, d):
    """Flips of each element between items and twins, over the same items on both sides."""
    e = W.table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.explode(F.array(*map(F.lit, ("tone", "claim", "topic")))).alias("element"))
    draw = S.uniform("eb", "item_id", "element")
    push = F.when(F.col("element") == "tone", 0.005).when(F.col("element") == "claim", 0.05).otherwise(0.2)
    return rounded(studies.flips_by_element(e.withColumn("verdict", draw >= 0.5), e.withColumn("verdict", (draw + push) >= 0.5)))


@query("a59_majority_head", f"WITH {W.ITEMS}, c AS (SELECT count(*) FILTER (ref = 'positive') AS p, count(*) FILTER (ref = 'negative') AS n FROM items) SELECT CASE WHEN p > n THEN 'positive' ELSE 'negative' END AS label, round(ln(greatest(p, n) / least(p, n)::DOUBLE), 6) AS intercept FROM c")
def a59(spark, d):
    """The majority class and its log odds, the head of last resort."""
    c = W.items(spark, d).agg(F.count_if(F.col("ref") == "positive").alias("p"), F.count_if(F.col("ref") == "negative").alias("n"))
    return rounded(c.select(F.when(F.col("p") > F.col("n"), "positive").otherwise("negative").alias("label"), F.ln(F.greatest("p", "n") / F.least("p", "n")).alias("intercept")))


@query("a13_served_summary", f"WITH {W.SCORED}, c AS (SELECT *, 1 / (0.05::DOUBLE + {W.u('pr', 'item_id')}) AS w FROM scored) SELECT count(*) AS n, round(sum(w * correct) / sum(w), 6) AS accuracy, round(sum(w * (confidence - correct) * (confidence - correct)) / sum(w), 6) AS brier, round(sum(w) * sum(w) / sum(w * w), 6) AS n_effective FROM c")
def a13(spark, d):
    """The served incumbent on labelled items under inverse propensities."""
    w, k, c = F.col("w"), F.col("correct"), F.col("confidence")
    rows = W.scored(spark, d).withColumn("w", 1 / (F.lit(0.05) + S.uniform("pr", "item_id")))
    return rounded(rows.agg(F.count("*").alias("n"), (F.sum(w * k) / F.sum(w)).alias("accuracy"), (F.sum(w * (c - k) * (c - k)) / F.sum(w)).alias("brier"), (F.sum(w) * F.sum(w) / F.sum(w * w)).alias("n_effective")))


@query("s21_twins", """WITH b AS (SELECT 'i' || doc_id AS item_id, text, CASE doc_id % 3 WHEN 0 THEN 'female' WHEN 1 THEN 'male' END AS gender, doc_id % 5 < 2 AS test FROM documents)
    SELECT item_id, gender, NULL::VARCHAR AS counterfactual_of, md5(coalesce(text, '')) AS digest FROM b UNION ALL SELECT item_id || '__twin', CASE gender WHEN 'female' THEN 'male' WHEN 'male' THEN 'female' END, item_id, md5(coalesce(replace(text, ' he ', ' she '), '')) FROM b WHERE test""")  # fmt: skip
def s21(spark, d):
    """Base rows and, for test items, twins with the other gender. The swap here is one word; t05 has all of it."""
    i = F.col("doc_id")
    base = W.table(spark, d, "documents").select(F.concat(F.lit("i"), i).alias("item_id"), "text", F.when(i % 3 == 0, "female").when(i % 3 == 1, "male").alias("gender"), (i % 5 < 2).alias("test"))
    out = studies.twins(base, F.col("text"), F.replace("text", F.lit(" he "), F.lit(" she ")), F.col("test"))
    return out.select("item_id", "gender", "counterfactual_of", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))


VERSION = lambda v, most: f"SELECT 'k' || p_partkey AS key, p_name || CASE WHEN p_partkey % 11 = {v} THEN ' (clearer)' ELSE '' END AS instructions, p_brand AS criteria FROM part WHERE p_partkey % 7 <> {most}"


@query("u06_version_diff", f"WITH o AS ({VERSION(0, 1)}), n AS ({VERSION(3, 2)}) SELECT coalesce(o.key, n.key) AS key, CASE WHEN o.key IS NULL THEN 'added' WHEN n.key IS NULL THEN 'retired' ELSE 'reworded' END AS change FROM o FULL JOIN n ON o.key = n.key WHERE o.key IS NULL OR n.key IS NULL OR o.instructions <> n.instructions OR o.criteria <> n.criteria")
def u06(spark, d):
    """Elements added, retired and reworded between two versions."""
    p = W.table(spark, d, "part")
    version = lambda v, most: p.where(F.col("p_partkey") % 7 != most).select(F.concat(F.lit("k"), "p_partkey").alias("key"), F.concat("p_name", F.when(F.col("p_partkey") % 11 == v, " (clearer)").otherwise("")).alias("instructions"), F.col("p_brand").alias("criteria"))
    return studies.version_diff(version(0, 1), version(3, 2))


@query("j14_due_steps", "WITH n AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS place FROM events WHERE event_type = 'view'), s AS (SELECT c_custkey AS step, c_custkey * 3 AS after_labels FROM customer) SELECT step, after_labels, event_id AS due_at FROM s LEFT JOIN n ON place = after_labels")
def j14(spark, d):
    """The label with which each recorded step falls due; null if the log is too short."""
    steps = W.table(spark, d, "customer").select(F.col("c_custkey").alias("step"), (F.col("c_custkey") * 3).alias("after_labels"))
    return studies.due_steps(steps, W.table(spark, d, "events").where("event_type = 'view'").select("event_id", "ts"))


#: Answers of every type: a probability of yes, a choice with masses, a level.
def typed(spark, d):
    i = F.col("vec_id")
    kind = F.when(i % 3 == 0, "noul").when(i % 3 == 1, "choice").otherwise("score")
    q = F.floor(S.uniform("ty", "vec_id") * 64) / F.lit(64.0)
    return W.table(spark, d, "embeddings").select(i.alias("item_id"), kind.alias("kind"), q.alias("q")).select("item_id", "kind", F.when(F.col("kind") == "noul", F.col("q")).alias("noul"), F.when(F.col("kind") == "choice", F.when(F.col("q") < 0.5, "low").otherwise("high")).alias("choice"), F.when(F.col("kind") == "choice", F.create_map(F.lit("low"), 1 - F.col("q"), F.lit("high"), F.col("q"))).alias("masses"), F.when(F.col("kind") == "score", F.col("q") * 4).alias("score"))


TYPED = f"typed AS (SELECT vec_id AS item_id, vec_id % 3 AS kind, floor({W.u('ty', 'vec_id')} * 64) / 64.0::DOUBLE AS q FROM embeddings)"


@query("p14_interpreted", f"""WITH {TYPED} SELECT item_id, CASE kind WHEN 0 THEN CASE WHEN q >= 0.5 THEN 'Yes' ELSE 'No' END WHEN 1 THEN CASE WHEN q < 0.5 THEN 'low' ELSE 'high' END ELSE CAST(q * 4 AS VARCHAR) END AS value,
    CASE kind WHEN 0 THEN greatest(q, 1 - q) WHEN 1 THEN CASE WHEN q < 0.5 THEN 1 - q ELSE q END ELSE 0 END::DOUBLE AS confidence FROM typed""")  # fmt: skip
def p14(spark, d):
    """Value and confidence of an answer of any type; a level carries no confidence of its own."""
    return typed(spark, d).select("item_id", S.interpreted(F.col("kind"), F.col("noul"), F.col("choice"), F.col("masses"), F.col("score")).alias("a")).select("item_id", "a.*")


@query("p12_described", f"WITH {TYPED} SELECT item_id, CASE kind WHEN 0 THEN printf('%.0f%% yes', q * 100) WHEN 1 THEN printf('%s (%.0f%%)', CASE WHEN q < 0.5 THEN 'low' ELSE 'high' END, CASE WHEN q < 0.5 THEN 1 - q ELSE q END * 100) ELSE printf('%.1f', q * 4) END AS said FROM typed")
def p12(spark, d):
    return typed(spark, d).select("item_id", S.described(F.col("kind"), F.col("noul"), F.col("choice"), F.col("masses"), F.col("score")).alias("said"))


@query("x26_item_records", f"WITH {W.VERDICTS} SELECT item_id, CASE WHEN p >= 0.5 THEN 'positive' ELSE 'negative' END AS value, greatest(p, 1 - p) AS confidence, (p >= 0.5) = (truth = 'positive') AS correct, CASE WHEN truth = 'positive' THEN p ELSE 1 - p END AS soft_target FROM verdicts")
def x26(spark, d):
    """Per-item records from probabilities, and the teacher's target for the truth."""
    p, yes = F.col("p"), F.col("truth") == "positive"
    return W.verdicts(spark, d).select("item_id", F.when(p >= 0.5, "positive").otherwise("negative").alias("value"), F.greatest(p, 1 - p).alias("confidence"), ((p >= 0.5) == yes).alias("correct"), F.when(yes, p).otherwise(1 - p).alias("soft_target"))


@query("x21_latest_arm", f"WITH {RUNS} SELECT arm, kind, arg_max(run, version) AS run, max(version) AS version FROM runs WHERE run % 4 <> 0 GROUP BY 1, 2")
def x21(spark, d):
    """The latest row of each arm and kind, among those that a flag lets pass."""
    return runs(spark, d).where("run % 4 <> 0").groupBy("arm", "kind").agg(F.max_by("run", "version").alias("run"), F.max("version").alias("version"))


@query("x30_headroom", "SELECT lang, max(n_chars) AS longest, round(avg(n_chars), 6) AS mean, 200000 - max(n_chars) AS room FROM documents GROUP BY lang")
def x30(spark, d):
    return rounded(W.table(spark, d, "documents").groupBy("lang").agg(F.max("n_chars").alias("longest"), F.avg("n_chars").alias("mean"), (F.lit(200000) - F.max("n_chars")).alias("room")))


@query("t04_feature_names", "WITH n AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'self.holistic.p' WHEN 1 THEN 'shared.k' || p_partkey || '.clr.x' WHEN 2 THEN 'tone.logit_p' ELSE 'bare' END AS name FROM part) SELECT id, CASE WHEN starts_with(name, 'self.holistic.') THEN 'self.holistic' WHEN starts_with(name, 'shared.') THEN 'shared.' || split_part(name, '.', 2) ELSE split_part(name, '.', 1) END AS element, CASE WHEN starts_with(name, 'self.holistic.') THEN substr(name, 15) WHEN starts_with(name, 'shared.') THEN regexp_extract(name, '^shared\\.[^.]*\\.(.*)$', 1) ELSE regexp_extract(name, '^[^.]*\\.(.*)$', 1) END AS term FROM n")
def t04(spark, d):
    i = F.col("p_partkey")
    name = F.when(i % 4 == 0, "self.holistic.p").when(i % 4 == 1, F.concat(F.lit("shared.k"), i, F.lit(".clr.x"))).when(i % 4 == 2, "tone.logit_p").otherwise("bare")
    return W.table(spark, d, "part").select(i.alias("id"), S.split_feature(name).alias("f")).select("id", "f.*")


@query("m13_levels", f"WITH {TYPED} SELECT item_id, q * 4 / 4 AS score_norm, round((0.2::DOUBLE * 1 + 0.3::DOUBLE * 2 + q * 3) / (0.5::DOUBLE + 0.2::DOUBLE + 0.3::DOUBLE + q) / 3, 6) AS expected FROM typed WHERE kind = 2")
def m13(spark, d):
    """A level as a share of the highest, and the mean level of masses by level."""
    s = F.col("score")
    masses = F.array(F.lit(0.5), F.lit(0.2), F.lit(0.3), s / 4)
    return rounded(typed(spark, d).where("kind = 'score'").select("item_id", (s / 4).alias("score_norm"), S.expected_level(masses).alias("expected")))
