"""Registered queries: twins made anew, ages left out, name pools, texts under three and under sixteen names; shifts and intervals of
versions; terms, drift and residuals in full."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rewrites as R
from ..functions import scalars as S
from ..operators import fitting, metrics, names, paired, records, resampling, sampling, scorecards, selecting
from ..registry import query
from . import worlds as W
from .measure import CALL, rounded
from .rewriting import AT, ENGLISH, SWAPPED, english, swapped
from .selecting import HEAD, NAMES, vectors


@query("s21_swapped_twins", f"SELECT doc_id || '__twin' AS item_id, doc_id AS counterfactual_of, swapped, her_resolved, digest FROM ({SWAPPED}) WHERE doc_id % 5 < 2")
def s21(spark, d):
    """The twin of every English test text, with the whole swap."""
    rows = swapped(english(spark, d).where("doc_id % 5 < 2"))
    return rows.select(F.concat(F.col("doc_id").cast("string"), F.lit("__twin")).alias("item_id"), F.col("doc_id").alias("counterfactual_of"), "s.swapped", "s.her_resolved", F.md5("s.text").alias("digest"))


@query("s22_regenerated", f"""WITH stored AS (SELECT doc_id, md5(replace(text, ' he ', ' she ')) AS old FROM (WITH {ENGLISH} SELECT * FROM en) WHERE doc_id % 3 > 0), fresh AS (SELECT doc_id, digest AS new FROM ({SWAPPED}) WHERE doc_id % 7 > 0)
    SELECT count(*) FILTER (old = new) AS unchanged, count(*) FILTER (old <> new) AS changed, count(*) FILTER (old IS NULL) AS added, count(*) FILTER (new IS NULL) AS gone FROM stored FULL JOIN fresh USING (doc_id)""")  # fmt: skip
def s22(spark, d):
    """Twins made anew against those that are stored (with another swap, and of other items)."""
    rows = english(spark, d)
    stored = rows.where("doc_id % 3 > 0").select("doc_id", F.replace("text", F.lit(" he "), F.lit(" she ")).alias("text"))
    fresh = swapped(rows.where("doc_id % 7 > 0")).select("doc_id", "s.text")
    return names.regenerated(stored, fresh, "doc_id", texts_only=True)


YEARS = f"len(list_filter(regexp_extract_all(text, '{R.YEAR}'), lambda y: CAST(y AS INTEGER) < 2000)) > 0"
SPANS = f"len(list_filter(regexp_extract_all(text, '{R.DURATION}', 1), lambda y: CAST(y AS INTEGER) >= 10)) > 0"


@query("s23_age_exclusions", f"WITH {ENGLISH}, {AT} SELECT CASE WHEN pronoun = '' THEN 'no_pronoun' WHEN {YEARS} THEN 'year' WHEN {SPANS} THEN 'duration' ELSE 'kept' END AS reason, count(*) AS n, 4 * count(*) FILTER (pronoun <> '' AND NOT {YEARS} AND NOT {SPANS}) AS versions FROM en2 GROUP BY 1")
def s23(spark, d):
    """How many texts get four ages, and why the others get none."""
    reason = F.coalesce(names.exclusion(F.col("text")), F.lit("kept"))
    return english(spark, d).groupBy(reason.alias("reason")).agg(F.count("*").alias("n")).withColumn("versions", F.when(F.col("reason") == "kept", 4 * F.col("n")).otherwise(0))


def tables(spark, d):
    """Given names, surnames, births and bearers out of parts, suppliers' nations and customers, so that all rules bind."""
    part = W.table(spark, d, "part").select(F.upper(F.split("p_name", " ")[0]).alias("name"), "p_partkey", "p_size")
    shares = lambda salt, name: [S.uniform(salt + g, name).alias(g) for g in names.GROUPS]
    given = part.select("name").distinct()
    first = given.select("name", *[c if g != "asian" else F.lit(0.1).alias(g) for g, c in zip(names.GROUPS, shares("fn", "name"), strict=True)])
    births = part.select("name", F.when(S.uniform("sx", "name", "p_partkey") < F.when(S.uniform("lean", "name") < 0.45, 0.02).otherwise(0.97), "F").otherwise("M").alias("sex"), (F.col("p_size") * 40).alias("count"))
    last = given.select(F.concat("name", F.lit("SON")).alias("name")).select("name", *shares("ln", "name"))
    bearers = last.select("name", F.floor(S.uniform("be", "name") * 12000).cast("long").alias("count"))
    return first, last, births, bearers


POOLS = f"""part_names AS (SELECT upper(string_split(p_name, ' ')[1]) AS name, p_partkey, p_size FROM part), given AS (SELECT DISTINCT name FROM part_names),
    b AS (SELECT name, sum(p_size * 40) FILTER (f) AS f, sum(p_size * 40) FILTER (NOT f) AS m FROM (SELECT *, {W.u('sx', 'name', 'p_partkey')} < CASE WHEN {W.u('lean', 'name')} < 0.45 THEN 0.02 ELSE 0.97 END AS f FROM part_names) GROUP BY 1),
    g AS (SELECT name, CASE WHEN coalesce(f, 0) / (coalesce(f, 0) + coalesce(m, 0)) >= 0.9 THEN 'female' WHEN coalesce(m, 0) / (coalesce(f, 0) + coalesce(m, 0)) >= 0.9 THEN 'male' END AS part FROM b WHERE coalesce(f, 0) + coalesce(m, 0) >= 2000),
    own AS (SELECT grp, part, upper(name[1]) || lower(name[2:]) AS name, false AS borrowed FROM (""" + " UNION ALL ".join(f"SELECT name, '{x}' AS grp, {W.u('fn' + x, 'name') if x != 'asian' else '0.1'} AS share FROM given" for x in names.GROUPS) + """) JOIN g USING (name) WHERE share >= 0.7 AND part IS NOT NULL),
    sur AS (SELECT grp, 'last' AS part, upper(name[1]) || lower(name[2:]) AS name, false AS borrowed FROM (""" + " UNION ALL ".join(f"SELECT name || 'SON' AS name, '{x}' AS grp, {W.u('ln' + x, 'name || ' + repr('SON'))} AS share FROM given" for x in names.GROUPS) + f""") s WHERE share >= 0.7 AND floor({W.u('be', 's.name')} * 12000) >= 5000),
    pools AS (SELECT * FROM own UNION ALL SELECT * FROM sur UNION ALL SELECT g, part, name, true FROM own, (SELECT unnest(['white', 'black', 'hispanic', 'asian']) AS g) WHERE grp = 'white' AND g NOT IN (SELECT grp FROM own))"""  # fmt: skip


def pool_of(spark, d):
    return names.pools(*tables(spark, d), share=0.7, least_births=2000)


@query("s26_name_pools_full", f"WITH {POOLS} SELECT DISTINCT * FROM pools")
def s26(spark, d):
    """Given names by group and sex, surnames by group, and the group without given names that borrows them. The limits are those
    of `names`, but for births (2,000) and share (0.7), which would leave nothing of so few names."""
    return pool_of(spark, d)


@query("s24_full_name_versions", f"""WITH {ENGLISH}, {AT}, {POOLS}, items AS (SELECT doc_id AS item_id, text, pronoun, before, CASE WHEN doc_id % 2 = 0 THEN 'female' ELSE 'male' END AS gender FROM en2 ORDER BY md5('draw#' || doc_id), doc_id LIMIT 500),
    f AS (SELECT item_id, grp, name AS first, row_number() OVER (PARTITION BY item_id, grp ORDER BY md5('fullf#' || item_id || '#' || name), name) AS k FROM items JOIN (SELECT DISTINCT grp, part, name FROM pools) ON part = gender),
    l AS (SELECT item_id, grp, name AS last, row_number() OVER (PARTITION BY item_id, grp ORDER BY md5('fulll#' || item_id || '#' || name), name) AS k FROM items JOIN (SELECT DISTINCT grp, part, name FROM pools) ON part = 'last')
    SELECT item_id, grp, CAST(k AS INTEGER) AS k, first, last, CASE WHEN pronoun <> '' THEN md5(before || first || ' ' || last || substr(text, length(before) + length(pronoun) + 1)) END AS digest FROM items JOIN f USING (item_id) JOIN l USING (item_id, grp, k) WHERE k <= 4""")  # fmt: skip
def s24(spark, d):
    """A draw of 500 texts, each under four full names of each of four groups: sixteen texts."""
    gender = F.when(F.col("doc_id") % 2 == 0, "female").otherwise("male")
    items = english(spark, d).select(F.col("doc_id").alias("item_id"), "text", gender.alias("gender")).orderBy(F.md5(F.concat(F.lit("draw#"), F.col("doc_id").cast("string"))), "doc_id").limit(500)
    given = names.drawn(items.select("item_id", "gender"), pool_of(spark, d), 4, "full")
    return names.under_names(items.select("item_id", "text"), given).select("item_id", "grp", "k", "first", "last", F.md5("text").alias("digest"))


THREE = f"""three AS (SELECT *, w[floor({W.u('na', 'doc_id')} * 9)::INTEGER + 1] AS white_a, w[(floor({W.u('na', 'doc_id')} * 9)::INTEGER + 1 + floor({W.u('nb', 'doc_id')} * 8)::INTEGER) % 9 + 1] AS white_b, b[floor({W.u('nc', 'doc_id')} * 9)::INTEGER + 1] AS black FROM
    (SELECT *, CASE WHEN doc_id % 2 = 0 THEN [{', '.join(map(repr, R.NAMES['white', 'female']))}] ELSE [{', '.join(map(repr, R.NAMES['white', 'male']))}] END AS w, CASE WHEN doc_id % 2 = 0 THEN [{', '.join(map(repr, R.NAMES['black', 'female']))}] ELSE [{', '.join(map(repr, R.NAMES['black', 'male']))}] END AS b FROM en2))"""


@query("s25_three_names", f"WITH {ENGLISH}, {AT}, {THREE}, v AS (SELECT *, 'white_a' AS version, white_a AS name FROM three UNION ALL SELECT *, 'white_b', white_b FROM three UNION ALL SELECT *, 'black', black FROM three) SELECT doc_id, version, name, md5(before || name || substr(text, length(before) + length(pronoun) + 1)) AS digest FROM v WHERE pronoun <> ''")
def s25(spark, d):
    """Every text with a pronoun under two distinct white names and a Black one. The text is searched once for its three."""
    gender = F.when(F.col("doc_id") % 2 == 0, "female").otherwise("male")
    rows = english(spark, d).select("doc_id", R.around_pronoun(F.col("text")).alias("p"), names.three_names(gender, "doc_id").alias("n")).where("p is not null")
    versions = F.explode(F.array(*[F.struct(F.lit(v).alias("version"), F.col(f"n.{v}").alias("name")) for v in ("white_a", "white_b", "black")]))
    return rows.select("doc_id", "p", versions.alias("v")).select("doc_id", "v.version", "v.name", F.md5(F.concat("p.before", "v.name", "p.after")).alias("digest"))


@query("a28_source_shifts", f"""WITH {W.VERSIONS}, m AS (SELECT source_id, avg(p) FILTER (grp = 'white') AS white, avg(p) FILTER (grp = 'white' AND k > 2) - avg(p) FILTER (grp = 'white' AND k <= 2) AS floor_shift, {', '.join(f"avg(p) FILTER (grp = '{g}') AS {g}" for g in ('black', 'hispanic', 'asian'))} FROM versions GROUP BY 1)
    SELECT source_id, round(black - white, 6) AS black, round(hispanic - white, 6) AS hispanic, round(asian - white, 6) AS asian, round(floor_shift, 6) AS floor_shift FROM m""")  # fmt: skip
def a28(spark, d):
    """Each item's shift from the reference group's names to each other group's, and between the halves of the reference's own."""
    return rounded(paired.source_shifts(W.versions(spark, d), ["black", "hispanic", "asian"], "white"))


@query("a30_majority_ratios", f"""WITH {W.VERSIONS}, c AS (SELECT source_id, grp, {CALL} AS call FROM versions GROUP BY 1, 2), h AS (SELECT source_id, k > 2 AS late, {CALL} AS call FROM versions WHERE grp = 'white' GROUP BY 1, 2),
    f AS (SELECT avg(CAST(a.call <> b.call AS DOUBLE)) AS floor FROM h a JOIN h b ON a.source_id = b.source_id AND b.late AND NOT a.late), m AS (SELECT a.grp, avg(CAST(a.call <> w.call AS DOUBLE)) AS flip FROM c a JOIN c w ON a.source_id = w.source_id AND w.grp = 'white' WHERE a.grp <> 'white' GROUP BY 1)
    SELECT grp, round(flip, 6) AS majority_flip, round(floor, 6) AS floor, round(flip - floor, 6) AS excess, round(flip / nullif(floor, 0), 6) AS ratio FROM m, f""")  # fmt: skip
def a30(spark, d):
    """Majority verdicts that flip, over the floor of the reference's own names; no ratio where the floor is 0."""
    shifts = paired.group_shifts(W.versions(spark, d), "positive").select("grp", "majority_flip")
    floor = shifts.where("grp = 'floor'").select(F.col("majority_flip").alias("floor"))
    rows = shifts.where("grp <> 'floor'").crossJoin(F.broadcast(floor))  # one row
    return rounded(rows.withColumns({"excess": F.col("majority_flip") - F.col("floor"), "ratio": F.col("majority_flip") / F.nullif("floor", F.lit(0.0))}))


@query("a31_intervals")
def a31(spark, d):
    """1,000 resamples of the items: the mean shift, the flip rate, and the ratio of one group's flips to the floor's."""
    v = W.verdicts(spark, d).select("item_id", (F.col("twin_p") - F.col("p")).alias("shift"), (F.col("predicted") != F.col("twin_predicted")).cast("double").alias("flip"))
    pick = lambda g, k: F.max(F.when((F.col("grp") == g) & (F.col("k") == k), F.col("predicted")))
    calls = W.versions(spark, d).groupBy(F.col("source_id").alias("item_id")).agg(pick("white", 1).alias("a"), pick("white", 2).alias("b"), pick("black", 1).alias("c"))
    rows = v.join(calls.select("item_id", (F.col("a") != F.col("b")).cast("double").alias("floor"), (F.col("a") != F.col("c")).cast("double").alias("race")), "item_id")
    sums = resampling.resampled_sums(rows, "item_id", ["shift", "flip", "floor", "race"])
    stats = {"shift": F.col("shift") / F.col("n"), "flip": F.col("flip") / F.col("n"), "ratio": F.col("race") / F.nullif("floor", F.lit(0.0))}
    return rounded(resampling.intervals(sums, stats))


@query("a43_balance", f"WITH {W.ITEMS} SELECT tier, count(*) AS n, count(*) FILTER (ref = 'positive') AS positive, round(avg(CAST(ref = 'positive' AS DOUBLE)), 6) AS balance, round(greatest(avg(CAST(ref = 'positive' AS DOUBLE)), avg(CAST(ref <> 'positive' AS DOUBLE))), 6) AS majority FROM items WHERE ref IS NOT NULL GROUP BY ROLLUP (tier)")
def a43(spark, d):
    """Class balance and the majority's share, what a guess would get, by tier and over all (tier null)."""
    up = (F.col("ref") == "positive").cast("double")
    return rounded(W.items(spark, d).where("ref is not null").rollup("tier").agg(F.count("*").alias("n"), F.count_if(F.col("ref") == "positive").alias("positive"), F.avg(up).alias("balance"), F.greatest(F.avg(up), 1 - F.avg(up)).alias("majority")))


TOPIC = f"CASE WHEN {W.u('tp', 'item_id')} < 0.3 THEN 'sport' WHEN {W.u('tp', 'item_id')} < 0.6 THEN 'music' ELSE 'other' END"


@query("a49_residuals_by_topic", f"""WITH {W.ITEMS}, {W.ANSWERS}, r AS (SELECT tier, ref, {TOPIC} AS topic, contains(lower(text), 'the ') AS cue, predicted <> ref AS wrong FROM answered WHERE ref IS NOT NULL)
    SELECT tier, ref, topic, count(*) AS n, count(*) FILTER (wrong) AS wrong, count(*) FILTER (wrong AND cue) AS wrong_with_cue, round(avg(CAST(wrong AS DOUBLE)) FILTER (cue) - avg(CAST(wrong AS DOUBLE)) FILTER (NOT cue), 6) AS cue_gap FROM r GROUP BY ALL HAVING count(*) >= 5""")  # fmt: skip
def a49(spark, d):
    """Cells of five items or more by tier, label and topic: errors, those that hold a cue, and what the cue makes to the rate."""
    u = S.uniform("tp", "item_id")
    topic = F.when(u < 0.3, "sport").when(u < 0.6, "music").otherwise("other")
    cue, wrong = F.contains(F.lower("text"), F.lit("the ")), F.col("predicted") != F.col("ref")
    rows = W.answers(W.items(spark, d).where("ref is not null")).select("tier", "ref", topic.alias("topic"), cue.alias("cue"), wrong.alias("wrong"))
    rate = lambda which: F.avg(F.when(which, F.col("wrong").cast("double")))
    return rounded(rows.groupBy("tier", "ref", "topic").agg(F.count("*").alias("n"), F.count_if("wrong").alias("wrong"), F.count_if(F.col("wrong") & F.col("cue")).alias("wrong_with_cue"), (rate(F.col("cue")) - rate(~F.col("cue"))).alias("cue_gap")).where("n >= 5"))


ASKS = f"""asks AS (SELECT vec_id AS item_id, n AS name, r AS asked, least(1, {W.u('dt', 'vec_id', 'n')} + CASE WHEN r <> 'alone' AND {W.u('dj', 'vec_id', 'n', 'r')} < 0.1 THEN 0.01 ELSE 0 END::DOUBLE) AS p FROM embeddings, (SELECT unnest(['tone', 'claim']) AS n), (SELECT unnest(['alone', 'again', 'together']) AS r))"""


@query("a53_stability", f"WITH {ASKS} SELECT b.name, b.asked, count(*) AS n, count(*) FILTER (a.p = b.p) AS identical, round(max(abs(a.p - b.p)), 6) AS largest, count(*) FILTER ((a.p >= 0.5) <> (b.p >= 0.5)) AS flips FROM asks a JOIN asks b USING (item_id, name) WHERE a.asked = 'alone' AND b.asked <> 'alone' GROUP BY b.name, b.asked")
def a53(spark, d):
    """Is an answer the same when it is asked again, and when it is asked beside other questions?"""
    each = lambda *v: F.explode(F.array(*map(F.lit, v)))
    asks = W.table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), each("tone", "claim").alias("name")).select("*", each("alone", "again", "together").alias("asked"))
    noise = F.when((F.col("asked") != "alone") & (S.uniform("dj", "item_id", "name", "asked") < 0.1), 0.01).otherwise(0.0)
    return rounded(paired.stability(asks.withColumn("p", F.least(F.lit(1.0), S.uniform("dt", "item_id", "name") + noise)), "alone"))


@query("m14_all_terms", f"""WITH a AS (SELECT vec_id AS item_id, {W.u('t1', 'vec_id')} AS p, {W.u('t2', 'vec_id')} AS x, {W.u('t3', 'vec_id')} AS y, {W.u('t4', 'vec_id')} AS z FROM embeddings),
    n AS (SELECT *, ln(greatest(x, 0.01)) AS lx, ln(greatest(y, 0.01)) AS ly, ln(greatest(z, 0.01)) AS lz, x + y + z AS t FROM a),
    l AS (SELECT item_id, unnest(['noul.is_yes', 'noul.p', 'noul.logit_p', 'choice.chosen.a', 'choice.chosen.b', 'choice.top_p', 'choice.entropy', 'choice.confidence', 'choice.clr.c', 'score.score_norm', 'score.expected_level', 'score.confidence', 'score.clr.0', 'score.clr.2']) AS term,
      unnest([CAST(p >= 0.5 AS DOUBLE), p, ln(greatest(least(p, 0.99), 0.01) / (1 - greatest(least(p, 0.99), 0.01))), CAST(x >= y AND x >= z AS DOUBLE), CAST(NOT (x >= y AND x >= z) AND y >= z AS DOUBLE), greatest(x, y, z),
      -(x / t * ln(x / t) + y / t * ln(y / t) + z / t * ln(z / t)) / ln(3.0::DOUBLE), p, lz - (lx + ly + lz) / 3, floor(p * 3) / 2, (y + 2 * z) / t / 2, p, lx - (lx + ly + lz) / 3, lz - (lx + ly + lz) / 3]) AS value FROM n)
    SELECT item_id, term, round(value, 6) AS value FROM l""")  # fmt: skip
def m14(spark, d):
    """Every term of a yes/no answer, a choice of three and a score of three levels, confidence and levels' ratios too."""
    rows = W.table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), *[S.uniform(f"t{i}", "vec_id").alias(n) for i, n in ((1, "p"), (2, "x"), (3, "y"), (4, "z"))])
    chosen = F.when((F.col("x") >= F.col("y")) & (F.col("x") >= F.col("z")), "a").when(F.col("y") >= F.col("z"), "b").otherwise("c")
    masses = lambda *k: F.create_map(*[v for n, c in zip(k, "xyz", strict=True) for v in (F.lit(n), F.col(c))])
    none = lambda t: F.lit(None).cast(t)
    answer = lambda noul=None, choice=None, score=None, confidence=None, p=None: F.struct((noul if noul is not None else none("double")).alias("noul"), (choice if choice is not None else none("string")).alias("choice"), (score if score is not None else none("double")).alias("score"), (confidence if confidence is not None else none("double")).alias("confidence"), (p if p is not None else none("map<string,double>")).alias("probabilities"), none("map<string,string>").alias("legend"))
    three = {"a": None, "b": None, "c": None}
    kinds = {
        "noul": (scorecards.Question("noul"), answer(noul=F.col("p"))), "choice": (scorecards.Question("choice", criteria=three), answer(choice=chosen, confidence=F.col("p"), p=masses("a", "b", "c"))),
        "score": (scorecards.Question("score", criteria=["none", "some", "all"]), answer(score=F.floor(F.col("p") * 3).cast("double"), confidence=F.col("p"), p=masses("0", "1", "2"))),
    }
    left = {"choice.chosen.c", "choice.clr.a", "choice.clr.b", "score.clr.1"}  # what the others say already
    terms = [(f"{k}.{t}", c) for k, (q, a) in kinds.items() for t, c in scorecards.term_columns(a, q).items() if f"{k}.{t}" not in left]
    return rounded(rows.select("item_id", F.explode(F.array(*[F.struct(F.lit(n).alias("term"), c.cast("double").alias("value")) for n, c in terms])).alias("t")).select("item_id", "t.*"))


@query("a13_served_weighted", f"""WITH {W.SCORED}, r AS (SELECT *, 1 / (0.01::DOUBLE + 0.99::DOUBLE * {W.u('pr', 'item_id')}) AS raw FROM scored), m AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY raw, item_id) AS j FROM r), c AS (SELECT *, least(raw, 20 * max(CASE WHEN j = n // 2 + 1 THEN raw END) OVER ()) AS capped FROM m),
    w AS (SELECT *, capped * n / sum(capped) OVER () AS w FROM c) SELECT count(*) AS n, round(sum(w * correct) / sum(w), 6) AS accuracy, round(sum(w * (confidence - correct) * (confidence - correct)) / sum(w), 6) AS brier, round(sum(w) * sum(w) / sum(w * w), 4) AS n_effective FROM w""")  # fmt: skip
def a13(spark, d):
    """The served incumbent on labelled items, weights capped and scaled as a fit's are."""
    rows = W.scored(spark, d).drop("weight").withColumn("propensity", F.lit(0.01) + 0.99 * S.uniform("pr", "item_id"))
    w, k, c = F.col("weight"), F.col("correct"), F.col("confidence")
    out = sampling.inverse_propensity(rows, []).agg(F.count("*").alias("n"), metrics.accuracy(w, k).alias("accuracy"), metrics.brier(w, c, k).alias("brier"), metrics.kish(w).alias("n_effective"))
    return out.select("n", F.round("accuracy", 6).alias("accuracy"), F.round("brier", 6).alias("brier"), F.round("n_effective", 4).alias("n_effective"))


_raw = ", ".join(f"coalesce({f}, 0) AS {f}" for f in NAMES)
_far = " + ".join(f"((p.{f} - k.{f}) / s.{f}) * ((p.{f} - k.{f}) / s.{f})" for f in NAMES)


@query("c01_novelty", f"""WITH v AS (SELECT vec_id AS item_id, {', '.join(f"coalesce(CASE WHEN {W.u('m' + f, 'vec_id')} >= 0.1 THEN floor({W.u(f, 'vec_id')} * 64) / 16.0::DOUBLE - 2 END, 0) AS {f}" for f in NAMES)} FROM embeddings),
    s AS (SELECT {', '.join(f'coalesce(nullif(stddev_pop({f}), 0), 1) AS {f}' for f in NAMES)} FROM v WHERE item_id % 5 >= 2), d AS (SELECT p.item_id, min(sqrt({_far})) AS d FROM v p, v k, s WHERE p.item_id % 5 >= 2 AND k.item_id % 5 = 1 GROUP BY 1),
    n AS (SELECT item_id, d / (d + (SELECT CASE WHEN quantile_cont(d, 0.5) = 0 THEN 1 ELSE quantile_cont(d, 0.5) END FROM d)) AS novelty FROM d) SELECT item_id, round(novelty, 6) AS novelty, round(0.5::DOUBLE * novelty, 6) AS score FROM n""")  # fmt: skip
def c01(spark, d):
    """How far a pool item is from anything labelled, and what that adds to its score."""
    rows = vectors(spark, d)
    near = sampling.novelty(rows.where("item_id % 5 >= 2"), rows.where("item_id % 5 = 1"), NAMES)
    return rounded(near.select("item_id", "novelty", (F.lit(selecting.SIGNALS["novelty"]) * F.col("novelty")).alias("score")))


@query("a56_status", f"""WITH {W.FEEDBACK}, l AS (SELECT * FROM feedback QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY ts DESC, event_id DESC) = 1), r AS (SELECT item_id // 20 AS card, 1 / propensity AS raw FROM l),
    e AS (SELECT card, count(*) AS n_labelled, sum(raw) * sum(raw) / sum(raw * raw) AS n_effective FROM r GROUP BY 1)
    SELECT card, n_labelled, round(n_effective, 4) AS n_effective, CASE WHEN n_effective < 30 THEN 'hold' WHEN n_effective < 200 THEN 'shrunk' WHEN n_effective < 1000 THEN 'standard' ELSE 'rich' END AS tier, round(CASE WHEN n_effective < 30 THEN 30 - n_effective WHEN n_effective < 200 THEN 200 - n_effective WHEN n_effective < 1000 THEN 1000 - n_effective END, 4) AS to_next FROM e""")  # fmt: skip
def a56(spark, d):
    """Labels, effective labels, rung and what the next one needs, by card (twenty items each)."""
    latest = records.latest_by(W.feedback(spark, d), ["item_id"], ["ts", "event_id"])
    raw = F.lit(1.0) / F.col("propensity")
    n = latest.groupBy(F.floor(F.col("item_id") / 20).alias("card")).agg(F.count("*").alias("n_labelled"), metrics.kish(raw).alias("n_effective"))
    tier = F.lit(fitting.LADDER[0].name)
    for t in fitting.LADDER[1:]:
        tier = F.when(F.col("n_effective") >= t.least, t.name).otherwise(tier)
    return n.select("card", "n_labelled", F.round("n_effective", 4).alias("n_effective"), tier.alias("tier"), F.round(fitting.to_next(F.col("n_effective")), 4).alias("to_next"))


@query("a42_boundaries", f"SELECT c_custkey AS head, round(-i / nullif(w, 0), 6) AS boundary FROM (SELECT c_custkey, {W.u('hi', 'c_custkey')} - 0.5 AS i, CASE WHEN c_custkey % 9 = 0 THEN 0 ELSE {W.u('hw', 'c_custkey')} * 2 - 1 END AS w FROM customer)")
def a42(spark, d):
    """Where a head of one feature changes its mind; nowhere without a weight."""
    c = W.table(spark, d, "customer").select(F.col("c_custkey").alias("head"), (S.uniform("hi", "c_custkey") - 0.5).alias("intercept"), F.when(F.col("c_custkey") % 9 == 0, 0.0).otherwise(S.uniform("hw", "c_custkey") * 2 - 1).alias("weight"))
    return rounded(c.select("head", fitting.boundary(F.col("intercept"), F.col("weight")).alias("boundary")))
