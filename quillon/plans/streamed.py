"""Registered queries: sources, sinks, scorecards and streams, each against the batch rows it must give."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import scorecards
from ..registry import query
from ..sources import files, keyed
from ..streaming import feedback, ordered
from . import worlds as W
from .measure import rounded

ITEM = "doc_id long, text string, lang string"


@query("s01_jsonl_round_trip", "SELECT doc_id, lang, md5(coalesce(text, '')) AS digest FROM documents")
def s01(spark, d):
    """Appended as JSON lines, half of them gzip, and read back with a schema of fewer fields."""
    docs, path = W.table(spark, d, "documents"), files.new_path(spark, "items")
    files.append_jsonl(docs.where("doc_id % 2 = 0"), path)
    files.append_jsonl(docs.where("doc_id % 2 = 1 or doc_id is null"), path, gzip=True)
    return files.read_jsonl(spark, path, ITEM).select("doc_id", "lang", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))


@query("s17_csv_round_trip", "SELECT c_custkey, c_name, 'a \"b\", ' || chr(10) || c_mktsegment AS note FROM customer")
def s17(spark, d):
    """Written and read as CSV; quotes, commas and line breaks survive."""
    path = files.new_path(spark, "csv")
    W.table(spark, d, "customer").select("c_custkey", "c_name", F.concat(F.lit('a "b", \n'), "c_mktsegment").alias("note")).write.option("header", True).option("escape", '"').csv(path)
    return files.read_csv(spark, path, "c_custkey long, c_name string, note string")


@query("s05_answer_cache", f"""WITH a AS (SELECT vec_id AS item_id, n AS name, 'q-' || n AS qhash, s AS seq, {W.u('put', 'vec_id', 'n', 's')} AS noul FROM embeddings, (SELECT unnest(['tone', 'claim']) AS n), (SELECT unnest([1, 2]) AS s) WHERE s = 1 OR vec_id % 3 = 0)
    SELECT item_id, name, round(arg_max(noul, seq), 6) AS noul, max(seq)::BIGINT AS seq FROM a WHERE name = 'tone' GROUP BY 1, 2""")  # fmt: skip
def s05(spark, d):
    """Two puts into a cache, the latest read back for the questions asked."""
    path = files.new_path(spark, "cache")
    base = W.table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.explode(F.array(F.lit("tone"), F.lit("claim"))).alias("name"))
    for seq in (1, 2):
        rows = base if seq == 1 else base.where("item_id % 3 = 0")
        files.put_answers(path, rows.select("item_id", "name", F.concat(F.lit("q-"), "name").alias("qhash"), F.lit(seq).cast("long").alias("seq"), S.uniform("put", "item_id", "name", F.lit(seq)).alias("noul")))
    asked = spark.createDataFrame([("tone", "q-tone")], "name string, qhash string")
    return rounded(files.load_answers(spark, path, "item_id long, name string, qhash string, seq long, noul double", asked).select("item_id", "name", "noul", "seq"))


CARD = """
name: Editing
version: 1
scores:
- name: Quality
  key: quality
  question_type: choice
  instructions: Is the text good?
  criteria: {good: null, bad: null}
  elements:
  - {key: clear, question_type: noul, instructions: "Is the text clear?"}
  - {key: tone, question_type: choice, instructions: "What is the tone?", criteria: {calm: null, angry: null}}
  - {key: depth, question_type: score, instructions: "How deep is it?", criteria: [none, some, much, full]}
  shared_elements:
  - {key: pace, question_type: noul, instructions: "Does it move on?"}
  decision:
    model: multinomial_logistic
    classes: [good, bad]
    features: [self.holistic.clr.good, clear.logit_p, tone.clr.calm, depth.score_norm, depth.expected_level, {name: shared.pace.is_yes}]
    abstain_band: 0.05
    parameters:
      weights:
        good: {self.holistic.clr.good: 0.7, clear.logit_p: 0.8, tone.clr.calm: 0.5, depth.score_norm: 1.0, depth.expected_level: -0.6, shared.pace.is_yes: 0.3, intercept: -0.4}
- name: Mood
  key: mood
  question_type: choice
  instructions: How does the text feel?
  criteria: {positive: null, negative: null}
  shared_elements:
  - {key: pace, question_type: noul, instructions: "Does it move on?"}
  decision:
    model: linear_threshold
    classes: ["positive", "negative"]
    positive_class: "positive"
    threshold: 0.25
    features: [self.holistic.clr.positive]
    parameters:
      weights: {intercept: 0.0, self.holistic.clr.positive: 2.0}
"""


def card_answers(spark, d):
    """Answers to CARD's questions: clarity is missing from every seventh item."""
    u = lambda salt: S.uniform(salt, "vec_id")
    levels = [u(f"sl{i}") + 0.01 for i in range(4)]

    def answer(name, **parts):
        kinds = {"noul": "double", "choice": "string", "score": "double", "confidence": "double", "probabilities": "map<string,double>", "legend": "map<string,string>"}
        return F.struct(F.lit(name).alias("key"), F.struct(*[parts.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()]).alias("value"))

    two = lambda a, b, p: F.create_map(F.lit(a), p, F.lit(b), 1 - p)
    given = F.array(
        answer("Quality", probabilities=two("good", "bad", u("sc0"))), answer("quality.clear", noul=u("sc1")), answer("quality.tone", probabilities=two("calm", "angry", u("sc2"))),
        answer("quality.depth", score=F.floor(u("sc3") * 4), probabilities=F.create_map(*[x for i, v in enumerate(levels) for x in (F.lit(str(i)), v)])), answer("shared.pace", noul=u("sc4")), answer("Mood", probabilities=two("positive", "negative", u("sc5"))),
    )
    kept = F.filter(given, lambda x: (x["key"] != "quality.clear") | (F.col("vec_id") % 7 > 0))
    return W.table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.map_from_entries(kept).alias("answers"))


CLR = lambda p: f"(ln(greatest({p}, 0.01)) - ln(greatest(1 - {p}, 0.01))) / 2"


@query("s08_scorecard", f"""WITH a AS (SELECT vec_id AS item_id, {', '.join(f"{W.u(f'sc{i}', 'vec_id')} AS u{i}" for i in range(6))}, {', '.join(f"{W.u(f'sl{i}', 'vec_id')} + 0.01::DOUBLE AS l{i}" for i in range(4))}, vec_id % 7 = 0 AS gone FROM embeddings),
    z AS (SELECT item_id, 'Quality' AS score, 'good' AS yes, 'bad' AS no, gone, -0.4::DOUBLE + 0.7::DOUBLE * {CLR('u0')} + 0.8::DOUBLE * CASE WHEN gone THEN 0 ELSE ln(greatest(least(u1, 0.99), 0.01) / (1 - greatest(least(u1, 0.99), 0.01))) END
          + 0.5::DOUBLE * {CLR('u2')} + floor(u3 * 4) / 3 - 0.6::DOUBLE * (l1 + 2 * l2 + 3 * l3) / (l0 + l1 + l2 + l3) / 3 + 0.3::DOUBLE * CAST(u4 >= 0.5 AS INTEGER) AS z FROM a
          UNION ALL SELECT item_id, 'Mood', 'positive', 'negative', false, 2 * {CLR('u5')} - 0.25::DOUBLE FROM a)
    SELECT item_id, score, CASE WHEN z >= 0 THEN yes ELSE no END AS value, round(1 / (1 + exp(-abs(z))), 6) AS confidence, round(CASE WHEN gone THEN 5 / 6.0::DOUBLE ELSE 1 END, 6) AS coverage FROM z""")  # fmt: skip
def s08(spark, d):
    """A card of two scores from YAML, compiled to columns and served: elements, a shared one, the scores' own
    questions; a softmax head and a threshold rule."""
    card, rows = scorecards.parse(CARD), card_answers(spark, d)
    served = [scorecards.serve(rows, s).select("item_id", F.lit(s.name).alias("score"), "value", "confidence", "coverage") for s in card.scores]
    return rounded(served[0].unionByName(served[1]))


@query("t01_fingerprints", """SELECT name, sha256(body) AS qhash FROM (SELECT unnest(['Quality', 'quality.clear', 'quality.tone', 'quality.depth', 'shared.pace', 'Mood']) AS name, unnest([
    '{"criteria": {"bad": null, "good": null}, "instructions": "Is the text good?", "type": "choice"}', '{"instructions": "Is the text clear?", "type": "noul"}', '{"criteria": {"angry": null, "calm": null}, "instructions": "What is the tone?", "type": "choice"}',
    '{"criteria": ["none", "some", "much", "full"], "instructions": "How deep is it?", "type": "score"}', '{"instructions": "Does it move on?", "type": "noul"}', '{"criteria": {"negative": null, "positive": null}, "instructions": "How does the text feel?", "type": "choice"}']) AS body)
    SEMI JOIN (SELECT 1 FROM documents LIMIT 1) ON true""")  # fmt: skip
def t01(spark, d):
    """The questions that a card asks of the items, each once, by fingerprint."""
    return scorecards.question_set(spark, scorecards.parse(CARD)).select("name", "qhash")


def event_files(spark, d, parts=4):
    """The events as a log of several files, each a stretch of time: what a stream finds one by one."""
    path, events = files.new_path(spark, "log"), W.table(spark, d, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min(at), F.max(at)).first()
    part = F.least(F.floor((at - low) * parts / F.lit(max(1, (high or 0) - (low or 0)))), F.lit(parts - 1)).cast("int")
    for i in range(parts):
        events.where(part == i).coalesce(1).write.mode("append").parquet(path)
    return path


@query("r01_stream_latest", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def r01(spark, d):
    """The latest record per key, in a table of files that a stream merges its batches into."""
    stream = feedback.log_stream(spark, event_files(spark, d)).select("user_id", "event_id", "event_type", "ts")
    table = keyed.KeyedTable(spark, files.new_path(spark, "latest"), stream.schema, ["user_id"], ["ts", "event_id"])
    feedback.drained(stream, "latest-log", "append", table.merge)
    return table.read().select("user_id", "event_id", "event_type")


@query("r04_stream_distinct", "SELECT DISTINCT event_id % 1000 AS request FROM events")
def r04_distinct(spark, d):
    """R4 for good: a request is asked once in ten years. What is in flight, with state that ends, is r04_stream_in_flight."""
    stream = feedback.log_stream(spark, f"{d}/event*.parquet").select("ts", (F.col("event_id") % 1000).alias("request"))
    path = feedback.drained(feedback.distinct_requests(stream, ["request"], "3650 days"), "distinct")
    return spark.read.parquet(path).select("request")


UPTO = "(SELECT max(ts) FROM events) - INTERVAL '3 days'"


@query("r04_stream_in_flight", f"""WITH e AS (SELECT user_id AS request, list(struct_pack(at := epoch_us(ts), id := event_id) ORDER BY ts, event_id) AS l FROM events WHERE ts <= {UPTO} GROUP BY 1),
    f AS (SELECT request, list_reduce(list_prepend(struct_pack(until := -9223372036854775808, n := 0::BIGINT, out := []::STRUCT(event_id BIGINT, served BIGINT)[]), list_transform(l, lambda x: struct_pack(until := x.at, n := x.id, out := []::STRUCT(event_id BIGINT, served BIGINT)[]))),
        lambda s, x: CASE WHEN x.until < s.until THEN struct_pack(until := s.until, n := s.n + 1, out := s.out) ELSE struct_pack(until := x.until + 43200000000, n := 1::BIGINT, out := list_append(s.out, struct_pack(event_id := x.n, served := s.n))) END) AS r FROM e)
    SELECT request, u.event_id AS event_id, u.served AS served FROM (SELECT request, unnest(r.out) AS u FROM f)""")  # fmt: skip
def r04(spark, d):
    """Equal requests (here: of a user) in flight for twelve hours are one; a stream with one value of state a request."""
    stream = feedback.log_stream(spark, event_files(spark, d)).select(F.col("user_id").alias("request"), "event_id", "ts")
    out = ordered.swept(stream, "request", "ts", "event_id", ordered.InFlight(12 * 3600 * 1_000_000), ordered.InFlight.SCHEMA, "3 days", "in-flight")
    return spark.read.parquet(out).select("request", "event_id", "served")


@query("r06_stream_alignment", f"""WITH {W.FEEDBACK}, r AS (SELECT *, row_number() OVER (PARTITION BY label_source ORDER BY ts, event_id) AS k FROM feedback WHERE ts <= {UPTO}),
    p AS (SELECT a.label_source, a.k, b.event_id, 1 / b.propensity AS raw, b.initial = rtrim(lower(b.final), '.') AS ok, count(*) OVER (PARTITION BY a.label_source, a.k) AS n, row_number() OVER (PARTITION BY a.label_source, a.k ORDER BY 1 / b.propensity, b.event_id) AS j FROM r a JOIN r b ON a.label_source = b.label_source AND b.k BETWEEN a.k - 19 AND a.k),
    c AS (SELECT *, least(raw, 20 * max(CASE WHEN j = n // 2 + 1 THEN raw END) OVER (PARTITION BY label_source, k)) AS w FROM p)
    SELECT label_source, k, round(sum(w * CAST(ok AS INTEGER)) / sum(w), 6) AS agreement, round(sum(w) * sum(w) / sum(w * w), 4) AS n_effective FROM c GROUP BY 1, 2""")  # fmt: skip
def r06(spark, d):
    """Agreement over each source's last 20 labels, emitted label by label in the order of time; the last labels are state."""
    log = event_files(spark, d)
    n = W.table(spark, d, "documents").count()
    events = W.feedback_of(feedback.log_stream(spark, log), F.lit(n))
    ok = (S.normalize_label(F.col("initial")) == S.normalize_label(F.col("final"))).cast("int")
    rows = events.select("label_source", "ts", "event_id", "propensity", ok.alias("ok"))
    out = ordered.placed(rows, "label_source", "ts", "event_id", lambda r: ordered.aligned(r, "label_source"), "3 days", "alignment", window=20)
    return spark.read.parquet(out).select("label_source", "k", F.round("agreement", 6).alias("agreement"), F.round("n_effective", 4).alias("n_effective"))


STEPS = ((3, "steer-1"), (3, "steer-2"), (40, "steer-3"))


@query("r05_stream_steps", f"""WITH e AS (SELECT event_type AS score, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS labels FROM events WHERE ts <= {UPTO})
    SELECT score, labels, step FROM e JOIN (SELECT unnest([3, 3, 40]) AS after, unnest(['steer-1', 'steer-2', 'steer-3']) AS step) s ON labels = after UNION ALL SELECT score, labels, 'refit' FROM e WHERE labels % 5 = 0""")  # fmt: skip
def r05(spark, d):
    """Recorded steps fall due as the labels come in, and a refit every five, in a stream that counts them."""
    stream = feedback.log_stream(spark, event_files(spark, d)).select(F.col("event_type").alias("score"), "ts", "event_id")
    out = ordered.placed(stream, "score", "ts", "event_id", lambda r: ordered.due(r, "score", STEPS, 5), "3 days", "steps")
    return spark.read.parquet(out).select("score", "labels", "step")


@query("r02_refit_points", "WITH c AS (SELECT CAST(ts AS DATE) AS batch, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1), s AS (SELECT batch, n, sum(n) OVER (ORDER BY batch)::BIGINT AS labels FROM c) SELECT batch, labels, CAST(labels // 5 - (labels - n) // 5 AS BIGINT) AS refits FROM s")
def r02(spark, d):
    """R2: how many refits each day's labels call for, one every five."""
    counts = W.table(spark, d, "events").where("event_type = 'view'").groupBy(F.to_date("ts").alias("batch")).agg(F.count("*").alias("n"))
    return feedback.refit_points(counts)


@query("r07_stream_windows", "SELECT time_bucket(INTERVAL '1 day', ts) AS day, count(*) AS n, round(avg(value), 4) AS mean FROM events WHERE time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' <= (SELECT max(ts) FROM events) - INTERVAL '3 days' GROUP BY 1")
def r07s(spark, d):
    """Daily windows that the watermark, three days behind the latest event, has closed."""
    stream = feedback.log_stream(spark, f"{d}/event*.parquet").withColumn("agrees", F.col("value"))
    path = feedback.drained(feedback.windowed_agreement(stream, "1 day", "3 days"), "windows")
    return spark.read.parquet(path).select(F.col("start").cast("timestamp_ntz").alias("day"), "n", F.round("agreement", 4).alias("mean"))
