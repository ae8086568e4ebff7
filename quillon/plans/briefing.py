"""Registered queries: what an analyst is shown, and what their proposals would cost."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import proposals, scorecards
from ..registry import query
from . import worlds as W
from .streamed import CARD

LABELLED = f"""labelled AS (SELECT item_id, rtrim(lower(final), '.') AS label, initial, comment, round({W.u('sh', 'event_id')}, 2) AS confidence, event_id AS "order" FROM feedback QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY ts DESC, event_id DESC) = 1)"""


def labelled(spark, d):
    f = W.feedback(spark, d)
    last = f.groupBy("item_id").agg(F.max_by(F.struct("final", "initial", "comment", "event_id"), F.struct("ts", "event_id")).alias("r"))
    return last.select("item_id", S.normalize_label(F.col("r.final")).alias("label"), "r.initial", "r.comment", F.round(S.uniform("sh", F.col("r.event_id")), 2).alias("confidence"), F.col("r.event_id").alias("order"))


@query("c10_mismatches", f"WITH {W.FEEDBACK}, {LABELLED} SELECT item_id, initial AS we_said, label AS human_said, comment, confidence FROM labelled WHERE initial <> label ORDER BY comment = '', confidence DESC, item_id LIMIT 25")
def c10m(spark, d):
    """What the score gets wrong, explained cases first."""
    return proposals.mismatches(labelled(spark, d)).select("item_id", F.col("initial").alias("we_said"), F.col("label").alias("human_said"), "comment", "confidence")


@query("c10_labelled_sample", f"""WITH {W.FEEDBACK}, {LABELLED} SELECT item_id, label FROM labelled QUALIFY row_number() OVER (PARTITION BY label ORDER BY "order" DESC, item_id) <= 80 // (SELECT count(DISTINCT label) FROM labelled)""")
def c10l(spark, d):
    return proposals.labelled_sample(labelled(spark, d)).select("item_id", "label")


@query("c10_blind_sample", f"""WITH {W.FEEDBACK}, {LABELLED} SELECT item_id, 'Group ' || chr(64 + CAST(dense_rank() OVER (ORDER BY label) AS INTEGER)) AS "group" FROM labelled QUALIFY row_number() OVER (PARTITION BY label ORDER BY "order" DESC, item_id) <= 40""")
def c10b(spark, d):
    """Two groups of texts, nothing said of what sets them apart."""
    return proposals.blind_sample(labelled(spark, d))


PROPOSALS = {
    "new": {"add_elements": [{"key": "irony", "question_type": "noul", "instructions": "Is it ironic?"}, {"key": "form", "question_type": "choice", "instructions": "What form has it?", "criteria": ["letter", "list", "verse"]}]},
    "words": {"reword_elements": [{"key": "tone", "instructions": "What tone does it take?"}]},
    "less": {"retire_elements": ["depth"]},
}


@query("c11_prices", f"""WITH c AS (SELECT vec_id AS item_id, q FROM embeddings, (SELECT unnest(['quality', 'clear', 'tone', 'depth', 'pace', 'mood']) AS q) WHERE {W.u('ch', 'vec_id', 'q')} >= 0.1),
    a AS (SELECT p, unnest(q) AS q FROM (SELECT unnest(['new', 'words', 'less']) AS p, unnest([['quality', 'clear', 'tone', 'depth', 'pace', 'mood', 'irony', 'form'], ['quality', 'clear', 'tone-2', 'depth', 'pace', 'mood'], ['quality', 'clear', 'tone', 'pace', 'mood']]) AS q)),
    m AS (SELECT p, item_id, count(*) AS n FROM (SELECT p, vec_id AS item_id, q FROM embeddings, a) ANTI JOIN c USING (item_id, q) GROUP BY 1, 2) SELECT p AS proposal, count(*) AS requests, sum(n)::BIGINT AS missing_answers FROM m GROUP BY p""")  # fmt: skip
def c11(spark, d):
    """What evaluating each of three proposals would cost, over the answers that are there; nothing is asked."""
    card = scorecards.parse(CARD)
    short = {n: n.split(".")[-1].lower() for n in card.questions}
    asked = spark.createDataFrame([(short[n], n, q.fingerprint) for n, q in card.questions.items()], "q string, name string, qhash string")
    items = W.table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"))
    cache = items.crossJoin(F.broadcast(asked)).where(S.uniform("ch", "item_id", "q") >= 0.1).select("item_id", "name", "qhash")
    out = None
    for name, raw in PROPOSALS.items():
        price = proposals.priced(proposals.applied(card, "Quality", proposals.parse(raw)), items, cache).select(F.lit(name).alias("proposal"), "*")
        out = price if out is None else out.unionByName(price)
    return out
