"""What an analyst is shown, and what becomes of what they propose. Replies are parsed and applied on the driver: one small object each."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from . import records
from .scorecards import OWN, Card, Element, Invalid, Question

#: New elements that one proposal may bring (a fixed value).
MOST_NEW = 8
HOLISTIC = ("self", OWN, "holistic")


class Unusable(ValueError):
    """A reply that is no proposal, or one that can't be applied; the message says why."""


@dataclass(frozen=True)
class Added:
    element: Element
    features: tuple[str, ...]


@dataclass(frozen=True)
class Proposal:
    root_cause: str = ""
    add: tuple[Added, ...] = ()
    retire: tuple[str, ...] = ()
    reword: tuple[tuple[str, str], ...] = ()

    @property
    def noop(self) -> bool:
        return not (self.add or self.retire or self.reword)

    def check(self) -> Proposal:
        if len(self.add) > MOST_NEW:
            raise Unusable(f"{len(self.add)} new elements; {MOST_NEW} at most")
        named = Counter([a.element.key for a in self.add] + list(self.retire) + [k for k, _ in self.reword])
        if twice := sorted(k for k, n in named.items() if n > 1):
            raise Unusable(f"{', '.join(twice)}: proposed more than once")
        return self


def default_features(key: str, question: Question) -> tuple[str, ...]:
    """What an element's answer says, in as few numbers as carry it."""
    if question.kind == "choice":
        return tuple(f"{key}.clr.{o}" for o in question.options[:-1]) or (f"{key}.top_p",)
    return (f"{key}.{'logit_p' if question.kind == 'noul' else 'expected_level'}",)


def _object(text: str) -> dict:
    """The JSON object in a reply with or without a fence and words around it."""
    inside = [part.strip().removeprefix("json").strip() for part in text.split("```")[1:-1:2]]
    for candidate in (*inside, text[text.find("{") : text.rfind("}") + 1]):
        try:
            found = json.loads(candidate)
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    raise Unusable("the reply holds no JSON object")


def parse(reply: str | Mapping[str, Any]) -> Proposal:
    raw = _object(reply) if isinstance(reply, str) else reply

    def listed(name: str) -> list:
        found = raw.get(name) or []
        if not isinstance(found, list):
            raise Unusable(f"{name} is no list")
        return found

    added = []
    for e in listed("add_elements"):
        if not isinstance(e, Mapping) or not all(e.get(k) for k in ("key", "question_type", "instructions")):
            raise Unusable("a new element needs key, question_type and instructions")
        kind, criteria, features = str(e["question_type"]), e.get("criteria") or None, e.get("features")
        if kind not in ("noul", "choice", "score") or (kind != "noul" and not isinstance(criteria, list | dict)):
            raise Unusable(f"{e['key']}: {kind} needs a list of criteria, or is no type")
        criteria = {"noul": None, "choice": {str(o): None for o in criteria or ()} if isinstance(criteria, list) else criteria, "score": [str(o) for o in criteria or ()]}[kind]
        question = Question(kind, str(e["instructions"]), criteria)
        if features is not None and not (isinstance(features, list) and all(isinstance(f, str) for f in features)):
            raise Unusable(f"{e['key']}: features is no list of names")
        added.append(Added(Element(str(e["key"]), question), tuple(features or default_features(str(e["key"]), question))))
    reworded = listed("reword_elements")
    if not all(isinstance(e, Mapping) and e.get("key") and e.get("instructions") for e in reworded):
        raise Unusable("a reworded element needs key and instructions")
    return Proposal(str(raw.get("root_cause") or "").strip(), tuple(added), tuple(map(str, listed("retire_elements"))), tuple((str(e["key"]), str(e["instructions"])) for e in reworded)).check()


def merged(replies: Sequence[str | Mapping[str, Any] | None]) -> Proposal:
    """Several proposals as one: of new elements with one key the first, the first root cause. The first reply must be usable, the others
    may fail."""
    parts = []
    for i, reply in enumerate(replies):
        try:
            if reply:
                parts.append(parse(reply))
        except Unusable:
            if i == 0:
                raise
    new: dict[str, Added] = {}
    for p in parts:
        for a in p.add:
            new.setdefault(a.element.key, a)
    return Proposal(next((p.root_cause for p in parts if p.root_cause), ""), tuple(new.values()), tuple(k for p in parts for k in p.retire), tuple(r for p in parts for r in p.reword)).check()


def applied(card: Card, name: str, proposal: Proposal) -> Card:
    """The card that a proposal leads to, its head's numbers cleared: they belong to the old features, and a fit sets them anew."""
    score = card[name]
    if score.decision is None:
        raise Unusable(f"{name} has no decision to extend")
    there = {e.key for e in score.elements}
    gone, words = set(proposal.retire), dict(proposal.reword)
    if unknown := sorted((gone - there) | (set(words) - there - set(HOLISTIC))):
        raise Unusable(f"{', '.join(unknown)}: no such element")
    if taken := sorted({a.element.key for a in proposal.add} & there):
        raise Unusable(f"{', '.join(taken)}: there already; reword it")
    say = lambda key, q: replace(q, instructions=words[key]) if key in words else q
    own = next((k for k in HOLISTIC if k in words), None)
    elements = [replace(e, question=say(e.key, e.question)) for e in score.elements if e.key not in gone] + [a.element for a in proposal.add]
    features = [f for f in score.decision.features if f.split(".")[0] not in gone]
    features += [f for f in dict.fromkeys(f for a in proposal.add for f in a.features) if f not in features]
    decision = replace(score.decision, features=tuple(features), model="multinomial_logistic", positive_class=None, threshold=0.0, weights={}, calibration=None, provenance=None)
    question = replace(score.question, instructions=words[own]) if own and score.question else score.question
    fresh = replace(score, question=question, elements=tuple(elements), decision=decision)
    try:
        return replace(card, scores=tuple(fresh if s.name == name else s for s in card.scores)).check()
    except Invalid as e:
        raise Unusable(f"the card would not be valid: {e}") from e


def priced(card: Card, items: DataFrame, cache: DataFrame) -> DataFrame:
    """requests, missing_answers: what it costs to have every answer of a card for items (item_id); cache: item_id, name, qhash."""
    asked = items.sparkSession.createDataFrame([(n, q.fingerprint) for n, q in card.questions.items()], "name string, qhash string")
    return records.plan(records.missing(items, asked, cache))


# -- what is shown; rows: item_id, label, initial, comment, confidence, order (grows with time) --


def newest(rows: DataFrame, per: int) -> DataFrame:
    """The newest `per` rows of each label: each of 16 parts of a label first, then those."""
    rank = lambda df, *keys: df.withColumn("_r", F.row_number().over(Window.partitionBy("label", *keys).orderBy(F.desc("order"), "item_id"))).where(F.col("_r") <= per).drop("_r")
    return rank(rank(rows.withColumn("_part", F.pmod(F.xxhash64("item_id"), F.lit(16))), "_part")).drop("_part")


def mismatches(rows: DataFrame, most: int = 25) -> DataFrame:
    """Rows whose first verdict wasn't the label, commented ones first, then by the confidence they were shown with."""
    wrong = rows.where(S.normalize_label(F.col("initial")) != S.normalize_label(F.col("label")))
    return wrong.orderBy(~(F.coalesce("comment", F.lit("")) != ""), F.desc(F.coalesce("confidence", F.lit(0.0))), "item_id").limit(most)


def labelled_sample(rows: DataFrame, most: int = 80) -> DataFrame:
    """As many of the newest rows of each label as `most` allows for all labels, right or wrong: errors alone show no base rates."""
    labels = rows.select("label").distinct().count()  # the classes of a score
    return newest(rows, max(1, most // max(1, labels)))


def blind_sample(rows: DataFrame, per: int = 40) -> DataFrame:
    """item_id, group: the newest rows of each label without the label's name, as Group A, Group B and on in order of the labels."""
    letters = rows.select("label").distinct().withColumn("group", F.concat(F.lit("Group "), F.char(F.lit(64) + F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("label")))))  # a row a class
    return newest(rows, per).join(F.broadcast(letters), "label").select("item_id", "group")
