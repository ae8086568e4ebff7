"""Scorecards: what is refused, what survives a round trip; element importance against a plain computation."""

import math

import pytest
from pyspark.sql import functions as F

from quillon.operators import scorecards, selecting, studies
from quillon.plans.streamed import CARD


HOLISTIC = """
name: Mood
version: 3
scores:
  - name: Mood
    question_type: choice
    criteria: {good: null, bad: null}
    decision: {model: linear_threshold, classes: [good, bad], positive_class: good, threshold: 0.0, features: [self.holistic.clr.good], parameters: {weights: {intercept: 0.0, self.holistic.clr.good: 2.0}}}
"""
BARE = """
name: Mood
scores:
  - name: Mood
    question_type: choice
    instructions: How does it feel?
    criteria: {good: null, bad: null}
    elements:
      - {key: praise, question_type: noul, instructions: "Does it praise?"}
      - {key: force, question_type: score, instructions: "How strong is it?", criteria: [none, mild, strong]}
"""


@pytest.mark.parametrize("text", [CARD, HOLISTIC, BARE])
def test_round_trip_and_fingerprints(text):
    card = scorecards.parse(text)
    assert scorecards.parse(scorecards.dump(card)) == card
    assert {n: q.fingerprint for n, q in scorecards.parse(scorecards.dump(card)).questions.items()} == {n: q.fingerprint for n, q in card.questions.items()}


def test_another_wording_is_another_question():
    card, other = scorecards.parse(CARD).questions, scorecards.parse(CARD.replace("the tone", "its tone")).questions
    assert list(card) == ["Quality", "quality.clear", "quality.tone", "quality.depth", "shared.pace", "Mood"]
    assert [n for n in card if card[n].fingerprint != other[n].fingerprint] == ["quality.tone"]
    assert scorecards.parse(BARE).scores[0].decision is None and list(scorecards.parse(BARE).questions) == ["Mood", "mood.praise", "mood.force"]


BROKEN = [
    ("key: clear", "key: cle.ar"), ("key: clear", "key: self"), ("noul, instructions", "other, instructions"), ("{calm: null, angry: null}", "{}"), ("[none, some, much, full]", "[none]"), ("{calm: null, angry: null}", "{yes: 1, calm: 1}"),
    ("tone.clr.calm,", "tone.clr.sad,"), ("clear.logit_p,", "clear.clr,"), ("key: tone", "key: clear"), ("classes: [good, bad]", "classes: [good]"), ("classes: [good, bad]", "classes: [good, no]"), ("depth.score_norm,", "size.p,"),
    ("shared.pace.is_yes}]", "shared.speed.is_yes}]"), ("tone.clr.calm: 0.5", "tone.top_p: 0.5"), ("good: {self", "fine: {self"), ("multinomial_logistic", "forest"), ('positive_class: "positive"', 'positive_class: "other"'), ("threshold: 0.25", "treshold: 0.25"),
    ("name: Mood", "name: Quality"), ("name: Editing", "name: ''"), ("abstain_band: 0.05", "abstain: 0.05"), ('- {key: pace, question_type: noul, instructions: "Does it move on?"}\n  decision:\n    model: linear', '- {key: pace, question_type: noul, instructions: "Is it quick?"}\n  decision:\n    model: linear'), ("features: [self.holistic.clr.positive]", "features: [{label: x}]"),
]


@pytest.mark.parametrize("old,new", BROKEN)
def test_what_can_not_be_served_is_refused(old, new):
    assert old in CARD
    with pytest.raises(scorecards.Invalid):
        scorecards.parse(CARD.replace(old, new))


def test_serving(spark):
    answer = "struct<noul:double,choice:string,score:double,confidence:double,probabilities:map<string,double>,legend:map<string,string>>"
    rows = spark.createDataFrame([(1, {"Mood": (None, "good", None, 0.9, {"good": 0.8, "bad": 0.2}, None)}), (2, {})], f"item_id int, answers map<string,{answer}>")
    got = {r.item_id: r for r in scorecards.serve(rows, scorecards.parse(HOLISTIC)["Mood"]).collect()}
    assert (got[1].value, got[1].confidence, got[1].coverage) == ("good", pytest.approx(0.8), 1.0) and (got[2].confidence, got[2].coverage) == (0.5, 0.0)
    assert got[1].explanation == "good at 80%. Largest drivers: self.holistic.clr.good (+1.39)."
    plain = {r.item_id: r for r in scorecards.serve(rows, scorecards.parse(BARE)["Mood"]).collect()}
    assert (plain[1].value, plain[1].confidence, plain[2].value) == ("good", 0.8, None)
    legend = spark.createDataFrame([(1, {"mood.force": (None, None, 1.0, None, {"1": 1.0}, {"0": "none", "1": "mild"})})], rows.schema)
    decision = "\n    decision: {model: multinomial_logistic, classes: [a, b], features: [force.score_norm], parameters: {weights: {a: {force.score_norm: 1.0}}}}"
    with pytest.raises(Exception, match="legend"):
        scorecards.serve(legend, scorecards.parse(BARE + decision)["Mood"]).collect()


def test_a_fit_changes_numbers_not_words(spark):
    card = scorecards.parse(CARD)
    table = [min(1.0, i / 100 + 0.01) for i in range(101)]
    head = {"model": "multinomial_logistic", "classes": ["bad", "good"], "weights": {"good": {"clear.logit_p": 2.0, "intercept": 0.5}}}
    new = scorecards.with_fit(card, "Quality", head, {"method": "temperature", "raw_confidence": [i / 100 for i in range(101)], "calibrated_confidence": table})
    assert {n: q.fingerprint for n, q in new.questions.items()} == {n: q.fingerprint for n, q in card.questions.items()} and new["Mood"] == card["Mood"]
    assert new["Quality"].decision.head == {"bad": {}, "good": {"clear.logit_p": 2.0, "intercept": 0.5}} and scorecards.parse(scorecards.dump(new)) == new
    rows = spark.createDataFrame([(1, {"quality.clear": (0.5, None, None, None, None, None)})], f"item_id int, answers {scorecards.ANSWERS}")
    row = scorecards.serve(rows, new["Quality"]).first()
    assert row.value == "good" and row.raw_confidence == pytest.approx(1 / (1 + math.exp(-0.5))) and row.confidence == pytest.approx(row.raw_confidence + 0.01)
    with pytest.raises(scorecards.Invalid):
        scorecards.with_fit(card, "Quality", head | {"weights": {"good": {"tone.top_p": 1.0}}})


def test_flip_guard_raises(spark):
    a = spark.createDataFrame([(1, "tone", True), (2, "tone", False)], "item_id int, element string, verdict boolean")
    assert studies.flips_by_element(a, a.withColumn("verdict", F.lit(True))).first()["flip_rate"] == 0.5
    with pytest.raises(Exception, match="same items"):
        studies.flips_by_element(a, a.limit(1)).collect()


def test_importance_of_the_only_feature_that_counts(spark):
    head = {"a": {"x": 2.0, "y": 0.0}, "b": {"x": -2.0, "y": 0.0}}
    data = [(i, "a" if i % 2 else "b", 1.0, 1.0 if i % 2 else -1.0, float(i % 5)) for i in range(120)]
    rows = spark.createDataFrame(data, "id int, label string, w double, x double, y double")
    got = {r.element: r.importance for r in selecting.element_importance(rows, "id", "label", "w", {"x": ["x"], "y": ["y"]}, head, repeats=4).collect()}
    right, wrong = -math.log(1 / (1 + math.exp(-4))), -math.log(1 / (1 + math.exp(4)))
    assert got["y"] == pytest.approx(0, abs=1e-9) and 0.3 * (wrong - right) < got["x"] < 0.7 * (wrong - right)


@pytest.mark.parametrize("n", [40, 140, 2000])
def test_importance_is_that_of_shuffles_over_all_rows(spark, n):
    import hashlib
    import random

    rng, w = random.Random(n), (1.5, -0.5)
    x = [(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(n)]
    y = ["a" if 1.5 * a + rng.gauss(0, 0.3) > 0 else "b" for a, _ in x]
    weight = [1 + i % 3 for i in range(n)]

    def loss(values):
        p = [1 / (1 + math.exp(-(w[0] * a + w[1] * b) * (1 if t == "a" else -1))) for (a, b), t in zip(values, y, strict=True)]
        return -sum(v * math.log(max(q, 1e-9)) for v, q in zip(weight, p, strict=True)) / sum(weight)

    order = lambda salt: sorted(range(n), key=lambda i: (hashlib.md5(f"{salt}#{i}".encode()).hexdigest(), i))
    rises, own = [], order("base")
    for repeat in range(1, 9):
        from_ = dict(zip(own, order(repeat), strict=True))
        rises.append(loss([(x[from_[i]][0], x[i][1]) for i in range(n)]) - loss(x))
    rows = spark.createDataFrame([(i, y[i], float(weight[i]), *x[i]) for i in range(n)], "id int, label string, w double, x double, z double")
    got = selecting.element_importance(rows, "id", "label", "w", {"x": ["x"]}, {"a": {"x": w[0], "z": w[1]}, "b": {}}).first()
    assert got["importance"] == pytest.approx(sum(rises) / 8, abs=1e-9)
