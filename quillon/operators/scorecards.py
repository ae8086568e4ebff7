"""Scorecards: YAML to questions, features and a serving head, checked before anything runs on Spark.

A card has scores; a score has a question of its own (`self.holistic` in features), elements (`<key>.<term>`), elements shared with other
scores (`shared.<key>.<term>`) and a decision: a model, its classes, the features that it may use and their weights. A decision is
optional: a score without one answers with its own question. Keys that the format doesn't know are errors, not ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import selecting

KEY = re.compile(r"[A-Za-z0-9_-]+").fullmatch
KINDS, MODELS = ("noul", "choice", "score"), ("linear_threshold", "multinomial_logistic")
OWN, CLIP = "self.holistic", 0.01
#: What cached answers look like, by question name.
ANSWERS = "map<string,struct<noul:double,choice:string,score:double,confidence:double,probabilities:map<string,double>,legend:map<string,string>>>"


class Invalid(ValueError):
    """A scorecard that can't be served; the message says what is wrong."""


def _mapping(raw: Any, what: str, known: Sequence[str], needed: Sequence[str] = ()) -> Mapping[str, Any]:
    if not isinstance(raw, Mapping):
        raise Invalid(f"{what} is no mapping")
    if unknown := [str(k) for k in raw if k not in known]:
        raise Invalid(f"{what}: unknown {', '.join(sorted(unknown))}")
    if absent := [k for k in needed if raw.get(k) in (None, "")]:
        raise Invalid(f"{what}: {', '.join(absent)} missing")
    return raw


def _texts(values: Any, what: str) -> tuple[str, ...]:
    """Labels or options; YAML turns a bare yes, no, on or off into a boolean, which is refused."""
    found = list(values or ())
    if any(isinstance(x, bool) for x in found):
        raise Invalid(f"{what} holds a YAML boolean: quote yes, no, on and off")
    return tuple(map(str, found))


@dataclass(frozen=True)
class Question:
    kind: str
    instructions: Any = None
    criteria: Any = None

    @property
    def options(self) -> tuple[str, ...]:
        return tuple(map(str, self.criteria or ()))

    @property
    def body(self) -> dict[str, Any]:
        """What is asked; nothing is sent for what isn't there."""
        return {"type": self.kind} | ({} if self.instructions is None else {"instructions": self.instructions}) | ({"criteria": self.criteria} if self.criteria else {})

    @property
    def fingerprint(self) -> str:
        """sha256 of the body as JSON with sorted keys: another wording is another question."""
        return hashlib.sha256(json.dumps(self.body, sort_keys=True, default=str).encode()).hexdigest()

    @property
    def terms(self) -> tuple[str, ...]:
        """The terms that features may ask of an answer."""
        if self.kind == "noul":
            return ("logit_p", "p", "is_yes")
        if self.kind == "choice":
            return (*(f"{t}.{o}" for t in ("clr", "chosen") for o in self.options), "top_p", "entropy", "confidence")
        return ("score_norm", "expected_level", "confidence", *(f"clr.{i}" for i in range(len(self.options))))

    def check(self, where: str) -> None:
        if self.kind not in KINDS:
            raise Invalid(f"{where}: unknown question_type {self.kind!r}")
        least = {"noul": 0, "choice": 1, "score": 2}[self.kind]
        if len(_texts(self.criteria, where)) < least:
            raise Invalid(f"{where}: a {self.kind} question needs {least} or more criteria")


@dataclass(frozen=True)
class Element:
    key: str
    question: Question


@dataclass(frozen=True)
class Decision:
    model: str
    classes: tuple[str, ...]
    features: tuple[str, ...]
    weights: Mapping[str, Any] = field(default_factory=dict)
    positive_class: str | None = None
    threshold: float = 0.0
    clip: float = CLIP
    abstain_band: float = 0.0
    calibration: Mapping[str, Any] | None = None
    provenance: Mapping[str, Any] | None = None

    @property
    def head(self) -> dict[str, dict[str, float]]:
        """Weights by class. Those of a threshold rule are the positive class', less the threshold."""
        if self.model == "linear_threshold":
            flat = {str(f): float(w) for f, w in self.weights.items()}
            return {c: flat | {"intercept": flat.get("intercept", 0.0) - self.threshold} if c == self.positive_class else {} for c in self.classes}
        return {c: {str(f): float(w) for f, w in self.weights.get(c, {}).items()} for c in self.classes}

    def check(self, where: str, sources: Mapping[str, tuple[str, Question]]) -> None:
        for feature in self.features:
            source(feature, sources, where)
        if self.model not in MODELS:
            raise Invalid(f"{where}: unknown model {self.model!r}")
        if len(self.classes) < 2:
            raise Invalid(f"{where}: a decision needs two classes or more")
        if self.model == "linear_threshold":
            if len(self.classes) != 2 or self.positive_class not in self.classes:
                raise Invalid(f"{where}: a threshold rule needs two classes, one of them positive")
        elif extra := set(self.weights) - set(self.classes):
            raise Invalid(f"{where}: weights of {sorted(extra)}, which are no classes")
        if extra := set(selecting.features_of(self.head)) - set(self.features):
            raise Invalid(f"{where}: weights of {sorted(extra)}, which are no declared features")


@dataclass(frozen=True)
class Score:
    name: str
    key: str | None = None
    question: Question | None = None
    elements: tuple[Element, ...] = ()
    shared_elements: tuple[Element, ...] = ()
    decision: Decision | None = None

    @property
    def slug(self) -> str:
        return re.sub(r"[^a-z0-9]+", "_", (self.key or self.name).lower()).strip("_")

    @property
    def sources(self) -> dict[str, tuple[str, Question]]:
        """What features refer to -> (the question's name, the question). Own elements carry the score's slug in their name."""
        own = {OWN: (self.name, self.question)} if self.question else {}
        return own | {e.key: (f"{self.slug}.{e.key}", e.question) for e in self.elements} | {f"shared.{e.key}": (f"shared.{e.key}", e.question) for e in self.shared_elements}

    def check(self) -> None:
        where = f"score {self.name!r}"
        if not (self.question or self.decision):
            raise Invalid(f"{where} has neither a question nor a decision")
        if self.question:
            self.question.check(where)
        for elements in (self.elements, self.shared_elements):
            for i, e in enumerate(elements):
                if not KEY(e.key) or e.key in ("self", "shared"):
                    raise Invalid(f"{where}: {e.key!r} is no element key")
                if e.key in {x.key for x in elements[:i]}:
                    raise Invalid(f"{where}: {e.key} occurs twice")
                e.question.check(f"{where}, {e.key}")
        if self.decision:
            self.decision.check(where, self.sources)


@dataclass(frozen=True)
class Card:
    name: str
    scores: tuple[Score, ...]
    version: int = 1

    def __getitem__(self, name: str) -> Score:
        return next(s for s in self.scores if s.name == name)

    @property
    def questions(self) -> dict[str, Question]:
        """All questions of the card, which one request asks. Scores may share a question if they word it alike."""
        out: dict[str, Question] = {}
        for score in self.scores:
            for name, question in score.sources.values():
                if out.setdefault(name, question).fingerprint != question.fingerprint:
                    raise Invalid(f"{name} is worded in two ways, once by {score.name!r}")
        return out

    def check(self) -> Card:
        if not self.name or not self.scores:
            raise Invalid("a scorecard needs a name and a score")
        for i, s in enumerate(self.scores):
            if not s.name or s.name in {x.name for x in self.scores[:i]}:
                raise Invalid(f"{s.name!r} is no name of its own")
            s.check()
        self.questions  # noqa: B018  raises where wordings differ
        return self


def source(feature: str, sources: Mapping[str, tuple[str, Question]], where: str = "") -> tuple[str, Question, str]:
    """Question name, question and term of a feature's name."""
    ref = next((r for r in (OWN, *(x for x in sources if x != OWN)) if feature.startswith(f"{r}.") and r in sources), None)
    if ref is None:
        raise Invalid(f"{where}: {feature!r} refers to no element")
    name, question = sources[ref]
    term = feature[len(ref) + 1 :]
    if term not in question.terms:
        raise Invalid(f"{where}: a {question.kind} question has no term {term!r}")
    return name, question, term


def _question(raw: Mapping[str, Any]) -> Question | None:
    return Question(str(raw["question_type"]), raw.get("instructions"), raw.get("criteria")) if raw.get("question_type") is not None else None


def _element(raw: Any, where: str) -> Element:
    raw = _mapping(raw, f"{where}, an element", ("key", "question_type", "instructions", "criteria"), ("key", "question_type"))
    return Element(str(raw["key"]), _question(raw))


def _decision(raw: Any, where: str) -> Decision:
    where = f"{where}, decision"
    raw = _mapping(raw, where, ("model", "classes", "features", "parameters", "positive_class", "threshold", "clip", "abstain_band", "calibration", "provenance"), ("model", "classes"))
    if "features" not in raw:
        raise Invalid(f"{where}: features missing")
    features = [f["name"] if isinstance(f, Mapping) and f.get("name") else f for f in raw["features"] or ()]
    if any(isinstance(f, Mapping) for f in features):
        raise Invalid(f"{where}: a feature without a name")
    weights = _mapping(raw.get("parameters") or {}, f"{where}, parameters", ("weights",)).get("weights") or {}
    positive = raw.get("positive_class")
    numbers = {k: float(raw[k]) for k in ("threshold", "clip", "abstain_band") if raw.get(k) is not None}
    return Decision(str(raw["model"]), _texts(raw["classes"], where), tuple(map(str, features)), weights, None if positive is None else _texts([positive], where)[0], calibration=raw.get("calibration"), provenance=raw.get("provenance"), **numbers)


def from_config(raw: Any) -> Card:
    raw = _mapping(raw, "a scorecard", ("name", "version", "scores"), ("name", "scores"))
    scores = []
    for s in raw["scores"]:
        where = f"score {s.get('name')!r}" if isinstance(s, Mapping) else "a score"
        s = _mapping(s, where, ("name", "key", "question_type", "instructions", "criteria", "elements", "shared_elements", "decision"), ("name",))
        elements = {k: tuple(_element(e, where) for e in s.get(k) or ()) for k in ("elements", "shared_elements")}
        scores.append(Score(str(s["name"]), s.get("key"), _question(s), **elements, decision=_decision(s["decision"], where) if s.get("decision") else None))
    return Card(str(raw["name"]), tuple(scores), int(raw.get("version", 1))).check()


def parse(text: str) -> Card:
    """A card from YAML. Every rule that serving rests on is checked here."""
    try:
        return from_config(yaml.safe_load(text))
    except yaml.YAMLError as e:
        raise Invalid(f"no YAML: {e}") from e


def to_config(card: Card) -> dict[str, Any]:
    """The mapping that reads back as the same card; what is as it would be anyway is left out."""
    question = lambda q: {} if q is None else {"question_type": q.kind} | {k: v for k, v in (("instructions", q.instructions), ("criteria", q.criteria)) if v is not None}
    elements = lambda es: [{"key": e.key} | question(e.question) for e in es]

    def decision(d: Decision) -> dict[str, Any]:
        weights = {k: dict(v) if isinstance(v, Mapping) else v for k, v in d.weights.items()}
        own = {"positive_class": d.positive_class, "threshold": d.threshold or None, "clip": d.clip if d.clip != CLIP else None, "abstain_band": d.abstain_band or None, "calibration": d.calibration, "provenance": d.provenance}
        return {"model": d.model, "classes": list(d.classes), "features": list(d.features), "parameters": {"weights": weights}} | {k: v for k, v in own.items() if v}

    scores = [
        {"name": s.name} | ({"key": s.key} if s.key else {}) | question(s.question) | {k: elements(v) for k, v in (("elements", s.elements), ("shared_elements", s.shared_elements)) if v} | ({"decision": decision(s.decision)} if s.decision else {})
        for s in card.scores
    ]
    return {"name": card.name, "version": card.version, "scores": scores}


def dump(card: Card) -> str:
    return yaml.safe_dump(to_config(card), sort_keys=False, allow_unicode=True)


def with_fit(card: Card, name: str, head: Mapping[str, Any], calibration: Mapping[str, Any] | None = None, provenance: Mapping[str, Any] | None = None) -> Card:
    """The card with a fitted head (model, classes, weights) in a score's decision: numbers change, words don't."""
    if card[name].decision is None:
        raise Invalid(f"score {name!r} has no decision to put a fit in")
    fresh = replace(card[name].decision, model=head["model"], classes=tuple(head["classes"]), weights=head["weights"], positive_class=None, threshold=0.0, calibration=calibration, provenance=provenance)
    return replace(card, scores=tuple(replace(s, decision=fresh) if s.name == name else s for s in card.scores)).check()


def calibration_points(calibration: Mapping[str, Any] | None) -> list[float] | None:
    """The calibrated values over an even grid of raw ones from 0 to 1, or None where nothing is calibrated."""
    if not calibration or calibration.get("method", "none") == "none":
        return None
    xs, ys = calibration["raw_confidence"], calibration["calibrated_confidence"]
    if len(xs) < 2 or len(xs) != len(ys) or any(abs(x - i / (len(xs) - 1)) > 1e-9 for i, x in enumerate(xs)):
        raise Invalid("a calibration needs its values over an even grid from 0 to 1")
    return list(map(float, ys))


def question_set(spark: SparkSession, card: Card) -> DataFrame:
    """name, qhash, type: a row per question of the card as it is worded now."""
    return spark.createDataFrame([(n, q.fingerprint, q.kind) for n, q in card.questions.items()], "name string, qhash string, type string")


def term_columns(a: Column, question: Question, clip: float = CLIP) -> dict[str, Column]:
    """Term -> column over one answer (a struct of ANSWERS' values). An answer whose legend has another number of levels is an error."""
    if question.kind == "noul":
        p = a["noul"]
        return {"logit_p": S.logit(p, clip), "p": p, "is_yes": (p >= 0.5).cast("double")}
    keys = question.options if question.kind == "choice" else tuple(map(str, range(len(question.options))))
    given = [F.coalesce(F.try_element_at(a["probabilities"], F.lit(k)), F.lit(0.0)) for k in keys]
    masses = F.array(*given)
    out = {f"clr.{k}": x for k, x in zip(keys, S.centred_log_ratios(a["probabilities"], keys, clip), strict=True)} | {"confidence": a["confidence"]}
    if question.kind == "choice":
        return out | {f"chosen.{k}": F.coalesce((a["choice"] == k).cast("double"), F.lit(0.0)) for k in keys} | {"top_p": F.array_max(masses), "entropy": S.normalized_entropy(masses)}
    differs = a["legend"].isNotNull() & (F.size(a["legend"]) != len(keys))
    guarded = lambda x: F.when(differs, F.raise_error(F.lit(f"an answer's legend has not the {len(keys)} levels of the question")).cast("double")).otherwise(x)
    return {t: guarded(x) for t, x in (out | {"score_norm": a["score"] / max(len(keys) - 1, 1), "expected_level": S.expected_level(masses)}).items()}


def feature_columns(score: Score, answers: str = "answers") -> dict[str, Column]:
    """Declared feature -> column over a map of answers (ANSWERS) by question name. A missing answer gives null."""
    out: dict[str, Column] = {}
    for feature in score.decision.features if score.decision else ():
        name, question, term = source(feature, score.sources)
        a = F.try_element_at(answers, F.lit(name))
        out[feature] = F.when(a.isNotNull(), term_columns(a, question, score.decision.clip)[term])
    return out


def serve(answers: DataFrame, score: Score) -> DataFrame:
    """item_id, value, confidence (calibrated), raw_confidence, abstain, coverage, explanation of items with a map of answers. Without a
    decision the score's own question answers: coverage is 1 with an answer and 0, value null, without."""
    own = F.try_element_at("answers", F.lit(score.name))
    if score.decision is None:
        q = S.interpreted(F.lit(score.question.kind), own["noul"], own["choice"], own["probabilities"], own["score"])
        there = own.isNotNull()
        said = {"noul": q["confidence"], "choice": F.coalesce(F.try_element_at(own["probabilities"], own["choice"]), own["confidence"], F.lit(0.0)), "score": F.coalesce(own["confidence"], F.lit(0.0))}
        confidence = F.when(there, said[score.question.kind])
        none = F.lit(None).cast("string")
        return answers.select("item_id", F.when(there, q["value"]).alias("value"), confidence.alias("confidence"), confidence.alias("raw_confidence"), F.lit(False).alias("abstain"), there.cast("double").alias("coverage"), none.alias("explanation"))
    decision, columns = score.decision, feature_columns(score)
    safe = {f: f"f{i}" for i, f in enumerate(columns)}  # names with dots would be read as fields
    head = {c: {safe.get(f, f): w for f, w in ws.items()} for c, ws in decision.head.items()}
    rows = selecting.decided(answers.select("item_id", *[c.alias(safe[f]) for f, c in columns.items()]), head)
    called = F.create_map(*[F.lit(x) for f, s in safe.items() for x in (s, f)]) if safe else F.create_map(F.lit(""), F.lit(""))
    drivers = F.transform(selecting.largest(F.col("contributions")), lambda x: F.struct(called[x["feature"]].alias("feature"), x["value"].alias("value")))
    table = calibration_points(decision.calibration)
    shown = S.calibrated(F.col("confidence"), table) if table else F.col("confidence")
    return rows.select("item_id", F.col("top").alias("value"), shown.alias("confidence"), F.col("confidence").alias("raw_confidence"), (F.col("margin") < decision.abstain_band).alias("abstain"), "coverage", selecting.explanation(F.col("top"), shown, drivers).alias("explanation"))
