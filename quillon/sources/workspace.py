"""A workspace: items, answers, labels, events and the versions of a scorecard in one shared folder, and refits as transactions.

Labels and events are appended. A version of the scorecard is one file that holds its text and its place in the lineage, and comes into
being by a rename that fails if the file is there: of two commits at once one fails and leaves nothing, and a version without lineage
can't exist. A refit reads one version, fits and compares, and commits on top of that version or not at all; an event tells of it in any
case.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import filling, fitting, metrics, records, sampling, scorecards
from . import files

ITEMS = "item_id string, text string, split string"
FEEDBACK = "seq long, item_id string, score_name string, initial string, final string, comment string, label_source string, is_invalid boolean, propensity double, at string"
EVENTS = "kind string, score_name string, at string, version long, n_feedback long, n_labelled long, data string"


class Missing(LookupError):
    """There is no such workspace, item or version."""


@dataclass(frozen=True)
class Outcome:
    """status: held, refused, rejected, promoted, or overtaken where another commit came first."""

    status: str
    reasons: tuple[str, ...] = ()
    version: int | None = None
    needs_answers: int = 0
    fit: Mapping[str, Any] | None = None


class Workspace:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    @classmethod
    def create(cls, items: DataFrame, card: scorecards.Card, root: str) -> Workspace:
        """A new workspace; a folder that holds one already is refused, since its labels would go."""
        found = cls(items.sparkSession, root)
        if found.exists:
            raise FileExistsError(f"{root} holds a workspace")
        items.select(F.col("item_id").cast("string").alias("item_id"), "text", "split").write.parquet(f"{found.root}/items")
        found.commit(card, "seed", expected=0)
        return found

    @property
    def exists(self) -> bool:
        return bool(files.version_of(self.spark, f"{self.root}/cards"))

    def _log(self, name: str, schema: str) -> DataFrame:
        try:
            return files.read_jsonl(self.spark, f"{self.root}/{name}", schema)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    # -- items, answers, labels --

    @property
    def items(self) -> DataFrame:
        if not self.exists:
            raise Missing(f"no workspace in {self.root}")
        return self.spark.read.schema(ITEMS).parquet(f"{self.root}/items")

    def item(self, item_id: str) -> Row:
        row = self.items.where(F.col("item_id") == str(item_id)).first()
        if row is None:
            raise Missing(f"no item {item_id}")
        return row

    def split(self, name: str) -> DataFrame:
        return self.items.where(F.col("split") == name)

    @property
    def answers(self) -> DataFrame:
        return filling.cached(self.spark, f"{self.root}/answers")

    def fill(self, items: DataFrame, client: filling.Client, run: str, version: int | None = None, **how: int) -> DataFrame:
        return filling.fill(items, self.card(version).questions, f"{self.root}/answers", client, run, **how)

    def add_feedback(self, rows: DataFrame) -> None:
        """Rows of FEEDBACK; seq, unique and growing, orders them."""
        files.append_jsonl(rows.select(*[c.split()[0] for c in FEEDBACK.split(", ")]), f"{self.root}/feedback")

    def feedback(self, score: str | None = None) -> DataFrame:
        rows = self._log("feedback", FEEDBACK)
        return rows if score is None else rows.where(F.col("score_name") == score)

    def labelled(self, score: str) -> DataFrame:
        """The latest record of each item with a trusted label: item_id, label, initial, propensity."""
        latest = records.latest_by(self.feedback(score), ["item_id"], ["seq"])
        label = records.label_of(F.col("label_source"), F.col("final"), F.col("is_invalid"))
        return latest.select("item_id", label.alias("label"), "initial", "propensity").where("label is not null")

    def labelled_ids(self, score: str) -> DataFrame:
        """Items that someone has judged, usable or not: they are not asked about again."""
        return self.feedback(score).select("item_id").distinct()

    # -- versions and events --

    @property
    def version(self) -> int:
        return files.version_of(self.spark, f"{self.root}/cards")

    def card(self, version: int | None = None) -> scorecards.Card:
        return scorecards.parse(files.version_text(self.spark, f"{self.root}/cards", version))

    def commit(self, card: scorecards.Card, kind: str, provenance: Mapping[str, Any] | None = None, expected: int | None = None) -> int:
        """Adds a version on top of `expected` (the latest by default); files.Conflict if another has come first."""
        on = self.version if expected is None else expected
        numbered = scorecards.Card(card.name, card.scores, on + 1).check()
        flat = {k: v if isinstance(v, str) else json.dumps(v, default=str) for k, v in (provenance or {}).items()}
        return files.commit(self.spark, f"{self.root}/cards", scorecards.dump(numbered), kind, self.feedback().count(), flat, expected=on)

    def lineage(self) -> DataFrame:
        return files.lineage(self.spark, f"{self.root}/cards")

    def log_event(self, kind: str, score: str, **data: Any) -> None:
        row = (kind, score, datetime.now(UTC).isoformat(), self.version, self.feedback().count(), self.labelled(score).count(), json.dumps(data, default=str))
        files.append_jsonl(self.spark.createDataFrame([row], EVENTS).coalesce(1), f"{self.root}/events")

    def events(self, kind: str | None = None) -> DataFrame:
        rows = self._log("events", EVENTS)
        return rows if kind is None else rows.where(F.col("kind") == kind)

    # -- refit --

    def answer_maps(self, card: scorecards.Card) -> DataFrame:
        """item_id, answers (a map by question name) to the card's questions as they are worded in it."""
        asked = scorecards.question_set(self.spark, card).select("name", "qhash")
        now = self.answers.join(F.broadcast(asked), ["name", "qhash"])  # the questions of one card
        return now.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "answer"))).alias("answers"))

    def training(self, card: scorecards.Card, score: scorecards.Score) -> tuple[DataFrame, dict[str, str], int]:
        """Rows a fit can use (item_id, label, answers, features under safe names, weight), safe name -> feature, and how many labelled
        items lack an answer."""
        classes = F.create_map(*[x for c in score.decision.classes for x in (S.normalize_label(F.lit(c)), F.lit(c))])
        usable = self.labelled(score.name).withColumn("label", F.try_element_at(classes, S.normalize_label(F.col("label")))).where("label is not null and propensity is not null")
        columns = scorecards.feature_columns(score)
        safe = {f"f{i}": f for i, f in enumerate(columns)}
        rows = usable.join(self.answer_maps(card), "item_id", "left").withColumn("answers", F.coalesce("answers", F.create_map().cast(scorecards.ANSWERS)))
        rows = rows.select("item_id", "label", "propensity", "answers", *[columns[f].alias(n) for n, f in safe.items()])
        whole = F.size(F.array_compact(F.array(*[F.col(n).cast("double") for n in safe]))) == len(safe)
        lacking = rows.where(~whole).count()
        return sampling.inverse_propensity(rows.where(whole), []), safe, lacking

    def refit(self, name: str, dry_run: bool = False) -> Outcome:
        """Fits the score's head to all labels so far and promotes it if it beats the version that was read, served on the same items."""
        version = self.version
        card = self.card(version)
        score = card[name]
        rows, safe, lacking = self.training(card, score)
        path = files.new_path(self.spark, "training")
        rows.write.parquet(path)
        outcome = self._attempt(card, score, version, self.spark.read.schema(rows.schema).parquet(path), safe, lacking, dry_run)
        fit = outcome.fit or {}
        self.log_event("fit", name, status=outcome.status, promoted=outcome.status == "promoted", reasons=outcome.reasons, new_version=outcome.version, needs_answers=lacking, **{k: fit.get(k) for k in ("tier", "log_loss", "accuracy", "brier", "c")})
        return outcome

    def _attempt(self, card: scorecards.Card, score: scorecards.Score, version: int, rows: DataFrame, safe: dict[str, str], lacking: int, dry_run: bool) -> Outcome:
        present = sorted(r[0] for r in rows.select("label").distinct().collect())
        n_effective = rows.agg(F.coalesce(F.sum("weight") * F.sum("weight") / F.sum(F.col("weight") * F.col("weight")), F.lit(0.0))).first()[0]
        code = F.create_map(*[x for i, c in enumerate(present) for x in (F.lit(c), F.lit(float(i)))])[F.col("label")] if present else F.lit(0.0)
        try:
            found = fitting.fit_head(rows.select("item_id", code.alias("y"), "weight", *safe), list(safe), n_effective)
        except fitting.Refused as e:
            return Outcome("refused", (str(e),), needs_answers=lacking, fit={"tier": fitting.tier_for(n_effective).name})
        if found["status"] == "held":
            return Outcome("held", (found["reason"],), needs_answers=lacking, fit=found)
        served = scorecards.serve(rows.select("item_id", "answers"), score).join(rows.select("item_id", "label", "weight"), "item_id")
        right = S.agrees(F.col("value"), F.col("label")).cast("int")
        scored = served.select(F.coalesce("confidence", F.lit(0.0)).alias("confidence"), right.alias("correct"), "weight").withColumn("all", F.lit(1))
        incumbent = metrics.summary(scored, ["all"]).select("accuracy", "brier")
        candidate = self.spark.createDataFrame([(found["accuracy"], found["brier"], n_effective)], "accuracy double, brier double, n_effective double")
        verdict = fitting.compare(candidate, incumbent).first()
        if not verdict["promoted"]:
            return Outcome("rejected", tuple(verdict["reasons"]), needs_answers=lacking, fit=found)
        if dry_run:
            return Outcome("promoted", needs_answers=lacking, fit=found)
        heads = found["heads"]
        head = fitting.serving_head(present, list(safe.values()), [b for b, _ in heads], [list(w.values()) for _, w in heads], score.decision.classes)
        provenance = {"tier": found["tier"], "n_effective": n_effective, "c": found["c"], "features": list(safe.values())}
        try:
            return Outcome("promoted", (), self.commit(scorecards.with_fit(card, score.name, head, found["calibration"], provenance), "fit", provenance, expected=version), lacking, found)
        except files.Conflict as e:
            return Outcome("overtaken", (str(e),), needs_answers=lacking, fit=found)
