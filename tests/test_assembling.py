"""Names, replies, matrices, fit ids, heads, mismatches: hand-derived values and edges."""

import pytest
from pyspark.sql import functions as F

from quillon.functions import rewrites as R
from quillon.functions import scalars as S
from quillon.operators import fitting, paired, shortlist
from quillon.sources import files


@pytest.mark.parametrize(
    "text, want",
    [
        ('{"a": 1}', '{"a": 1}'), ('so: {"a": {"b": []}} ok', '{"a": {"b": []}}'), ('```json\n{"a": 1}\n``` or {b}', '{"a": 1}'), ('```{"a": 1}```', '{"a": 1}'),
        ("{'a': 1}", None), ('{"a": 1} {"b": 2}', None), ('{"a": 1}, {"b": 2}', None), ("[1]", None), ("}{", None), ("", None), (None, None), ('{"a": 1', None), ("{}", "{}"),
    ],
)
def test_json_reply(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(S.json_reply(F.col("t"))).first()[0] == want


def test_redacted_names(spark):
    rows = spark.createDataFrame([("Emily met Greg's Emilyn, emily; ÉEmily Emily_",), ("",), (None,)], "t string")
    got = [r[0] for r in rows.select(R.redact_names(F.col("t"), ["Emily", "Greg"])).collect()]
    assert tuple(got[0]) == ("[name] met [name]'s Emilyn, emily; ÉEmily Emily_", 2) and tuple(got[1]) == ("", 0) and got[2] is None


def test_full_names(spark):
    texts = ["Today he and she met [name] and Dr. Jones.", "[name][name]", "Smithson only", "", None]
    got = [r[0] and tuple(r[0]) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(R.with_full_name(F.col("t"), "Ann", "Lee", ["Jones", "Smith", "He"])).collect()]
    assert got == [("Today Ann Lee and she met Ann and Dr. Lee.", True, 1, 1), ("AnnAnn", False, 2, 0), (None, False, 0, 0), (None, False, 0, 0), None]


def test_matrix_refuses_what_is_missing(spark):
    rows = spark.createDataFrame([(1, 0.1, 0.2), (2, None, 0.3), (3, float("nan"), None)], "id int, a double, b double")
    assert [(r.missing, r.vector) for r in fitting.matrix(rows, ["b", "a"]).orderBy("id").collect()] == [([], [0.2, 0.1]), (["a"], None), (["b", "a"], None)]
    assert [r.vector for r in fitting.complete_matrix(rows.where("id = 1"), ["a", "b"]).collect()] == [[0.1, 0.2]]
    with pytest.raises(Exception, match="full coverage; missing a"):
        fitting.complete_matrix(rows.where("id = 2"), ["a", "b"]).collect()
    assert fitting.complete_matrix(rows.limit(0), ["a", "b"]).count() == 0


def test_fit_ids_name_what_was_learnt_from(spark):
    rows = spark.createDataFrame([(1, "yes"), (2, "no"), (2, "no"), (3, None)], "item_id long, label string")
    name = lambda df, c=0.3: fitting.fit_ids(df, [], ["a"], c).first()["fit_id"]
    assert name(rows) == name(rows.orderBy(F.desc("item_id")).repartition(3)) and len(name(rows)) == 13
    assert len({name(rows), name(rows, 0.1), name(rows.where("item_id < 3")), name(rows.distinct())}) == 4


def test_serving_heads():
    two = fitting.serving_head(["b", "a"], ["x"], [0.5], [[2]], ["b", "c", "a"])
    assert two == {"model": "multinomial_logistic", "classes": ["b", "a"], "weights": {"b": {"intercept": 0.5, "x": 2.0}}}
    three = fitting.serving_head(["a", "b", "z"], ["x"], [0, 1, 2], [[3], [4], [5]], ["z"])
    assert three["classes"] == ["z", "a", "b"] and three["weights"]["z"] == {"intercept": 2.0, "x": 5.0}


def test_flip_mismatches(spark):
    pairs = spark.createDataFrame([(1, 0.91234567, "y", "n"), (2, 0.2, "n", "n"), (3, 0.2, None, "n")], "source_id long, p double, predicted string, twin_predicted string")
    assert [tuple(r) for r in paired.flip_mismatches(pairs).collect()] == [(1, "y", 0.9123, "n", "only the pronouns differ")]
    assert paired.flip_mismatches(pairs.limit(0)).count() == 0


def test_versions_are_never_overwritten(spark, tmp_path):
    folder = f"file://{tmp_path}/cards"
    assert files.lineage(spark, folder).count() == 0
    with pytest.raises(ValueError, match="no version 0"):
        files.version_text(spark, folder)
    assert files.commit(spark, folder, "a: 1\n", "authored", 0) == 1
    assert files.commit(spark, folder, "a: 2\n", "fitted", 7, {"fit_id": "dh-1"}) == 2
    got = files.lineage(spark, folder).collect()
    assert [(r.version, r.parent, r.kind, r.n_feedback, len(r.sha256)) for r in got] == [(1, None, "authored", 0, 16), (2, 1, "fitted", 7, 16)]
    assert files.version_text(spark, folder) == "a: 2\n" and files.version_text(spark, folder, 1) == "a: 1\n"
    with pytest.raises(files.Conflict):
        files.commit(spark, folder, "a: 3\n", "authored", 9, expected=1)  # on top of a version that another has come after
    assert files.version_of(spark, folder) == 2


def test_only_positives_count_as_entering_or_leaving(spark):
    rows = [("a", 0.9, 0.1, "female", False), ("b", 0.8, 0.9, "female", True), ("c", 0.7, 0.95, "male", True), ("d", 0.6, 0.99, "male", False)]
    got = shortlist.fairness(spark.createDataFrame(rows, "item_id string, score double, twin_score double, gender string, positive boolean"), [2]).first()
    assert (got.female_in, got.female_out, got.male_in, got.male_out) == (0, 0, 1, 0) and got.ratio is None
