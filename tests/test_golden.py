"""Hand-derived values."""

import pytest
from pyspark.sql import functions as F

from quillon.functions import rewrites as R
from quillon.functions import scalars as S
from quillon.operators import fitting, metrics, records, sampling, shortlist


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def scored(spark, rows):
    return spark.createDataFrame([(c, k, 1.0) for c, k in rows], "confidence double, correct int, weight double")


def test_ece_and_the_last_bin(spark):
    assert metrics.calibration_error(scored(spark, [(0.95, 1), (0.95, 0), (0.65, 1), (0.65, 1)])).first()[0] == pytest.approx(0.40)
    assert metrics.reliability(scored(spark, [(1.0, 1)])).first()["bin"] == 9
    assert metrics.calibration_error(scored(spark, [])).collect()[0][0] == 0.0


def test_coverage_takes_equal_confidences_together_and_stops_at_the_first_failure(spark):
    got = metrics.coverage_at(scored(spark, [(0.9, 1), (0.9, 1), (0.8, 0), (0.7, 1)])).first()
    assert (got["coverage"], got["accuracy"], got["tie_block"]) == (0.5, 1.0, 2)
    none = metrics.coverage_at(scored(spark, [(0.9, 0), (0.8, 1)])).first()
    assert (none["coverage"], none["accuracy"], none["tie_block"]) == (0.0, None, 0)


def test_auroc_with_ties(spark):
    assert metrics.auroc(scored(spark, [(0.9, 1), (0.8, 1), (0.8, 0), (0.1, 0)])).first()[0] == 0.875
    assert metrics.auroc(scored(spark, [(0.9, 1)])).first()[0] is None


def test_inverse_propensity_cap_and_scale(spark):
    rows = spark.createDataFrame([(1, 0.5), (2, 0.25), (3, 0.25), (4, 0.01)], "id int, propensity double").withColumn("g", F.lit(0))
    w = [r["weight"] for r in sampling.inverse_propensity(rows, ["g"]).orderBy("id").collect()]
    assert w == pytest.approx([2 * 4 / 90, 4 * 4 / 90, 4 * 4 / 90, 80 * 4 / 90])
    assert sum(w) ** 2 / sum(x * x for x in w) == pytest.approx(1.2585, abs=1e-3)
    with pytest.raises(Exception, match="propensity"):
        sampling.inverse_propensity(rows.withColumn("propensity", F.lit(0.0)), ["g"]).collect()


def test_selection_is_even_for_equal_scores_and_never_below_the_floor(spark):
    rows = spark.createDataFrame([(i, 1.0) for i in range(4)], "item_id int, score double")
    assert [r["probability"] for r in sampling.selection_distribution(rows).collect()] == pytest.approx([0.25] * 4)
    far = spark.createDataFrame([(0, 100.0), (1, 0.0)], "item_id int, score double")
    assert min(r["probability"] for r in sampling.selection_distribution(far).collect()) >= 0.15 / 2


def test_identity_head(spark):
    p = F.create_map(F.lit("positive"), F.lit(0.8), F.lit("negative"), F.lit(0.2))
    clr = S.centred_log_ratios(p, ["positive", "negative"])
    got = one(spark, a=clr[0], p=S.softmax([2.0 * clr[0], F.lit(0.0)])[0])
    assert got["a"] == pytest.approx(0.6931, abs=1e-4) and got["p"] == pytest.approx(0.8)


def test_entropies_and_levels(spark):
    arr = lambda *x: F.array(*map(F.lit, x))
    got = one(spark, even=S.normalized_entropy(arr(0.5, 0.5)), sure=S.normalized_entropy(arr(1.0, 0.0)), alone=S.normalized_entropy(arr(1.0)), level=S.expected_level(arr(0.0, 0.0, 2.0)))
    assert (got["even"], got["sure"], got["alone"], got["level"]) == (pytest.approx(1.0), 0.0, 0.0, 1.0)


def test_agreement_of_spellings(spark):
    a = lambda x, y: S.agrees(F.lit(x).cast("string"), F.lit(y).cast("string"))
    got = one(spark, nan=a("NaN", None), label=a("yes", "Yes."), prediction=a("Yes.", "yes"))
    assert (got["nan"], got["label"], got["prediction"]) == (True, True, False)


def test_gender_swap(spark):
    swap = lambda t: one(spark, s=R.swap_gender(F.lit(t)))["s"]
    got = swap("Her mother asked her.")
    assert (got["text"], got["swapped"], got["her_resolved"]) == ("His father asked him.", 3, 2)
    assert swap("She runs the women's health clinic.")["text"] == "He runs the women's health clinic."
    assert swap("HE met Mrs Jones")["text"] == "SHE met Mr Jones"
    assert swap("")["text"] == "" and one(spark, s=R.swap_gender(F.lit(None).cast("string")))["s"] is None


def test_names_and_ages(spark):
    assert one(spark, x=R.insert_name(F.lit("In 2003 she joined."), F.lit("Jamal")))["x"] == "In 2003 Jamal joined."
    assert one(spark, x=R.insert_name(F.lit("The hen."), F.lit("Jamal")))["x"] is None
    age = lambda t: one(spark, x=R.insert_age(F.lit(t), F.lit(61)))["x"]
    assert tuple(age("He is here.")) == ("At 61, he is here.", "sentence_initial")
    assert tuple(age("In 2003 she joined.")) == ("In 2003, at 61, she joined.", "mid_sentence")


def test_who_can_carry_an_age(spark):
    ok = lambda t: one(spark, x=R.eligible_for_age(F.lit(t)))["x"]
    assert [ok(t) for t in ("She works since 1998.", "He has 12 years.", "He has 9 years.", "She left in 2005.", "No pronoun.")] == [False, False, True, True, False]


def test_calibration_lookup(spark):
    table = [i / 100 for i in range(101)]
    table[50] = 0.6
    assert one(spark, x=S.calibrated(F.lit(0.505), table))["x"] == pytest.approx(0.555)
    assert one(spark, x=S.calibrated(F.lit(1.0), table))["x"] == pytest.approx(1.0)


def test_shortlist_ties_and_rereading(spark):
    pool = spark.createDataFrame([("a", 1.0, 1.0), ("b", 1.0, 0.0), ("c", 1.0, 1.0), ("d", 0.5, 2.0)], "item_id string, score double, twin_score double").withColumn("gender", F.lit("female")).withColumn("positive", F.lit(True))
    rows = {r["item_id"]: (r["selected"], r["selected_twin"]) for r in shortlist.with_membership(pool, 2).collect()}
    assert rows == {"a": (True, True), "b": (True, False), "c": (False, False), "d": (False, True)}
    got = shortlist.fairness(pool, [2]).first()
    assert (got["above"], got["tied"], got["female_in"], got["female_out"], got["ratio"]) == (0, 3, 1, 1, None)


def test_membership_against_resorting(spark):
    """The two-threshold rule gives what sorting anew for each applicant gives."""
    import random

    rng = random.Random(3)
    for n, cut in ((7, 3), (12, 5), (5, 9)):
        pool = [(f"{i}", rng.randrange(4) / 4, rng.randrange(4) / 4) for i in range(n)]
        df = spark.createDataFrame(pool, "item_id string, score double, twin_score double").withColumn("gender", F.lit("male")).withColumn("positive", F.lit(True))
        for r in shortlist.with_membership(df, cut).collect():
            for column, changed in (("selected", False), ("selected_twin", True)):
                order = sorted(((-(t if changed and i == r["item_id"] else s), i) for i, s, t in pool))[:cut]
                assert r[column] == (r["item_id"] in [i for _, i in order])


def test_plan_counts_items_and_answers(spark):
    items = spark.createDataFrame([(1,), (2,), (3,)], "item_id int")
    questions = spark.createDataFrame([("a", "h"), ("b", "h")], "name string, qhash string")
    cache = spark.createDataFrame([(1, "a", "h"), (1, "b", "h"), (2, "a", "h"), (3, "a", "old")], "item_id int, name string, qhash string")
    got = records.plan(records.missing(items, questions, cache)).first()
    assert (got["requests"], got["missing_answers"]) == (2, 3)
    assert [r[0] for r in records.complete_items(cache, questions).collect()] == [1]


def test_ladder_and_promotion(spark):
    assert [fitting.tier_for(n).name for n in (29.9, 30, 199, 200, 1000)] == ["hold", "shrunk", "shrunk", "standard", "rich"]
    assert [fitting.tier_for(n).budget(n) for n in (29.9, 30, 199, 200, 1000)] == [0, 6, 39, 20, 100]
    new = spark.createDataFrame([(0.80, 0.10, 90.0)], "accuracy double, brier double, n_effective double")
    old = spark.createDataFrame([(0.82, 0.11)], "accuracy double, brier double")
    assert fitting.compare(new, old).first()["promoted"]
    flips = spark.createDataFrame([("tone", 0.01), ("claim", 0.03)], "element string, flip_rate double")
    assert fitting.compare(new, old, flips=flips).first()["reasons"] == ["flips too often: claim"]
    few = spark.createDataFrame([(i, float(i > 97), 1.0, 0.0) for i in range(100)], "item_id int, y double, weight double, a double")
    assert fitting.fit_head(few, ["a"], 10.0)["status"] == "held"
    for features, n in ((["a"], 50.0), (["a"] * 11, 50.0)):  # two labels of a class; more features than the labels carry
        with pytest.raises(fitting.Refused):
            fitting.fit_head(few, features, n)


def test_fit_finds_the_side_and_takes_its_rungs_calibration(spark):
    rows = spark.createDataFrame([(i, float((i * 37) % 100 < 50), 1.0, ((i * 37) % 100 - 49.5) / 50 + (0.6 if i % 7 == 0 else 0.0)) for i in range(80)], "item_id int, y double, weight double, a double")
    found = fitting.fit_head(rows, ["a"], 80.0)
    assert (found["status"], found["tier"], found["method"]) == ("fitted", "shrunk", "temperature")
    assert found["weights"]["a"] < 0 and found["log_loss"] < 0.5


def test_strip_takes_all_white_space(spark):
    got = one(spark, a=S.normalize_label(F.lit(" Yes.\n")), b=S.strip(F.lit("\u00a0\t x y \u2003")), c=S.normalize_prediction(F.lit("\tA\u00a0\nb ")))
    assert tuple(got) == ("yes", "x y", "a b")


def test_pronouns_of_other_scripts_and_line_breaks(spark):
    got = one(spark, a=R.insert_age(F.lit("\nHe is here."), F.lit(61)), b=R.insert_name(F.lit("éhe went and she sat"), F.lit("Ann")), c=R.insert_age(F.lit("nobody"), F.lit(61)))
    assert tuple(got["a"]) == ("\nAt 61, he is here.", "sentence_initial") and got["b"] == "éhe went and Ann sat" and got["c"] is None


def test_calibration_is_monotone(spark):
    oof = spark.createDataFrame([(0.5 + (i % 50) / 100, int((i * 7) % 10 < 6), 1.0) for i in range(200)], "confidence double, correct int, weight double")
    table, method = fitting.calibration_table(oof)
    assert method == "two_stage" and len(table) == 101 and all(a <= b for a, b in zip(table, table[1:], strict=False))
    assert fitting.calibration_table(oof.limit(5))[1] == fitting.calibration_table(oof.limit(30))[1] == "none"
    assert fitting.calibration_table(oof.limit(30), "temperature")[1] == "temperature"
