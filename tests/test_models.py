import math
import random

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from palaver.operators.scoring import (
    score_linear_joined,
    long_scores, prediction_rows, predictions_by_id, score_linear,
)
from palaver.operators.training import optimality, train_models
from palaver.plans.evaluate import cross_validate, training_fit

BITS = 4
VECTORS = "id int, vector array<struct<idx: int, value: double>>, labels map<string, boolean>"


@pytest.fixture(scope="module")
def vectors(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(120):
        good = rnd.random() < 0.5
        cells = {1 if good else 2: 1.0, rnd.randrange(3, 16): 0.5, 16: 1.0}
        labels = {"good": good} if i % 10 else {"good": good, "rare": i % 20 == 0}
        rows.append((i, list(cells.items())[::-1], labels))
    rows.append((900, [(1, 1.0)], None))
    return spark.createDataFrame(rows, VECTORS).cache()


def with_ml_vectors(vectors):
    cells = F.map_from_entries("vector")
    dense = F.transform(F.sequence(F.lit(1), F.lit(1 << BITS)), lambda i: F.coalesce(F.try_element_at(cells, i), F.lit(0.0)))
    return vectors.where("labels is not null").withColumn("x", array_to_vector(dense))


def test_all_models_at_once_agree_with_one_by_one(vectors):
    coded = vectors.withColumn("slice", F.pmod("id", F.lit(3))).cache()
    found = train_models(coded, ["good", "rare"], BITS, folds=("slice", [0, 1, 2]))
    gaps = optimality(coded, found, ["good", "rare"], BITS, folds=("slice", [0, 1, 2])).collect()
    assert len(gaps) == 6 and all(g.gap < 0.01 for g in gaps)
    mine = {(r.label, r.slice, r.idx): r.weight for r in found.collect()}
    for label, s in [("good", 1), ("rare", 2)]:
        rows = with_ml_vectors(coded.where(F.col("slice") != s)).withColumn("y", F.col("labels")[label].cast("double"))
        rows = rows.where("y is not null")
        fitter = LogisticRegression(
            featuresCol="x", labelCol="y", elasticNetParam=1.0, regParam=1 / (0.8 * rows.count()), standardization=False,
            fitIntercept=False, maxIter=400, tol=1e-9)
        for i, w in enumerate(fitter.fit(rows).coefficients.toArray()):
            if i != 15:  # that fitter leaves out a bucket of one value
                assert mine.get((label, s, i + 1), 0.0) == pytest.approx(w, abs=0.05)


def test_second_derivatives_stay_off_the_driver(spark, monkeypatch):
    rnd = random.Random(7)
    rows = []
    for i in range(400):
        good = rnd.random() < 0.5
        cells = set(rnd.sample(range(1, 1024), 60)) | {1, 2, 3 if good and i % 9 else 4}
        # Every bucket from 500 on goes with another one, as unigrams do with their lower case.
        cells |= {b - 400 for b in cells if b > 500}
        rows.append((i, [(b, 1.0) for b in sorted(cells)], {"good": good}))
    coded = spark.createDataFrame(rows, VECTORS).repartition(4).cache()
    received, whole = [], type(coded).toArrow

    def counted(df):
        found = whole(df)
        received.append(found.nbytes)
        return found

    monkeypatch.setattr(type(coded), "toArrow", counted)
    weights = train_models(coded, ["good"], 10)
    monkeypatch.undo()
    assert max(received) < 4 * 8 * 1025  # a few numbers per bucket
    assert len(received) < 60
    assert all(g.gap < 0.01 for g in optimality(coded, weights, ["good"], 10).collect())


def test_optimality_sums_slopes_before_it_shuffles_them(spark, vectors):
    coded = vectors.withColumn("slice", F.pmod("id", F.lit(3)))
    coded = coded.union(coded.limit(7)).unionByName(spark.createDataFrame(
        [(901, [], {"good": True}, 1), (902, None, {"good": True}, 1), (903, [(3, 2.0)], {"good": None}, 2)], coded.schema))
    weights = [("good", k, i, (i - 8) / 10) for k in range(3) for i in range(1, 17) if i % 3]
    table = spark.createDataFrame(weights, "label string, slice int, idx int, weight double")
    own = {(k, i): w for _, k, i, w in weights}
    found = optimality(coded, table, ["good"], BITS, 0.8, ("slice", [0, 1, 2]))
    rows = [r for r in coded.collect() if r.vector is not None and r.labels and r.labels["good"] is not None]
    got = {r.slice: (r.n, r.gap) for r in found.collect()}
    for k in range(3):
        used, slopes = [r for r in rows if r.slice != k], {}
        for r in used:
            off = 1 / (1 + math.exp(-sum(c.value * own.get((k, c.idx), 0.0) for c in r.vector))) - r.labels["good"]
            for c in r.vector:
                slopes[c.idx] = slopes.get(c.idx, 0.0) + off * c.value
        gaps = [abs(0.8 * s + math.copysign(1, own[k, i])) if own.get((k, i)) else abs(0.8 * s) - 1 for i, s in slopes.items()]
        assert got[k] == (len(used), pytest.approx(max(gaps)))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "inline(vector" not in plan  # no row per cell


def test_scores_are_computed_once_under_a_condition(vectors):
    weights = vectors.sparkSession.createDataFrame([("a", 1, 1.0)], "label string, idx int, weight double")
    found = score_linear(vectors, weights, ["a"], bits=BITS).where("p_a > 0.6 and p_a < 0.9")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1


def test_scores_equal_the_models_own_probabilities(spark, vectors):
    data = with_ml_vectors(vectors).withColumn("y", F.col("labels")["good"].cast("double"))
    model = LogisticRegression(featuresCol="x", labelCol="y", fitIntercept=False).fit(data)
    own = {r["id"]: r["probability"][1] for r in model.transform(data).collect()}
    weights = spark.createDataFrame(
        [("good", i + 1, float(w)) for i, w in enumerate(model.coefficients.toArray())],
        "label string, idx int, weight double")
    for found in (score_linear(data, weights, ["good"], bits=BITS), score_linear_joined(data, weights, ["good"])):
        assert {r["id"]: r["p_good"] for r in found.collect()} == pytest.approx(own)
    with pytest.raises(Exception, match="two models"):
        score_linear(data, weights.union(weights), ["good"], bits=BITS).collect()
    with pytest.raises(Exception, match="two models"):
        score_linear_joined(data, weights.union(weights), ["good"]).collect()


def test_no_known_bucket_gives_one_half(spark):
    rows = spark.createDataFrame([(1, [(3, 1.0)], None), (2, [], None)], VECTORS)
    weights = spark.createDataFrame([("a", 9, 1.0)], "label string, idx int, weight double")
    found = long_scores(score_linear(rows, weights, ["a"], bits=BITS), ["a"], ["id"])
    assert {(r["id"], r["p"]) for r in found.collect()} == {(1, 0.5), (2, 0.5)}


def test_training_drops_uncoded_rows_per_label_only(spark, vectors):
    weights = train_models(vectors, ["good", "rare"], bits=BITS)
    by = {(r["label"], r["idx"]): r["weight"] for r in weights.collect()}
    assert by["good", 1] > 0 > by["good", 2]
    assert all(w != 0 for w in by.values())
    fit = training_fit(vectors, ["good", "rare"], bits=BITS)
    found = {r["label"]: r for r in fit.collect()}
    assert found["good"]["accuracy"] == 1.0
    assert sum(found["rare"][c] for c in ("tp", "fp", "tn", "fn")) == 12


def test_every_coded_row_is_measured_once_in_cross_validation(spark, vectors):
    found = {r["label"]: r for r in
             cross_validate(vectors, ["good", "rare"], folds=3, bits=BITS).collect()}
    assert sum(found["good"][c] for c in ("tp", "fp", "tn", "fn")) == 120
    assert found["good"]["accuracy"] > 0.95


def test_prediction_rows(spark):
    scored = spark.createDataFrame(
        [(7, 0.9, 0.2, {"a": True, "b": True}, '"x"'), (8, 0.4, 0.5, None, "(empty)")],
        "id int, p_a double, p_b double, labels map<string, boolean>, snippet string")
    found = prediction_rows(scored, ["a", "b"])
    assert found.columns == ["label", "id", "predicted", "coded", "confidence", "correct", "diff",
                             "snippet"]
    rows = {(r["id"], r["label"]): r for r in found.collect()}
    assert rows[7, "a"]["correct"] == "Yes" and rows[7, "b"]["correct"] == "No"
    assert rows[8, "a"]["correct"] == "Unknown" and rows[8, "a"]["confidence"] == 0.6
    assert rows[7, "b"]["confidence"] == 0.8 and rows[7, "a"]["diff"].endswith("oldid=7")
    wide = {r["id"]: (r["a"], r["b"]) for r in predictions_by_id(found, ["a", "b"]).collect()}
    assert wide == {7: (True, False), 8: (False, False)}
