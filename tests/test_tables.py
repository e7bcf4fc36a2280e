import hashlib
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from palaver.operators import filters, joins, labels, metrics, ranking
from palaver.operators.folds import fold_split, slice_sizes


def join_by_hand(left, right, literal):
    pairs = [l + r for r in right for l in left if l[0] == r[0]]
    lone_right = [(None, None) + r for r in right if r[0] not in {l[0] for l in left}]
    keys = {r[0] for r in right}
    lone_left = [l + (None, None) for l in left if literal or l[0] not in keys]
    return sorted(pairs + lone_right + lone_left, key=str)


@pytest.mark.parametrize("literal", [False, True])
def test_outer_join_with_a_hot_right_key(spark, literal):
    rnd = random.Random(3)
    left = [(str(k), f"l{k}") for k in range(40)]
    right = [(str(7 if rnd.random() < 0.4 else rnd.randrange(60)), f"r{i}") for i in range(200)]
    found = joins.outer_join(
        spark.createDataFrame(left, "k1 string, a string"),
        spark.createDataFrame(right, "k2 string, b string"),
        "k1", "k2", emit_matched_left=literal,
    )
    assert sorted((tuple(r) for r in found.collect()), key=str) == join_by_hand(
        left, right, literal)


def test_outer_join_int_keys(spark):
    left = spark.createDataFrame([("007", "x"), ("a", "y")], "k1 string, a string")
    right = spark.createDataFrame([("7", "p"), ("A", "q")], "k2 string, b string")
    found = joins.outer_join(left, right, "k1", "k2", int_keys=True)
    assert {tuple(r) for r in found.collect()} == {
        ("007", "x", "7", "p"), (None, None, "A", "q"), ("a", "y", None, None)}


@pytest.mark.parametrize("rates,n,sizes", [
    ([3, 2, 2], 1000, [426, 284, 290]), ([1] * 5, 12, [2, 2, 2, 2, 4]), ([1, 1, 1], 2, [0, 0, 2]),
    ([2, 1, 0], 10, [6, 4, 0]), ([1], 3, [3]), ([1, 0, 1], 5, [2, 0, 3]),
])
def test_slices_have_exact_sizes_in_hash_order(spark, rates, n, sizes):
    assert slice_sizes(rates, n) == sizes
    ids = spark.range(n).withColumnRenamed("id", "k")
    found = {r["k"]: r["slice"] for r in fold_split(ids, "k", rates, seed=9, digits=1).collect()}
    order = sorted(range(n), key=lambda k: (hashlib.md5(f"9_{k}".encode()).hexdigest(), k))
    expected = [i for i, s in enumerate(sizes) for _ in range(s)]
    assert [found[k] for k in order] == expected


def test_split_of_nothing(spark):
    assert fold_split(spark.range(0), "id", [1, 1]).collect() == []


def test_self_and_override_filters(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (1, None)], "s int, r int")
    assert {r["r"] for r in filters.not_self(rows, "s", "r").collect()} == {2, None}
    kept = filters.filter_paths(rows, {"r": F.col("r").isNotNull()}, {"r": F.col("r").isNull()})
    assert [r["r"] for r in kept.collect()] == [None]


def test_one_hot_keeps_the_next_column(spark):
    rows = spark.createDataFrame([("1", "A", "n"), ("2", "?", "m")], "id string, lab string, z string")
    found = labels.one_hot(rows, "lab", ["A", "B"])
    assert found.columns == ["id", "A", "B", "z"]
    assert [tuple(r) for r in found.orderBy("id").collect()] == [
        ("1", 1, 0, "n"), ("2", None, None, "m")]


def test_pivot_takes_the_last_value_and_row(spark):
    rows = spark.createDataFrame(
        [("x", 1, "A", "1"), ("x", 2, "B", "0"), ("x", 3, "A", "0"), ("x", 4, "C", "1"),
         ("y", 1, "C", "1")], "id string, n int, lab string, val string")
    found = labels.pivot_last(rows, "id", "lab", "val", F.col("n"), ["A", "B"])
    assert {r["id"]: (r["A"], r["B"], r["n"], r["lab"]) for r in found.collect()} == {
        "x": ("0", "0", 4, "C"), "y": (None, None, 1, "C")}


def test_metrics_with_and_without_a_basis(spark):
    rows = [("a", True, True), ("a", True, False), ("a", False, False), ("a", False, True),
            ("a", True, None), ("b", True, None)]
    counts = metrics.confusion(
        spark.createDataFrame(rows, "label string, predicted boolean, coded boolean"))
    found = {r["label"]: r for r in metrics.quality(counts).collect()}
    assert [found["a"][c] for c in ("tp", "fp", "tn", "fn")] == [1, 1, 1, 1]
    assert found["a"]["fmeasure"] == pytest.approx(0.5)
    assert all(found["b"][c] != found["b"][c] for c in ("accuracy", "precision", "fmeasure"))
    nulls = metrics.quality(counts, undefined_as_null=True).where("label = 'b'").first()
    assert nulls["accuracy"] is None and nulls["fmeasure"] is None


def test_text_codes_and_an_ignored_one(spark):
    rows = [("a", "True", "True"), ("a", "False", "Unknown"), ("a", "False", "x")]
    counts = metrics.confusion(
        spark.createDataFrame(rows, "label string, predicted string, coded string"),
        positive="True", ignore="Unknown").first()
    assert (counts["tp"], counts["fp"], counts["tn"], counts["fn"]) == (1, 0, 0, 1)


def rank_by_hand(rows, labs, threshold):
    out = {}
    for i, lab in enumerate(labs):
        def key(row):
            s = sorted(row[1:])
            lead = row[1 + i] - s[-2]
            return (-lead if lead > 0 else s[-1] - row[1 + i], row[0])
        for n, row in enumerate(sorted((r for r in rows if r[1 + i] >= threshold), key=key), 1):
            out[lab, row[0]] = n
    return out


def test_margin_ranks_with_many_ties(spark):
    rnd = random.Random(1)
    rows = [(i, *[rnd.choice([0.25, 0.5, 0.5, 0.75]) for _ in "ab"]) for i in range(300)]
    scored = spark.createDataFrame(rows, "id int, p_a double, p_b double")
    found = ranking.label_lists(scored, ["a", "b"], 0.5, "id")
    assert {(r["label"], r["id"]): r["rank"] for r in found.collect()} == rank_by_hand(
        rows, ["a", "b"], 0.5)
    counts = {r["label"]: r["above"] for r in
              ranking.bucket_counts(scored, ["a", "b"], 0.5).collect()}
    assert counts["a"] == sum(r[1] > 0.5 for r in rows)
    loose = [r for r in rows if max(r[1:]) < 0.5]
    assert counts["uncertain"] == len(loose)
    assert ranking.uncertain(scored, ["a", "b"], 0.5).count() == len(loose)


def test_ranked_rows_are_computed_once(spark):
    met = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(i):
        met.add(1)
        return (i * 37 % 101) / 101

    scored = spark.range(500).select("id", score("id").alias("p_a"), F.lit(0.0).alias("p_b"))
    found = ranking.rank_within(scored, ["p_b"], ["p_a", "id"]).collect()
    order = sorted(range(500), key=lambda i: ((i * 37 % 101) / 101, i))
    assert [r["id"] for r in sorted(found, key=lambda r: r["rank"])] == order
    assert met.value == 500


def test_one_label_is_ranked_by_score(spark):
    scored = spark.createDataFrame([(1, 0.6), (2, 0.9), (3, 0.1)], "id int, p_a double")
    found = ranking.label_lists(scored, ["a"], 0.5, "id")
    assert [r["id"] for r in found.orderBy("rank").collect()] == [2, 1]


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
def test_newest_by_counts_equals_a_sort(spark, kind):
    rows = spark.range(3000).withColumn(
        "ts", F.expr(f"{kind}'2011-01-01 00:00:00' + make_interval(0,0,0,0,0,0,"
                     "pmod(hash(id), 40000) / 2)"))
    plain = [r["id"] for r in ranking.newest(rows, "ts", "id", 700).collect()]
    assert [r["id"] for r in ranking.newest_counted(rows, "ts", "id", 700).collect()] == plain
    assert ranking.newest_counted(rows, "ts", "id", 5000).count() == 3000
