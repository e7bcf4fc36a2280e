"""Linear scores of vectors by model weights, and prediction rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions.text import short_revision_link
from palaver.schemas import PREDICTION_COLUMNS


def wide_weights(weights: DataFrame, labels: list[str], within: str | None = None) -> DataFrame:
    """One row per bucket (and ``_group``, the value of ``within``) with a weight column per label.

    A second weight of a label for one bucket means that two models were given and stops the job.
    """
    of = weights.where(F.col("label").isin(labels))
    of = of.select(F.col(within).alias("_group") if within else F.lit(0).alias("_group"), "label", "idx", "weight")

    def single(label: str) -> Column:
        own = F.when(F.col("label") == label, F.col("weight"))
        wrong = F.raise_error(F.lit(f"two models for label {label}")).cast("double")
        return F.when(F.count(own) > 1, wrong).otherwise(F.max(own))

    return of.groupBy("_group", "idx").agg(*[single(lab).alias(f"w{i}") for i, lab in enumerate(labels)])


def weight_arrays(
    weights: DataFrame, labels: list[str], bits: int = 15, within: str | None = None
) -> DataFrame:
    """One row (per ``within`` value, as ``_group``) with ``_models``: an array of weights for each
    label, bucket by bucket from 0 to ``2 ** bits``, which bounds its size."""
    names = [f"w{i}" for i in range(len(labels))]
    wide = wide_weights(weights, labels, within)
    groups = wide.select("_group").distinct() if within else weights.sparkSession.range(1).select(F.lit(0).alias("_group"))
    every = groups.select("_group", F.explode(F.sequence(F.lit(0), F.lit(1 << bits))).alias("idx"))
    dense = every.join(wide, ["_group", "idx"], "left").na.fill(0.0, names)
    cells = dense.groupBy("_group").agg(F.array_sort(F.collect_list(F.struct("idx", *names))).alias("cells"))
    arrays = [F.col("cells")[n].alias(n) for n in names]
    return cells.select("_group", F.struct(*arrays).alias("_models"))


def score_linear(
    vectors: DataFrame,
    weights: DataFrame,
    labels: list[str],
    key: str = "id",
    carry: list[str] | None = None,
    bits: int = 15,
    within: str | None = None,
) -> DataFrame:
    """``key``, carried columns, and per label ``p_<label>``, the probability of true.

    ``vectors`` has ``vector``; ``weights`` is ``(label, idx, weight)`` with one model per label.
    With ``within`` each row meets only the weights that share its value there (cross-validation:
    its slice). An entry none of whose buckets has a weight gets 0.5.

    Products are added up inside the row: the weights come along as arrays, whose size ``bits``
    bounds, and nothing is shuffled.
    """
    keys = [key, *([within] if within else []), *(carry or [])]
    arrays = weight_arrays(weights, labels, bits, within)
    if within is None:
        rows = vectors.select(*keys, "vector", arrays.select("_models").scalar().alias("_models"))
    else:  # one row of arrays per value
        rows = vectors.select(*keys, "vector").join(F.broadcast(arrays), F.col(within) == F.col("_group"), "left")

    def total(i: int) -> Column:
        weight = F.col("_models")[f"w{i}"]
        summed = F.aggregate(
            "vector", F.lit(0.0), lambda s, x: s + x["value"] * F.get(weight, x["idx"])
        )
        return F.coalesce(summed, F.lit(0.0))

    # Handed out by a generator, so that a condition on a score is not pushed below and the vector computed again.
    scores = F.struct(*[logistic(total(i)).alias(f"p_{lab}") for i, lab in enumerate(labels)])
    return rows.select(*keys, F.inline(F.array(scores)))


def score_linear_joined(
    vectors: DataFrame,
    weights: DataFrame,
    labels: list[str],
    key: str = "id",
    carry: list[str] | None = None,
) -> DataFrame:
    """As ``score_linear``, for more buckets than an array should hold: cells are joined by bucket.

    Products are added up per entry before its cells are shuffled; keys are unique.
    """
    keys = [key, *(carry or [])]
    wide = wide_weights(weights, labels).drop("_group")
    cells = vectors.select(*keys, F.inline_outer("vector")).join(wide, "idx", "left")
    sums = [
        F.coalesce(F.sum(F.col("value") * F.col(f"w{i}")), F.lit(0.0)).alias(f"s{i}")
        for i in range(len(labels))
    ]
    return cells.groupBy(*keys).agg(*sums).select(
        *keys, *[logistic(F.col(f"s{i}")).alias(f"p_{lab}") for i, lab in enumerate(labels)]
    )


def logistic(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def long_scores(scored: DataFrame, labels: list[str], keys: list[str]) -> DataFrame:
    """``(keys, label, p)``."""
    items = F.array(
        *[F.struct(F.lit(lab).alias("label"), F.col(f"p_{lab}").alias("p")) for lab in labels]
    )
    return scored.select(*keys, F.inline(items))


def prediction_rows(
    scored: DataFrame,
    labels: list[str],
    key: str = "id",
    coded: str = "labels",
    snippet: str = "snippet",
    rev_id: Column | None = None,
) -> DataFrame:
    """One row per entry and label: predicted, coded, confidence, right or not, link, snippet.

    ``scored`` has ``p_<label>`` columns, a map ``coded`` and the snippet.
    """
    items = F.array(
        *[
            F.struct(
                F.lit(lab).alias("label"),
                F.col(f"p_{lab}").alias("p"),
                F.col(coded)[lab].alias("coded"),
            )
            for lab in labels
        ]
    )
    link = short_revision_link(F.col(key) if rev_id is None else rev_id)
    rows = scored.select(
        F.col(key).alias("id"), link.alias("diff"), F.col(snippet).alias("snippet"),
        F.inline(items),
    ).withColumn("predicted", F.col("p") > 0.5)
    right = F.col("predicted") == F.col("coded")
    return (
        rows.withColumn("confidence", F.round(F.greatest("p", 1 - F.col("p")), 3))
        .withColumn(
            "correct",
            F.when(F.col("coded").isNull(), "Unknown").when(right, "Yes").otherwise("No"),
        )
        .select(*PREDICTION_COLUMNS)
    )


def predictions_by_id(predictions: DataFrame, labels: list[str]) -> DataFrame:
    """One row per entry: its predicted value per label, then link and snippet."""
    return predictions.groupBy("id").agg(
        *[
            F.max(F.when(F.col("label") == lab, F.col("predicted"))).alias(lab)
            for lab in labels
        ],
        F.min("diff").alias("diff"),
        F.min("snippet").alias("snippet"),
    )
