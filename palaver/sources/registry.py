"""Model weights by label and free tags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.schemas import MODEL_WEIGHTS

COLUMNS = ["label", "tags", "idx", "weight", "trained_at"]


def has_tags(tags: dict[str, str]) -> Column:
    """Every given tag has the given value; further tags do not matter."""
    return reduce(
        lambda a, b: a & b,
        [F.coalesce(F.col("tags")[k] == str(v), F.lit(False)) for k, v in tags.items()],
        F.lit(True),
    )


def only_tags(tags: dict[str, str]) -> Column:
    """The given tags and no others."""
    return has_tags(tags) & (F.coalesce(F.size("tags"), F.lit(0)) == len(tags))


def save_models(
    stored: DataFrame, trained: DataFrame, labels: list[str], tags: dict[str, str]
) -> DataFrame:
    """Registry after replacing the models of ``labels`` that have exactly ``tags``.

    ``trained`` has ``(label, idx, weight, trained_at)``.
    """
    tag_map = (
        F.create_map(*[F.lit(str(x)) for kv in tags.items() for x in kv])
        if tags
        else F.create_map().cast("map<string, string>")
    )
    kept = stored.where(~(F.col("label").isin(labels) & only_tags(tags)))
    added = trained.withColumn("tags", tag_map).select(*COLUMNS)
    return kept.select(*COLUMNS).unionByName(added)


def load_models(stored: DataFrame, tags: dict[str, str] | None = None) -> DataFrame:
    """One model per label among those that have ``tags``: the one trained last.

    Of models trained at one time the one whose tags come last as text is taken.
    """
    found = stored.where(has_tags(tags or {}))
    named = F.array_join(
        F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat_ws("=", e["key"], e["value"])), ","
    )
    found = found.withColumn("_model", F.struct("trained_at", F.coalesce(named, F.lit("")).alias("tags")))
    last = found.groupBy("label").agg(F.max("_model").alias("_model"))
    return found.join(last, ["label", "_model"], "left_semi").select(*stored.columns)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MODEL_WEIGHTS).parquet(path)


def write_registry(weights: DataFrame, path: str, mode: str = "error") -> None:
    """Partitioned by label, so loading some labels reads only theirs."""
    weights.write.mode(mode).partitionBy("label").parquet(path)
