"""Features onto stored entries, and predictions from stored entries by a stored model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.operators.entries import entry_key
from palaver.operators.features import add_vectors, with_feature_map
from palaver.operators.filters import filter_paths
from palaver.operators.scoring import score_linear
from palaver.sources.registry import load_models


def with_features(docs: DataFrame, extractors: list, bits: int = 15) -> DataFrame:
    """Entry documents with ``features`` and ``vector`` of their text, in place of older ones."""
    rows = docs.drop("features", "vector").select(
        entry_key().alias("_key"), "*", "entry.content.added", "entry.content.removed", "entry.comment"
    )
    vectors = add_vectors(rows, extractors, "_key", bits)
    return with_feature_map(vectors, extractors, "_key").drop("_key", "added", "removed", "comment")


def stored_scores(
    docs: DataFrame, models: DataFrame, labels: list[str], tags: dict[str, str],
    find: dict[str, Column] | None = None, bits: int = 15,
) -> DataFrame:
    """``id`` and ``p_<label>`` of the entries with a vector that ``find`` selects.

    ``find`` maps paths to conditions; one on ``vector`` replaces the default. Of the ``models`` with
    ``tags`` the latest per label scores.
    """
    found = filter_paths(docs, {"vector": F.col("vector").isNotNull()}, find or {})
    rows = found.select(F.col("entry.id.rev_id").alias("id"), "vector")
    return score_linear(rows, load_models(models, tags), labels, bits=bits)
