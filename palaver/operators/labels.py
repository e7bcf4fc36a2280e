"""Label columns: one-hot, long to wide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The label names used when none are given.
DEFAULT_LABELS = ["Praise/thanks", "Criticism/insult", "Other"]


def one_hot(df: DataFrame, column: str, labels: list = DEFAULT_LABELS) -> DataFrame:
    """Put one 1/0 column per label in the place of ``column``.

    A value outside ``labels`` leaves all of them empty.
    """
    c = F.col(column)
    flags = [
        F.when(c == lab, 1).when(c.isin(labels), 0).alias(str(lab)) for lab in labels
    ]
    at = df.columns.index(column)
    return df.select(*df.columns[:at], *flags, *df.columns[at + 1:])


def pivot_last(
    df: DataFrame,
    key: str,
    label: str,
    value: str,
    order: Column,
    labels: list[str] = DEFAULT_LABELS,
) -> DataFrame:
    """One row per key: the last value of each label, then the key's last row.

    ``order`` is a unique row order. A label outside ``labels`` gets no column, but its row can
    be the last one.
    """
    per_label = [
        F.max_by(
            F.when(F.col(label) == lab, F.col(value)), F.when(F.col(label) == lab, order)
        ).alias(lab)
        for lab in labels
    ]
    rest = [c for c in df.columns if c != key]
    last = F.max_by(F.struct(*rest), order).alias("_last")
    wide = df.groupBy(key).agg(*per_label, last)
    return wide.select(*[F.col(f"`{lab}`") for lab in labels], key, "_last.*")
