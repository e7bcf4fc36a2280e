"""Newest rows, top rows per key, score buckets and margin ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType
from pyspark.sql.window import Window

from palaver.functions.keys import at_second, seconds
from palaver.session import materialize


def newest(df: DataFrame, ts: str, key: str, n: int) -> DataFrame:
    """The ``n`` latest rows; ``key`` settles equal times. One task merges what the parts offer, up
    to ``n`` rows of each: for an ``n`` of a report, not of an extract (``newest_counted``)."""
    return df.orderBy(F.desc(ts), key).limit(n)


def newest_counted(df: DataFrame, ts: str, key: str, n: int) -> DataFrame:
    """As ``newest`` for a large ``n``, after two jobs that count.

    Counts per hour, then per second of one hour, show a time after which there are at least ``n``
    rows but not many more; only those are sorted.
    """
    zoned = isinstance(df.schema[ts].dataType, TimestampType)
    clock = seconds(F.col(ts), zoned)
    hour = F.floor(clock / 3600)
    last, later = _reached(df, hour, n)
    if last is not None:
        since, _ = _reached(df.where(hour == last), clock, n - later)
        df = df.where(F.col(ts) >= at_second(since, zoned))
    return newest(df, ts, key, n)


def _reached(df: DataFrame, unit: Column, n: int) -> tuple[int | None, int]:
    """The latest ``unit`` from which on there are ``n`` rows, and the number of rows after it;
    None if there are fewer."""
    counts = df.groupBy(unit.alias("at")).count().where("at is not null").collect()
    later = 0
    for r in sorted(counts, key=lambda r: r["at"], reverse=True):
        if later + r["count"] >= n:
            return r["at"], later
        later += r["count"]
    return None, later


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key; cut to ``k`` before the shuffle already."""
    seat = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", seat).where(F.col("rank") <= k)


def rank_within(df: DataFrame, groups: list[str], order: list[Column | str]) -> DataFrame:
    """``df`` with ``rank``, the row's 1-based position in its group by ``order`` (unique).

    Groups may be few and huge, so none is given to one task: rows are range-partitioned by
    group and order, numbered inside each partition, and moved up by the rows their group has
    in earlier partitions. Rows are written out first, as the sample that placing rests on would
    compute them once more; so is the placement, which must not differ between counting and numbering.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(
        materialize(df).repartitionByRange(parts, *groups, *order).withColumn(
            "_part", F.spark_partition_id()
        )
    )
    earlier = (
        Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        placed.groupBy(*groups, "_part")
        .count()
        .withColumn("_before", F.coalesce(F.sum("count").over(earlier), F.lit(0)))
        .drop("count")
    )
    seat = F.row_number().over(Window.partitionBy(*groups, "_part").orderBy(*order))
    return (
        placed.withColumn("_seat", seat)
        .join(offsets, [*groups, "_part"])
        .withColumn("rank", F.col("_seat") + F.col("_before"))
        .drop("_part", "_seat", "_before")
    )


def _scores(labels: list[str]) -> Column:
    return F.array(*[F.col(f"p_{lab}") for lab in labels])


def margin(score: Column, scores: Column) -> Column:
    """Sort key of a label's list: clear winners first by their lead over the runner-up, then
    the others by how far they are behind the best. With one label, by score."""
    ordered = F.array_sort(scores)
    best = F.element_at(ordered, -1)
    lead = score - F.element_at(ordered, -2)
    key = F.when(lead > 0, -lead).otherwise(best - score)
    return F.when(F.size(scores) < 2, -score).otherwise(key)


def label_lists(scored: DataFrame, labels: list[str], threshold: float, key: str) -> DataFrame:
    """``label_items`` ranked by margin within each label, as ``rank``."""
    return rank_within(label_items(scored, labels, threshold), ["label"], ["margin", key])


def label_items(scored: DataFrame, labels: list[str], threshold: float) -> DataFrame:
    """Per label the rows scoring at least ``threshold``.

    ``scored`` has a column ``p_<label>`` per label; the result adds ``label``, ``score`` and
    ``margin``.
    """
    items = F.array(
        *[
            F.struct(
                F.lit(lab).alias("label"),
                F.col(f"p_{lab}").alias("score"),
                (margin(F.col(f"p_{lab}"), _scores(labels)) if len(labels) > 1
                 else -F.col(f"p_{lab}")).alias("margin"),
            )
            for lab in labels
        ]
    )
    return scored.select("*", F.inline(F.filter(items, lambda x: x["score"] >= threshold)))


def uncertain(scored: DataFrame, labels: list[str], threshold: float) -> DataFrame:
    """Rows in no label's list."""
    return scored.where(F.array_max(_scores(labels)) < threshold)


def bucket_counts(scored: DataFrame, labels: list[str], threshold: float) -> DataFrame:
    """Per label how many rows score above ``threshold``, and how many rows are in no list.

    Counts use ``>``, lists use ``>=``.
    """
    row = scored.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.array_max(_scores(labels)) < threshold).alias("u"),
        *[F.count_if(F.col(f"p_{lab}") > threshold).alias(f"n{i}")
          for i, lab in enumerate(labels)],
    )
    items = [
        F.struct(F.lit(lab).alias("label"), F.col(f"n{i}").alias("above"))
        for i, lab in enumerate(labels)
    ] + [F.struct(F.lit("uncertain").alias("label"), F.col("u").alias("above"))]
    return row.select(F.inline(F.array(*items)), "total")
