"""Resolve log rows to the revision of the same user within a time window.

For each log row only two things about its candidates matter: which comes first, and whether
there is a second. Both follow from one sorted pass in which every probe time meets the first
revision at or after it, so no pair of log row and revision is ever produced.

A user may own a large part of all rows. Work is therefore cut by user *and* time chunk, and
both sides shrink to one row per user and instant before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType
from pyspark.sql.window import Window

from palaver.functions.keys import seconds, shift_seconds
from palaver.operators.filters import time_range


def candidate_facts(
    probes: DataFrame, revisions: DataFrame, window: int, chunk_seconds: int | None = None
) -> DataFrame:
    """Facts per distinct ``(actor, ts)`` of ``probes``: ``n`` (0, 1 or 2 for more) and the
    first candidate's ``rev_id``.

    ``probes``: ``(actor, ts)``; ``revisions``: ``(actor, ts, rev_id)``. A candidate lies in
    ``[ts - window, ts + window]``; among equal instants the smallest id comes first.
    """
    # A probe reaches 2 * window past its start. With chunks no shorter than that, a revision
    # is needed in its own chunk and, near its beginning, in the one before.
    width = max(chunk_seconds or 8 * window, 2 * window, 1)
    zoned = isinstance(revisions.schema["ts"].dataType, TimestampType)

    def chunk(ts: Column) -> Column:
        return F.floor(seconds(ts, zoned) / width)

    instants = revisions.groupBy("actor", "ts").agg(
        F.count("*").alias("n"), F.min("rev_id").alias("rev_id")
    )
    into_chunk = F.pmod(seconds(F.col("ts"), zoned), F.lit(width))
    own = chunk(F.col("ts"))
    placed = instants.select(
        "actor",
        F.explode(
            F.when(into_chunk <= 2 * window, F.array(own, own - 1)).otherwise(F.array(own))
        ).alias("chunk"),
        F.col("ts").alias("at"),
        F.lit(0).alias("kind"),
        F.struct("ts", "n", "rev_id").alias("rev"),
        F.lit(None).cast(revisions.schema["ts"].dataType).alias("ts"),
    )
    start = shift_seconds(F.col("ts"), -window)
    asked = probes.select("actor", "ts").distinct().select(
        "actor",
        chunk(start).alias("chunk"),
        start.alias("at"),
        F.lit(1).alias("kind"),
        F.lit(None).cast(placed.schema["rev"].dataType).alias("rev"),
        "ts",
    )
    # Latest first, revisions before probes of the same instant: the last revision seen is
    # the first one at or after the probe, the one seen before it is the runner-up.
    order = Window.partitionBy("actor", "chunk").orderBy(F.desc("at"), "kind")
    seen = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    met = (
        placed.unionByName(asked)
        .withColumn("next_ts", F.last("rev.ts", ignorenulls=True).over(earlier))
        .withColumn(
            "first",
            F.last(
                F.when(F.col("kind") == 0, F.struct("rev", "next_ts")), ignorenulls=True
            ).over(seen),
        )
        .where("kind = 1")
    )
    end = shift_seconds(F.col("ts"), window)
    hit = F.coalesce(F.col("first.rev.ts") <= end, F.lit(False))
    second = F.coalesce((F.col("first.rev.n") > 1) | (F.col("first.next_ts") <= end), F.lit(False))
    return met.select(
        "actor",
        "ts",
        F.when(~hit, 0).when(second, 2).otherwise(1).alias("n"),
        F.when(hit, F.col("first.rev.rev_id")).alias("rev_id"),
    )


def resolve(
    log: DataFrame,
    revisions: DataFrame,
    actor: str,
    ts: str,
    window: int = 10,
    unique: bool = True,
    chunk_seconds: int | None = None,
    period: tuple[Column, Column] | None = None,
) -> DataFrame:
    """``log`` with ``rev_id``: the revision by the same actor within ``window`` seconds.

    ``unique`` leaves NULL where several qualify; otherwise the first one is taken. Rows
    without a candidate, or without an actor, are kept. ``revisions`` has ``(actor, ts, rev_id)``.

    ``period`` is the closed range in which all log times lie, if it is known: candidates are no
    further from it than the window, and the scan of the revisions is filtered so.
    """
    probes = log.select(F.col(actor).alias("actor"), F.col(ts).alias("ts"))
    if period is not None:
        first, last = shift_seconds(period[0], -window), shift_seconds(period[1], window)
        revisions = time_range(revisions, "ts", first, last)
    revisions = revisions.join(probes.select("actor").distinct(), "actor", "left_semi")
    facts = candidate_facts(probes, revisions, window, chunk_seconds)
    chosen = F.when(F.col("n") == 1, F.col("rev_id")) if unique else F.col("rev_id")
    answers = facts.select(
        F.col("actor").alias("_actor"), F.col("ts").alias("_ts"), chosen.alias("rev_id")
    )
    matched = (F.col(actor) == F.col("_actor")) & (F.col(ts) == F.col("_ts"))
    return log.join(answers, matched, "left").drop("_actor", "_ts")


def resolve_registered_and_anonymous(
    log: DataFrame,
    revisions: DataFrame,
    actor_id: str,
    actor_text: str,
    ts: str,
    window: int = 10,
    period: tuple[Column, Column] | None = None,
) -> DataFrame:
    """Registered actors (id ≠ 0) by id, anonymous ones by text; first candidate each.

    ``revisions``: ``(user_id, user_text, ts, rev_id)``. They are read once and take part under
    their user's id, unless that is 0, and under the text. A log row without an actor is kept.
    """

    def by_id(column: str) -> Column:
        return F.when(F.col(column) != 0, F.concat(F.lit("id "), F.col(column).cast("string")))

    def by_text(column: str) -> Column:
        return F.concat(F.lit("text "), F.col(column))

    names = F.array_compact(F.array(by_id("user_id"), by_text("user_text")))
    named = revisions.select(F.explode(names).alias("actor"), "ts", "rev_id")
    own = F.when(F.col(actor_id) == 0, by_text(actor_text)).otherwise(by_id(actor_id))
    found = resolve(log.withColumn("_who", own), named, "_who", ts, window, unique=False, period=period)
    return found.drop("_who")


def flatten_log(resolved: DataFrame, log_columns: list[str]) -> DataFrame:
    """Resolved columns followed by the raw log columns, as the extracts are written."""
    lead = [c for c in resolved.columns if c not in log_columns]
    return resolved.select(*lead, *log_columns)
