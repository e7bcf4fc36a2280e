"""Log extracts: rows of one filter and action, each with its parties and its revision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.operators.filters import time_range
from palaver.operators.joins import identify_by_name
from palaver.operators.resolve import resolve_registered_and_anonymous

RESOLVED = [
    "rev_id", "sender_id", "sender_name", "receiver_id", "receiver_name", "timestamp", "message",
    "others",
]


def filter_log_extract(
    log: DataFrame, users: DataFrame, revisions: DataFrame, number: int, action: str, start, end,
    window: int = 10,
) -> DataFrame:
    """The ``RESOLVED`` columns for the log rows of filter ``number`` and ``action`` in a period.

    ``log``: ``(id, ts, filter, action, actor_id, actor_text, title)``, ``title`` naming the user
    whose page was written to; ``users``: ``(user_id, user_name)``; ``revisions``: ``(user_id,
    user_text, ts, rev_id)``. ``others`` is the log row; such a log has no messages.
    """
    wanted = log.where((F.col("filter") == number) & (F.col("action") == action))
    wanted = identify_by_name(time_range(wanted, "ts", start, end), users, "title", "user_id", "user_name")
    found = resolve_registered_and_anonymous(
        wanted, revisions, "actor_id", "actor_text", "ts", window, (F.lit(start), F.lit(end))
    )
    return found.select(
        "rev_id",
        F.col("actor_id").alias("sender_id"),
        F.col("actor_text").alias("sender_name"),
        F.col("title_user_id").alias("receiver_id"),
        F.col("title").alias("receiver_name"),
        F.col("ts").alias("timestamp"),
        F.lit(None).cast("string").alias("message"),
        F.struct(*log.columns).alias("others"),
    )


def flattened(extract: DataFrame) -> DataFrame:
    """For a sink of plain columns: the resolved ones, then those of the log row."""
    return extract.select(*RESOLVED[:-1], "others.*")
