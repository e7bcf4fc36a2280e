"""The live report: newest interactions, resolved, scored and listed per label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palaver.functions.text import compose_message, contributions_link, revision_link, user_link
from palaver.functions.keys import format_wikidate
from palaver.operators.features import add_vectors
from palaver.operators.filters import not_self, registered, time_range
from palaver.operators.joins import name_parties
from palaver.operators.ranking import label_items, newest, uncertain
from palaver.operators.resolve import resolve
from palaver.operators.scoring import score_linear
from palaver.session import written


def newest_interactions(log: DataFrame, start, end, limit: int) -> DataFrame:
    """The newest interactions of a period between two registered actors.

    The log is read once: these rows are written out and all later steps start from them. As
    Spark then knows how few they are, it sends their ids to the scans of the other tables.
    """
    recent = newest(time_range(log, "ts", start, end), "ts", "id", limit)
    return written(not_self(registered(recent, "sender_id"), "sender_id", "receiver_id"))


def with_messages(recent: DataFrame, messages: DataFrame) -> DataFrame:
    """``message`` by ``message_id``, empty where there is none; other messages are not moved."""
    wanted = messages.join(recent.select("message_id").distinct(), "message_id", "left_semi")
    found = recent.join(wanted.select("message_id", "message"), "message_id", "left")
    return found.withColumn("message", F.coalesce("message", F.lit(""))).drop("message_id")


def identified(
    recent: DataFrame, users: DataFrame, revisions: DataFrame, window: int, start, end
) -> DataFrame:
    """Few log rows with both names, the revision and the composed message."""
    ids = recent.select(F.explode(F.array("sender_id", "receiver_id")).alias("user_id")).distinct()
    known = users.join(ids, "user_id", "left_semi")
    named = name_parties(recent, known, "sender_id", "receiver_id", "user_id", "user_name")
    period = (F.lit(start), F.lit(end))
    found = resolve(named, revisions, "sender_id", "ts", window, period=period)
    return found.select(
        "id", "rev_id", "sender_id", "sender_name", "receiver_id", "receiver_name", "ts",
        compose_message(F.col("subject"), F.col("message")).alias("message"),
    )


def report(
    log: DataFrame, users: DataFrame, revisions: DataFrame, weights: DataFrame,
    labels: list[str], extractors: list, start, end,
    limit: int = 100, window: int = 10, threshold: float = 0.5, bits: int = 15,
    messages: DataFrame | None = None,
) -> DataFrame:
    """Ranked rows per label bucket, and the uncertain ones newest first.

    ``log``: ``(id, ts, sender_id, receiver_id, subject, message)``, or with ``message_id`` for
    ``message`` where texts are in ``messages (message_id, message)``; ``users``: ``(user_id,
    user_name)``; ``revisions``: ``(actor, ts, rev_id)``. The log is cut to ``limit`` rows at
    the start, so all that follows is small, whatever the size of the log; only the scans of
    messages, users and revisions are not, and they keep what these rows can need.
    """
    labels = sorted(labels)
    recent = newest_interactions(log, start, end, limit)
    if messages is not None:
        recent = written(with_messages(recent, messages), "messages")
    texts = recent.select(
        "id",
        F.array("message").alias("added"),
        F.array().cast("array<string>").alias("removed"),
        F.lit("").alias("comment"),
    )
    scores = score_linear(
        add_vectors(texts, extractors, "id", bits), weights, labels, "id", bits=bits
    ).select("id", *[F.round(f"p_{lab}", 6).alias(f"p_{lab}") for lab in labels])
    # Read by each label's list and by the uncertain rows.
    scored = written(identified(recent, users, revisions, window, start, end).join(scores, "id"))

    def ranked(rows: DataFrame, *order: Column | str) -> DataFrame:
        """Positions per label; there are at most ``limit`` rows in one."""
        seat = F.row_number().over(Window.partitionBy("label").orderBy(*order))
        return rows.withColumn("rank", seat.cast("bigint"))

    listed = ranked(label_items(scored, labels, threshold), "margin", "id")
    rest = uncertain(scored, labels, threshold).select(
        "*",
        F.lit("uncertain").alias("label"),
        F.lit(None).cast("double").alias("score"),
        F.lit(None).cast("double").alias("margin"),
    )
    loose = ranked(rest, F.desc("ts"), "id")
    return listed.unionByName(loose).select(
        "label", "rank", "id", "rev_id", "sender_name", "receiver_name", "ts", "message",
        *[f"p_{lab}" for lab in labels],
        revision_link(F.col("rev_id")).alias("revision_link"),
        user_link(F.col("receiver_name")).alias("receiver_link"),
        contributions_link(F.col("sender_name"), format_wikidate(F.col("ts"))).alias(
            "sender_link"
        ),
    )
