"""Equi-joins of tables. Join keys may be very unevenly spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions.keys import int_if


def skip_existing(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not stored yet."""
    return rows.join(stored.select(*keys).distinct(), keys, "left_anti")


def outer_join(
    left: DataFrame,
    right: DataFrame,
    left_on: str,
    right_on: str,
    int_keys: bool = False,
    emit_matched_left: bool = False,
) -> DataFrame:
    """Full outer join; left keys are unique, right keys need not be.

    Written as (right ⟕ left) ∪ (left without a partner): AQE can split a hot key of a left
    join's row side but not of a full outer join, and the second part meets the right side's
    distinct keys only. ``emit_matched_left`` gives each left row once more without a partner
    even if it has one.
    """
    clash = set(left.columns) & set(right.columns)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")

    def key(c: str) -> Column:
        return int_if(F.col(c).cast("string")) if int_keys else F.col(c)

    l = left.withColumn("_lk", key(left_on))
    r = right.withColumn("_rk", key(right_on))
    columns = [*left.columns, *right.columns]
    paired = r.join(l, F.col("_lk") == F.col("_rk"), "left").select(*columns)
    alone = left
    if not emit_matched_left:
        partners = r.select("_rk").distinct()
        alone = l.join(partners, F.col("_lk") == F.col("_rk"), "left_anti").select(*left.columns)
    padding = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema.fields]
    return paired.unionByName(alone.select(*left.columns, *padding))


def name_parties(
    log: DataFrame, users: DataFrame, sender: str, receiver: str, user_id: str, user_name: str,
) -> DataFrame:
    """Sender and receiver names from one user table."""
    s = users.select(F.col(user_id).alias("_sid"), F.col(user_name).alias("sender_name"))
    r = users.select(F.col(user_id).alias("_rid"), F.col(user_name).alias("receiver_name"))
    return (
        log.join(s, F.col(sender) == F.col("_sid"), "left")
        .join(r, F.col(receiver) == F.col("_rid"), "left")
        .drop("_sid", "_rid")
    )


def identify_by_name(
    log: DataFrame, users: DataFrame, title: str, user_id: str, user_name: str
) -> DataFrame:
    """The id of the user whose name is the log row's title."""
    u = users.select(F.col(user_id).alias("title_user_id"), F.col(user_name).alias("_name"))
    return log.join(u, F.col(title) == F.col("_name"), "left").drop("_name")
