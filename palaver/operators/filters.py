"""Row filters."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions.keys import starts_with_digit


def field_exists(df: DataFrame, *paths: str) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [F.col(p).isNotNull() for p in paths]))


def field_in(df: DataFrame, path: str, values: Iterable) -> DataFrame:
    return df.where(F.col(path).isin(list(values)))


def filter_paths(
    df: DataFrame, defaults: dict[str, Column], given: dict[str, Column] | None = None
) -> DataFrame:
    """Conjunction over paths; a given condition takes the place of that path's default."""
    conditions = {**defaults, **(given or {})}
    return df.where(reduce(lambda a, b: a & b, conditions.values(), F.lit(True)))


def numeric_ids(df: DataFrame, *columns: str) -> DataFrame:
    return df.where(starts_with_digit(*[F.col(c) for c in columns]))


def time_range(df: DataFrame, column: str, start, end) -> DataFrame:
    """Both ends included."""
    return df.where(F.col(column).between(start, end))


def not_self(df: DataFrame, sender: str, receiver: str) -> DataFrame:
    """Interactions between two actors; an unknown receiver is kept."""
    return df.where(~F.col(receiver).eqNullSafe(F.col(sender)))


def registered(df: DataFrame, actor: str) -> DataFrame:
    """All but anonymous actors; an unknown one counts as registered, it just finds no partner."""
    return df.where(F.coalesce(F.col(actor) != 0, F.lit(True)))


def anonymous(df: DataFrame, actor: str) -> DataFrame:
    return df.where(F.col(actor) == 0)
