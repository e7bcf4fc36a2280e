"""Evaluate a costly expression once and use it many times inside one Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to ``value``, which is computed a single time.

    Without this a lambda that names ``value`` would compute it again for each array element.
    """
    return F.transform(F.array(value), body)[0]
