"""The trailing window of a scheduled report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.functions.keys import shift_seconds
from palaver.operators.ranking import newest


def trailing_window(
    log: DataFrame, ts: str, key: str, now: str, hours: int = 24, limit: int = 300
) -> DataFrame:
    """The newest ``limit`` rows of the ``hours`` before ``now``."""
    since = shift_seconds(F.lit(now).cast(log.schema[ts].dataType), -hours * 3600)
    return newest(log.where(F.col(ts) >= since), ts, key, limit)
