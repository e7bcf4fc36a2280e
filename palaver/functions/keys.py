"""Keys and dates as the coded tables and logs write them."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WIKIDATE = "yyyyMMddHHmmss"  # fixed value: the 14-digit log date


def int_if(text: Column) -> Column:
    """A key's equality form: ``7``, ``007`` and `` 7 `` are one key, other text is itself."""
    return F.coalesce(text.try_cast("bigint").cast("string"), text)


def int_if_order(text: Column) -> Column:
    """A key's sort form: numbers by value, before all other text."""
    number = text.try_cast("bigint")
    return F.struct(
        number.isNull().alias("is_text"), number.alias("number"), text.alias("text")
    )


def starts_with_digit(*columns: Column) -> Column:
    """Every column begins with a digit; what follows is not looked at."""
    return reduce(lambda a, b: a & b, [c.rlike("^[0-9]") for c in columns])


def parse_wikidate(text: Column) -> Column:
    return F.to_timestamp_ntz(text.cast("string"), F.lit(WIKIDATE))


def format_wikidate(ts: Column) -> Column:
    return F.date_format(ts, WIKIDATE)


def shift_seconds(ts: Column, seconds: int) -> Column:
    return ts + F.expr(f"INTERVAL '{seconds}' SECOND")


def whole_seconds(ts: Column) -> Column:
    """Seconds since 1970 by the clock face, so no time zone enters."""
    return (
        F.date_diff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint") * 86400
        + F.hour(ts) * 3600
        + F.minute(ts) * 60
        + F.second(ts)
    )


def seconds(ts: Column, zoned: bool) -> Column:
    """Seconds that grow with ``ts``, for timestamps with (``zoned``) and without a zone."""
    return F.unix_seconds(ts) if zoned else whole_seconds(ts)


def at_second(second: int, zoned: bool) -> Column:
    """The timestamp at which ``seconds`` is ``second``, as a literal scans can filter by."""
    if zoned:
        return F.timestamp_seconds(F.lit(second))
    return F.lit(str(datetime(1970, 1, 1) + timedelta(seconds=second))).cast("timestamp_ntz")


def label_bool(cell: Column) -> Column:
    """``'1'``/``'0'`` as a boolean, any other cell as not coded (NULL)."""
    return F.when(cell.isin("0", "1"), cell == "1")
