"""URL filter: every capture against the list entries active when it was fetched.

Native DataFrame operations only. Dated additions and removals of a pattern in a list become validity
intervals; a capture asks for its host, the domains above it and its path prefixes, and an entry
answers if the fetch falls into its interval.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.session import written

#: Path prefixes of up to so many segments are patterns, unless others are asked for.
SEGMENTS = 2
#: Path prefixes of as many segments as any entry has are patterns.
ALL_DEPTHS = None


def validity(entries: DataFrame) -> DataFrame:
    """Rows ``(list, pattern, since, until)`` from ``entries (list, pattern, dated, action)``.

    An entry holds until the next one for its list and pattern, the last for ever (``until`` null);
    only additions open an interval. Of entries at one instant a removal comes last and so wins.
    Rows with a null list, pattern or date, or another action than add and remove, are left out.
    """
    known = entries.where(F.col("action").isin("add", "remove")).na.drop(subset=["list", "pattern", "dated"])
    known = known.select("list", "pattern", "dated", "action").distinct()
    order = Window.partitionBy("list", "pattern").orderBy("dated", "action")
    known = known.withColumn("until", F.lead("dated").over(order))
    lasting = F.col("until").isNull() | (F.col("until") > F.col("dated"))
    return known.where((F.col("action") == "add") & lasting).select("list", "pattern", F.col("dated").alias("since"), "until")


def host(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)


def patterns(url: Column, depths: Sequence[int] = range(1, SEGMENTS + 1)) -> Column:
    """What a URL asks for: host and domains above it of two labels or more, path prefixes of ``depths`` segments."""
    labels = F.split(host(url), r"\.")
    ups = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    downs = F.transform(
        F.filter(F.array(*map(F.lit, depths)).cast("array<int>"), lambda i: i <= F.size(segments)),
        lambda i: F.concat(host(url), F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i), "/")),
    )
    return F.when(host(url) != "", F.array_distinct(F.concat(ups, downs)))


def depths_of(intervals: DataFrame) -> list[int]:
    """The numbers of path segments that patterns have; what is gathered has one row per number."""
    depth = F.size(F.split("pattern", "/")) - 1
    return sorted(r.depth for r in intervals.select(depth.alias("depth")).where("depth > 0").distinct().collect())


def evaluate(captures: DataFrame, entries: DataFrame, segments: int | None = ALL_DEPTHS) -> DataFrame:
    """Rows ``(page_id, url, fetched_at, n_active, lists, blocked)``, one per row of ``captures``.

    ``n_active`` counts active entries that match, ``lists`` names theirs, sorted and comma-joined. A
    null or hostless URL, or a null time, matches nothing. Entries of any depth are met, unless
    ``segments`` asks for path prefixes of at most so many segments. Equal captures are evaluated once and
    counted; on the side of the entries a pattern has as many rows as intervals, so a host with a
    third of all captures can be split between tasks.
    """
    keys = ["page_id", "url", "fetched_at"]
    distinct = captures.groupBy(*keys).agg(F.count("*").alias("copies"))
    intervals = written(validity(entries), "intervals")
    depths = depths_of(intervals) if segments is ALL_DEPTHS else range(1, segments + 1)
    asked = distinct.withColumn("pattern", F.explode_outer(patterns(F.col("url"), depths)))
    active = intervals.withColumnRenamed("pattern", "matched")
    within = (F.col("fetched_at") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched_at") < F.col("until")))
    met = asked.join(active, (F.col("pattern") == F.col("matched")) & within, "left")
    found = met.groupBy(*keys, "copies").agg(
        F.count("matched").alias("n_active"),
        F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"),
    )
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return found.select(*keys, "n_active", "lists", (F.col("n_active") > 0).alias("blocked"))
