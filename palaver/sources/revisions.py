"""Revision XML, held as text in a table, to one row per revision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REV = (
    "struct<_revid: bigint, _user: string, _comment: string, _timestamp: string, "
    "_size: int, diff: struct<_VALUE: string, _notcached: string>>"
)
RESPONSE = (
    "query struct<pages: struct<page: array<struct<_title: string, "
    f"revisions: struct<rev: array<{REV}>>>>>>"
)


def revision_rows(
    responses: DataFrame, column: str = "xml", mode: str = "FAILFAST"
) -> DataFrame:
    """One row per ``rev`` with its page's title; ``pending`` when its diff is not cached.

    A malformed response stops the job unless ``mode`` is ``PERMISSIVE``, which drops it.
    """
    parsed = F.from_xml(F.col(column), RESPONSE, {"mode": mode})
    pages = responses.select(F.explode(parsed["query"]["pages"]["page"]).alias("page"))
    revs = pages.select(
        F.col("page._title").alias("title"), F.explode("page.revisions.rev").alias("rev")
    )
    return revs.select(
        F.col("rev._revid").alias("rev_id"),
        "title",
        F.col("rev._user").alias("sender"),
        F.col("rev._comment").alias("comment"),
        F.col("rev._timestamp").cast("timestamp").alias("timestamp"),
        F.col("rev._size").alias("size"),
        F.col("rev.diff._VALUE").alias("diff"),
        F.col("rev.diff._notcached").isNotNull().alias("pending"),
    )


def split_pending(revisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Revisions ready to be stored, and those to ask for again with the next batch."""
    return revisions.where(~F.col("pending")), revisions.where(F.col("pending"))


def xml_escape(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text
