"""Coded rows to entry documents, and revisions onto them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions.keys import int_if, label_bool
from palaver.functions.text import diff_content
from palaver.schemas import CONTENT


def label_map(labels: dict[str, Column]) -> Column:
    """Coded labels as a map; NULL when a row codes none."""
    coded = F.map_filter(
        F.create_map(*[x for n, c in labels.items() for x in (F.lit(n), label_bool(c))]),
        lambda _, v: v.isNotNull(),
    )
    return F.when(F.size(coded) > 0, coded)


def shape_entries(
    rows: DataFrame,
    ids: dict[str, str],
    labels: dict[str, str] | None = None,
    text: str | None = None,
) -> DataFrame:
    """Rows of a coded table to ``(entry, labels)``.

    ``ids`` and ``labels`` map the name in the document to the column in the table. Ids keep their
    text form; ``rev_id`` becomes a number, with its text beside it as ``rev_text``, for an id that
    merely begins with digits is no number and must not be lost.
    """
    id_fields = []
    for name, c in ids.items():
        if name == "rev_id":
            id_fields.append(F.col(c).try_cast("bigint").alias(name))
        id_fields.append(int_if(F.col(c)).alias("rev_text" if name == "rev_id" else name))
    empty = F.array().cast("array<string>")
    added = F.array(F.col(text)) if text else empty
    entry = F.struct(
        F.struct(*id_fields).alias("id"),
        F.lit(None).cast("string").alias("title"),
        F.lit(None).cast("string").alias("sender"),
        F.lit("").alias("comment"),
        F.lit(None).cast("timestamp").alias("timestamp"),
        F.lit(None).cast("int").alias("size"),
        F.struct(added.alias("added"), empty.alias("removed")).cast(CONTENT).alias("content"),
    )
    coded = (
        label_map({n: F.col(c) for n, c in labels.items()})
        if labels
        else F.lit(None).cast("map<string, boolean>")
    )
    return rows.select(entry.alias("entry"), coded.alias("labels"))


def entry_key() -> Column:
    """All id fields of an entry as one text."""
    return F.to_json("entry.id")


def filled() -> Column:
    """Whether an entry has its revision or its text; others were stored while that was pending."""
    content = F.coalesce(F.size("entry.content.added") + F.size("entry.content.removed"), F.lit(0))
    return F.col("entry.timestamp").isNotNull() | (content > 0)


def attach_revisions(entries: DataFrame, revisions: DataFrame) -> DataFrame:
    """Fill entries from revision rows of the same ``rev_id``.

    Entries without a revision stay as they are, and a revision without a diff leaves the
    content as it is. Revision ids are unique.
    """
    rev = revisions.select(
        F.col("rev_id").alias("_rev_id"),
        F.struct("title", "sender", "comment", "timestamp", "size", "diff").alias("_rev"),
    )
    joined = entries.join(rev, F.col("entry.id.rev_id") == F.col("_rev_id"), "left")
    found = F.col("_rev").isNotNull()
    entry = F.col("entry")
    for name in ("title", "sender", "comment", "timestamp", "size"):
        entry = entry.withField(
            name, F.when(found, F.col(f"_rev.{name}")).otherwise(F.col(f"entry.{name}"))
        )
    diff = F.col("_rev.diff")
    has_diff = found & diff.isNotNull() & (diff != "")
    entry = entry.withField(
        "content", F.when(has_diff, diff_content(diff)).otherwise(F.col("entry.content"))
    )
    others = [c for c in entries.columns if c != "entry"]
    return joined.select(entry.alias("entry"), *others)
