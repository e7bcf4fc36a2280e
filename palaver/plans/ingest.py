"""Coded rows and revision XML into the entry collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.operators.entries import attach_revisions, entry_key, filled, shape_entries
from palaver.operators.filters import numeric_ids
from palaver.operators.joins import skip_existing
from palaver.sources.documents import last_per_key, upsert
from palaver.sources.revisions import revision_rows, split_pending


def coded_entries(
    rows: DataFrame,
    ids: str | dict[str, str],
    labels: dict[str, str],
    text: str | None = None,
    stored: DataFrame | None = None,
    skip: bool = False,
) -> DataFrame:
    """Entries of a coded table, less those already stored filled when ``skip`` is set.

    ``ids`` is the column of the revision id, or a map from id fields to columns. An entry that was
    stored while its revision was pending is asked for again.
    """
    ids = {"rev_id": ids} if isinstance(ids, str) else ids
    entries = shape_entries(numeric_ids(rows, *ids.values()), ids, labels, text)
    if skip and stored is not None:
        have = stored.where(filled()).select(entry_key().alias("_key"))
        entries = skip_existing(entries.withColumn("_key", entry_key()), have, ["_key"]).drop("_key")
    return entries


def with_revisions(entries: DataFrame, responses: DataFrame, xml: str = "xml") -> DataFrame:
    """Entries filled from the revisions that are ready; pending ones stay empty.

    A revision may have been fetched twice; the later one counts. Only revisions that are asked
    for are looked at.
    """
    ready, _ = split_pending(revision_rows(responses, xml))
    wanted = entries.select(F.col("entry.id.rev_id").alias("rev_id")).distinct()
    ready = ready.join(wanted, "rev_id", "left_semi")
    order = [F.col(c) for c in ("timestamp", "size", "diff")]
    return attach_revisions(entries, last_per_key(ready, ["rev_id"], order))


def unfilled(entries: DataFrame) -> DataFrame:
    """The id fields of entries to ask for again with the next batch."""
    return entries.where(~filled()).select("entry.id.*")


def store(stored: DataFrame, entries: DataFrame) -> DataFrame:
    """The collection after writing ``entries`` into it by their ids.

    An entry that could not be filled never replaces a stored one; it is added if there is none.
    """
    old = stored.withColumn("_key", entry_key())
    new = entries.withColumn("_key", entry_key())
    empty = new.where(~filled()).join(old.select("_key"), "_key", "left_anti").select(*new.columns)
    return upsert(old, new.where(filled()).unionByName(empty), ["_key"]).drop("_key")
