"""Revision responses as they arrive: store what is ready, ask again for what is pending.

Each micro-batch writes its own folder in overwrite mode, so a batch that is run again after a
failure replaces what it wrote and nothing is stored twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from palaver.operators.entries import attach_revisions
from palaver.sources.documents import last_per_key
from palaver.sources.revisions import revision_rows, split_pending


def ingest_stream(
    responses: DataFrame, entries: DataFrame, target: str, checkpoint: str, column: str = "xml"
) -> DataStreamWriter:
    """A stream writer from revision XML to ``target``; ``entries`` is the static coded table."""

    def write(batch: DataFrame, number: int) -> None:
        ready, pending = split_pending(revision_rows(batch, column))
        ready = last_per_key(ready, ["rev_id"], [F.col(c) for c in ("timestamp", "size", "diff")])
        wanted = entries.join(
            ready.select("rev_id"),
            F.col("entry.id.rev_id") == F.col("rev_id"),
            "left_semi",
        )
        attach_revisions(wanted, ready).write.mode("overwrite").parquet(
            f"{target}/entries/batch={number}"
        )
        pending.select("rev_id").distinct().write.mode("overwrite").parquet(
            f"{target}/pending/batch={number}"
        )

    return (
        responses.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )


def stored_entries(spark: SparkSession, target: str) -> DataFrame:
    """What has been stored, the latest batch counting for each revision."""
    rows = spark.read.parquet(f"{target}/entries").withColumn(
        "rev_id", F.col("entry.id.rev_id")
    )
    return last_per_key(rows, ["rev_id"], [F.col("batch")]).drop("rev_id", "batch")


def still_pending(spark: SparkSession, target: str) -> DataFrame:
    """Revisions to ask for again: seen pending and not stored since."""
    seen = spark.read.parquet(f"{target}/pending").select("rev_id").distinct()
    stored = spark.read.parquet(f"{target}/entries").select(
        F.col("entry.id.rev_id").alias("rev_id")
    )
    return seen.join(stored.distinct(), "rev_id", "left_anti")
