"""Collections of nested documents: scan, upsert, partial update."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palaver.schemas import ENTRY_DOCUMENT


def scan_entries(
    spark: SparkSession,
    path: str,
    condition: Column | None = None,
    fields: list[str] | None = None,
    source_format: str = "parquet",
    schema: str = ENTRY_DOCUMENT,
) -> DataFrame:
    """Documents under the declared schema; only the nested fields asked for are read."""
    found = spark.read.schema(schema).format(source_format).load(path)
    if condition is not None:
        found = found.where(condition)
    if fields:
        found = found.select(*[F.col(f).alias(f.replace(".", "_")) for f in fields])
    return found


def last_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the last in ``order``.

    ``row_number = 1`` is cut to one row per key on the map side (WindowGroupLimit), so a key
    with very many rows sends few of them through the shuffle.
    """
    latest_first = [o.desc() for o in order]
    seat = F.row_number().over(Window.partitionBy(*keys).orderBy(*latest_first))
    return df.withColumn("_seat", seat).where("_seat = 1").drop("_seat")


def upsert(
    stored: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column] | None = None
) -> DataFrame:
    """Incoming documents replace stored ones of the same key or are added.

    ``order`` says which incoming document of a key is the last; without it incoming keys must
    be unique.
    """
    latest = incoming if order is None else last_per_key(incoming, keys, order)
    kept = stored.join(incoming.select(*keys).distinct(), keys, "left_anti")
    return kept.select(*stored.columns).unionByName(latest.select(*stored.columns))


def set_field(docs: DataFrame, values: DataFrame, keys: list[str], path: str) -> DataFrame:
    """Set one (nested) path from ``values`` (``keys`` plus a column ``value``).

    Documents without a row in ``values`` keep what they have. Keys of ``values`` are unique.
    """
    marked = values.select(*keys, F.col("value").alias("_value"), F.lit(True).alias("_set"))
    top, _, rest = path.partition(".")
    joined = docs.join(marked, keys, "left")
    if not rest:
        old = F.col(top) if top in docs.columns else F.lit(None)
        new = F.when(F.col("_set"), F.col("_value")).otherwise(old)
    elif top in docs.columns:
        new = F.when(F.col("_set"), F.col(top).withField(rest, F.col("_value"))).otherwise(
            F.col(top)
        )
    else:
        new = F.when(F.col("_set"), F.struct(F.col("_value").alias(rest)))
    columns = docs.columns if top in docs.columns else [*docs.columns, top]
    return joined.withColumn(top, new).select(*columns)
