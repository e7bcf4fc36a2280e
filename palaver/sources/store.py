"""A stored collection of documents that is updated in part.

Documents lie in buckets of their key's hash. An update reads and rewrites the buckets it touches, as a
new generation; a manifest says which generation of each bucket is the present one. The manifest is one
file that appears as a whole, so a reader sees the collection before or after an update, and an update
that fails leaves nothing but unused files. One writer at a time.

    collection/manifests/version=V/   one row per bucket: its generation
    collection/data/generation=G/bucket=B/
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from palaver.session import written
from palaver.sources.documents import last_per_key, set_field, upsert

MANIFEST = "bucket int, generation int, buckets int, keys array<string>, schema string"


def bucket_of(keys: list[str], buckets: int) -> Column:
    """The bucket of a key, by MD5, as any engine computes it; NULL parts count like empty text."""
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Version:
    """One version of a collection. ``generations`` has an entry per bucket that holds documents, at most
    ``buckets`` of them."""

    path: str
    number: int
    buckets: int
    keys: list[str]
    schema: StructType
    generations: dict[int, int]

    def read(self, spark: SparkSession, only: list[int] | None = None) -> DataFrame:
        """The documents of all buckets, or those of some."""
        wanted = self.generations if only is None else [b for b in only if b in self.generations]
        paths = [f"{self.path}/data/generation={self.generations[b]}/bucket={b}" for b in sorted(wanted)]
        if not paths:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*paths)


def create(df: DataFrame, path: str, keys: list[str], buckets: int) -> Version:
    """Store ``df``, whose keys are unique, at a new place. Give so many buckets that one is a fair task, and
    more than an update usually has keys if it is to leave buckets alone."""
    if "bucket" in df.columns:
        raise ValueError("a column named bucket is reserved")
    first = Version(path.rstrip("/"), -1, buckets, keys, df.schema, {})
    return _advance(df.sparkSession, first, df)


def latest(spark: SparkSession, path: str) -> Version:
    """The newest complete version."""
    path = path.rstrip("/")
    manifests = spark.read.schema(f"{MANIFEST}, version int").parquet(f"{path}/manifests")
    newest = manifests.agg(F.max("version")).first()[0]
    if newest is None:
        raise FileNotFoundError(f"no manifest below {path}")
    return version(spark, path, newest)


def version(spark: SparkSession, path: str, number: int) -> Version:
    """A version by its number; all stay readable."""
    path = path.rstrip("/")
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifests/version={number}").collect()
    generations = {r["bucket"]: r["generation"] for r in rows if r["bucket"] is not None}
    head = rows[0]
    schema = StructType.fromJson(json.loads(head["schema"]))
    return Version(path, number, head["buckets"], list(head["keys"]), schema, generations)


def upsert_stored(spark: SparkSession, path: str, incoming: DataFrame, order: list[Column] | None = None) -> Version:
    """Incoming documents replace stored ones of the same key or are added; see ``documents.upsert``.

    A key with a NULL part equals no other, so its document is added each time. Without an incoming document the present version stays.
    """
    now = latest(spark, path)
    final = incoming if order is None else last_per_key(incoming, now.keys, order)
    # Written, since it is read for its buckets and for its rows.
    final = written(final.select(*now.schema.names), "incoming")
    touched = _touched(final, now)
    return _advance(spark, now, upsert(now.read(spark, touched), final, now.keys)) if touched else now


def set_stored_field(spark: SparkSession, path: str, values: DataFrame, field: str) -> Version:
    """Set one (nested) path of the documents named by ``values``; see ``documents.set_field``. Keys that
    are not stored are passed over, though their buckets are rewritten. A path that is new to the documents rewrites every bucket once."""
    now = latest(spark, path)
    values = written(values.select(*now.keys, "value"), "values")
    touched = [b for b in _touched(values, now) if b in now.generations]
    if not touched:
        return now
    changed = set_field(now.read(spark, touched), values, now.keys, field)
    if changed.schema.simpleString() != now.schema.simpleString():
        changed = set_field(now.read(spark), values, now.keys, field)
    return _advance(spark, now, changed)


def _touched(rows: DataFrame, now: Version) -> list[int]:
    """Buckets in which keys lie; at most as many as there are buckets."""
    found = rows.select(bucket_of(now.keys, now.buckets).alias("bucket")).distinct().collect()
    return sorted(r["bucket"] for r in found)


def _advance(spark: SparkSession, now: Version, docs: DataFrame) -> Version:
    """Write ``docs``, the whole new content of every bucket they lie in, and the manifest that shows them."""
    number = now.number + 1
    data = f"{now.path}/data/generation={number}"
    placed = docs.withColumn("bucket", bucket_of(now.keys, now.buckets))
    # Whole buckets a task, no fewer tasks than cores; an attempt that failed before may have left files.
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed.repartition(min(tasks, now.buckets), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(data)
    stored = spark.read.schema("bucket int").parquet(data)
    new = {r["bucket"]: number for r in stored.select("bucket").distinct().collect()}
    after = Version(now.path, number, now.buckets, now.keys, docs.schema, {**now.generations, **new})
    entries = [(None, number), *after.generations.items()]
    rows = [(b, g, after.buckets, after.keys, after.schema.json()) for b, g in entries]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{now.path}/manifests/version={number}")
    return after
