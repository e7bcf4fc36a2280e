"""What the operators of this subpackage share: tables, streams of Arrow batches, sums of arrays."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as it takes not to be a column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name = "_" + name
        out.append(name)
    return out


def utf8(column: str = "text") -> Column:
    """The bytes of a text; a null text is empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def runs(batches: Iterable[pa.RecordBatch], keys: int, rows: int) -> Iterator[list[np.ndarray]]:
    """Cut a stream of non-null numeric columns, sorted by its first ``keys``, into pieces.

    A piece has about ``rows`` rows and ends where the key changes. Only a key with more rows than
    that is cut within: each of its pieces then holds that key alone.
    """
    held: list[np.ndarray] | None = None
    for batch in batches:
        new = [column.to_numpy(zero_copy_only=False) for column in batch.columns]
        if not len(new[0]):
            continue
        held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
        while len(held[0]) > rows:
            changes = np.zeros(len(held[0]), bool)
            for column in held[:keys]:
                changes[1:] |= column[1:] != column[:-1]
            at = np.flatnonzero(changes)
            inside = at[at <= rows]
            cut = int(inside[-1]) if len(inside) else rows
            yield [column[:cut] for column in held]
            held = [column[cut:] for column in held]
    if held is not None and len(held[0]):
        yield held


def summed_arrays(parts: DataFrame, fan_in: int = 32) -> DataFrame:
    """Add up float64 arrays stored as bytes, ``(key, part, total)``, per key in a two-level tree.

    ``part`` numbers the arrays of a key; no task holds more than one running sum per key.
    """

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        for batch in batches:
            for value in batch.column("total").to_pylist():
                array = np.frombuffer(value, np.float64)
                total = array.copy() if total is None else total + array
        if total is not None:
            part = batch.column("part")[0].as_py()
            yield pa.RecordBatch.from_pydict(
                {
                    "key": pa.array([key[0].as_py()], pa.int64()),
                    "part": pa.array([part], pa.int64()),
                    "total": pa.array([total.tobytes()], pa.binary()),
                }
            )

    schema = "key long, part long, total binary"
    some = parts.withColumn("part", F.pmod("part", F.lit(fan_in)))
    some = some.groupBy("key", "part").applyInArrow(add, schema)
    return some.groupBy("key").applyInArrow(add, schema).select("key", "total")
