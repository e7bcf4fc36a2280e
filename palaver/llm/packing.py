"""Best-fit packing of documents into sequences, with conflicts between documents of a sequence.

A bin carries a bitmap of duplicate clusters and one of sources per place a source may take. Bins
are ordered by residual; a document goes to the tightest bin that holds it and has neither its
cluster nor its source's last place taken, found by going on from the tightest to the next. Documents
are dealt to shards of about equal number: in runs of a given order, so that bins follow a curriculum,
or else by hash, copies, repeated rows and hot sources spread over all of them.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.llm.mixing import word_count
from palaver.session import written

CAPACITY = 4096
#: Documents of one source that a bin may hold.
PER_SOURCE = 6
SHARD_ROWS = 4096
#: Bits of a bin's number within a shard.
BIN_BITS = 24

LAYOUT = "doc_id long, source string, piece int, start_word long, n_words long, bin_id long, slot int, bin_words long"


def best_fit(
    sizes: list[int], sources: list[int], clusters: list[int], capacity: int, per_source: int
) -> list[int]:
    """The bin of each item; sizes are at most ``capacity`` and come largest first."""
    residuals: list[int] = []  # residual and bin in one number, in order
    held: list[int] = []  # per bin a bitmap of clusters
    places: list[list[int]] = []  # per bin a bitmap of sources for each place
    out = []
    mask = (1 << BIN_BITS) - 1
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        source_bit, cluster_bit = 1 << source, 1 << cluster
        at = bisect_left(residuals, size << BIN_BITS)
        while at < len(residuals):
            number = residuals[at] & mask
            if not (held[number] & cluster_bit or places[number][-1] & source_bit):
                left = (residuals.pop(at) >> BIN_BITS) - size
                break
            at += 1
        else:
            number, left = len(held), capacity - size
            held.append(0)
            places.append([0] * per_source)
        held[number] |= cluster_bit
        for k, place in enumerate(places[number]):
            if not place & source_bit:
                places[number][k] |= source_bit
                break
        if left:
            insort(residuals, left << BIN_BITS | number)
        out.append(number)
    return out


def numbered(values: list) -> list[int]:
    names: dict = {}
    return [names.setdefault(v, len(names)) for v in values]


def file_order(documents: DataFrame) -> Column | None:
    """A row's file and place in it, ascending as a sorted write lays rows down; none if not read from files."""
    try:
        known = "_metadata" not in documents.columns and documents.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        known = False
    if not known:
        return None
    name = F.element_at(F.split("_metadata.file_path", "/"), -1)
    # Numbers in names are padded with zeros up to five digits; longer ones come later.
    return F.struct(F.length(name).alias("length"), name.alias("name"), F.col("_metadata.row_index").alias("row"))


def numbered_by_file(rows: DataFrame) -> DataFrame:
    """``rows`` with ``number``, consecutive from 0 by their ``place``; counts one row per file."""
    sizes = rows.groupBy("place.length", "place.name").agg((F.max("place.row") + 1).alias("n"))
    before = Window.orderBy("length", "name").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "name", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    met = (F.col("place.length") == F.col("length")) & (F.col("place.name") == F.col("name"))
    rows = rows.join(starts, met).withColumn("number", F.col("start") + F.col("place.row"))
    return rows.drop("place", "length", "name", "start")


def pack(
    documents: DataFrame,
    capacity: int = CAPACITY,
    per_source: int = PER_SOURCE,
    shard_rows: int = SHARD_ROWS,
    cluster: str | None = None,
    in_order: bool = False,
) -> DataFrame:
    """Rows of ``LAYOUT``, one per piece of a document, covering every word of every document once.

    ``cluster`` names a column that is equal for documents not to share a bin; by default copies of a
    text are a cluster. A document over ``capacity`` words is cut: full pieces fill bins of their own
    and the rest is packed. ``slot`` orders a bin's pieces, ``bin_words`` is what it holds. A document
    without words (null text too) has one row with a null ``bin_id``. A null source is a source. Repeated
    rows are packed each by itself; of equal sizes the smaller id goes first. An empty table gives none.
    With ``in_order`` documents just read from files are taken in the order of these and of the rows in
    them: each run of about ``shard_rows`` documents is packed by itself, and ``bin_id`` ascends from run
    to run. What is not read from files has no such order and is dealt by hash.
    """
    place = file_order(documents) if in_order else None
    same = F.xxhash64(F.coalesce("text", F.lit(""))) if cluster is None else F.xxhash64(cluster)
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count().alias("size"),
        same.alias("cluster"),
        F.monotonically_increasing_id().alias("number") if place is None else place.alias("place"),
    )
    rows = written(rows, "pieces")
    shards = max(1, math.ceil(rows.count() / shard_rows))
    if place is None:
        shard = F.pmod(F.xxhash64("doc_id", "cluster", "number"), F.lit(shards))
    else:
        rows = numbered_by_file(rows)
        shard = F.floor(F.col("number") / F.lit(shard_rows))

    def lay(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("doc_id", "ascending"), ("cluster", "ascending")])
        ids, sources, sizes, clusters = (table.column(c).to_pylist() for c in ("doc_id", "source", "size", "cluster"))
        fit = [k for k, n in enumerate(sizes) if n % capacity]
        fit.sort(key=lambda k: -(sizes[k] % capacity))
        bins = best_fit(
            [sizes[k] % capacity for k in fit],
            numbered([sources[k] for k in fit]),
            numbered([clusters[k] for k in fit]),
            capacity,
            per_source,
        )
        used = max(bins, default=-1) + 1
        first = key[0].as_py() << BIN_BITS
        words, slots = [0] * used, [0] * used
        for k, b in zip(fit, bins, strict=True):
            words[b] += sizes[k] % capacity
        out = []
        for k, b in zip(fit, bins, strict=True):
            piece, left = divmod(sizes[k], capacity)
            out.append((ids[k], sources[k], piece, piece * capacity, left, first + b, slots[b], words[b]))
            slots[b] += 1
        for k, size in enumerate(sizes):
            if not size:
                out.append((ids[k], sources[k], 0, 0, 0, None, None, None))
            for piece in range(size // capacity):
                out.append((ids[k], sources[k], piece, piece * capacity, capacity, first + used, 0, capacity))
                used += 1
        columns = list(zip(*out, strict=True))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, layout, strict=True)], schema=layout)

    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    layout = pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in LAYOUT.split(", "))])
    return rows.withColumn("shard", shard).drop("number").groupBy("shard").applyInArrow(lay, LAYOUT)
