"""Document fingerprints: a SimHash of weighted term hashes, and tables to find what is near one.

Words and pairs of words are the terms; a pair weighs twice a word, and each weighs more, by the
logarithm, the oftener it occurs. Every bit of a term's 128-bit hash votes with the term's weight.
For a search within a Hamming radius the fingerprint's bits are permuted once per table so that
another block leads: with one block more than the radius, any two within it agree on a leading block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.llm.common import runs, shuffle_partitions
from palaver.session import written

BITS = 128
RADIUS = 3
#: Fingerprints of a leading block that are compared in one task; more are dealt in pairs of parts.
BLOCK_ROWS = 4096
PIECE_ROWS = 65_536
# Odd multipliers, fixed: they spread the bits of hashes.
SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _mixed(x: np.ndarray, multiplier: np.uint64) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * multiplier
    return x ^ (x >> np.uint64(29))


def fingerprint(text: bytes) -> bytes:
    """16 bytes for UTF-8 text, all zero if it has no words; letters count alike in either case."""
    words = text.lower().split()
    if not words:
        return bytes(BITS // 8)
    digest = xxhash.xxh3_64_intdigest
    single = np.array([digest(w) for w in words], np.uint64)
    votes = np.zeros(BITS, np.int64)
    total = 0
    pairs = _mixed(single[:-1], SPREAD[0]) + single[1:] * SPREAD[1]
    for terms, weight in ((single, 1), (pairs, 2)):
        kinds, often = np.unique(terms, return_counts=True)
        more = np.frexp(often.astype(np.float64))[1]  # 1 for once, 2 for twice, 3 from four times on
        for level in np.unique(more).tolist():
            own = kinds[more == level]
            hashes = np.stack([_mixed(own, SPREAD[1]), _mixed(own + SPREAD[0], SPREAD[2])], axis=1)
            for at in range(0, len(own), PIECE_ROWS):
                bits = np.unpackbits(hashes[at : at + PIECE_ROWS].view(np.uint8), axis=1)
                votes += weight * level * bits.sum(0, dtype=np.uint32).astype(np.int64)
            total += weight * level * len(own)
    return np.packbits(2 * votes > total).tobytes()


def likeness(one: Column, two: Column) -> Column:
    """The cosine that the share of differing bits stands for, none below 0; of hex fingerprints."""
    half = BITS // 8

    def word(x: Column, at: int) -> Column:
        return F.conv(F.substring(x, at, half), 16, -10).cast("long")

    differ = sum(F.bit_count(word(one, at).bitwiseXOR(word(two, at))) for at in (1, 1 + half))
    return F.greatest(F.lit(0.0), F.cos(differ * (np.pi / BITS)))


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of ``following``'s beginning as there is."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string"


def _row(doc_id: int | None, text: str, own: bytes, following: str, following_print: bytes) -> tuple:
    new = edited(text, following).encode()
    return (doc_id, len(text), hashlib.sha256(new).hexdigest(), own.hex(), fingerprint(new).hex(), following_print.hex())


def edit_prints(documents: DataFrame) -> DataFrame:
    """Rows of ``ROW`` plus ``near_edited`` and ``near_next``, one per document.

    The next document is that of the next lower id (of rows with one id, by a hash of the text; rows
    without an id come last), after the last the first. A null text is empty. Documents are range-
    sorted and read along; the ends of the partitions, two rows of each, are matched afterwards.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie")]
    rows = rows.repartitionByRange(shuffle_partitions(documents.sparkSession), *order).sortWithinPartitions(*order)
    names = [f.split()[0] for f in ROW.split(", ")]
    schema = f"{ROW}, part int, role string, text string"

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), None

        def end(role: str, doc_id: int | None, text: str, own: bytes) -> tuple:
            return (doc_id, None, None, own.hex(), None, None, part, role, text)

        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = fingerprint(text.encode())
                if before is None:
                    out.append(end("first", doc_id, text, own))
                else:
                    out.append((*_row(*before, text, own), part, None, None))
                before = (doc_id, text, own)
            yield _batch(out, fields)
        if before is not None:
            yield _batch([end("last", *before)], fields)

    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = pa.schema([(n, kinds[k]) for n, k in (f.split() for f in schema.split(", "))])
    found = written(rows.mapInArrow(along, schema), "edits")

    first = found.where("role = 'first'").select("part", F.col("text").alias("following"), F.col("fingerprint").alias("next_print"))
    ring = Window.orderBy("part")
    lowest = F.first("part").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = first.select(F.col("part").alias("own"), F.coalesce(F.lead("part").over(ring), lowest).alias("part"))
    ends = found.where("role = 'last'").select(F.col("part").alias("own"), "doc_id", "text", "fingerprint")
    ends = ends.join(after, "own").join(first, "part").select("doc_id", "text", "fingerprint", "following", "next_print")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = (c.to_pylist() for c in batch.columns)
            out = [_row(i, t, bytes.fromhex(f), n, bytes.fromhex(p)) for i, t, f, n, p in zip(*doc, strict=True)]
            yield _batch(out, pa.schema(list(fields)[: len(names)]))

    whole = found.where("role is null").select(*names).unionByName(ends.mapInArrow(match, ROW))
    return whole.select(
        "*",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def near_counts(prints: DataFrame, radius: int = RADIUS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows ``(fingerprint, n_near)``: how many other distinct fingerprints are within ``radius`` bits.

    ``prints`` has hex fingerprints in ``fingerprint``. Only those with any are returned. There is one
    table per block, led by it; rows that share a leading block are compared, the pair counting in
    the first table where they meet. Blocks shared by more than ``block_rows`` are dealt as pairs of
    parts of that size.
    """
    count = radius + 1
    edges = [BITS // 4 * i // count for i in range(count + 1)]  # in hex digits
    tables = [
        F.xxhash64(F.lit(k), F.substring("fingerprint", low + 1, high - low))
        for k, (low, high) in enumerate(zip(edges, edges[1:], strict=False))
    ]
    rows = prints.select("fingerprint").where("fingerprint is not null").distinct()
    rows = rows.select("fingerprint", F.posexplode(F.array(*tables)).alias("number", "block"))
    shared = rows.groupBy("block").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(shared, "block")
    parts = F.ceil(F.col("n") / block_rows).cast("int")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("fingerprint"), parts).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    words = [F.conv(F.substring("fingerprint", at, BITS // 8), 16, -10).cast("long") for at in (1, 1 + BITS // 8)]
    rows = rows.select(
        "block",
        F.least("part", "other").alias("one"),
        F.greatest("part", "other").alias("two"),
        "part",
        "number",
        words[0].alias("high"),
        words[1].alias("low"),
    )
    rows = rows.repartition(shuffle_partitions(prints.sparkSession), "block", "one", "two")
    rows = rows.sortWithinPartitions("block", "one", "two", "part")
    masks = []
    for low, high in zip(edges, edges[1:], strict=False):
        bits = sum(1 << (BITS - 1 - b) for b in range(4 * low, 4 * high))
        masks.append((np.uint64(bits >> 64), np.uint64(bits & (1 << 64) - 1)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, one, two, part, number, high, low in runs(batches, 3, PIECE_ROWS):
            high, low = high.view(np.uint64), low.view(np.uint64)
            near = np.zeros(len(block), np.int64)
            at, shift = np.arange(len(block)), 1
            while True:
                at = at[at + shift < len(block)]
                to = at + shift
                at = at[(block[at] == block[to]) & (one[at] == one[to]) & (two[at] == two[to])]
                if not len(at):
                    break
                to = at + shift
                x, y = high[at] ^ high[to], low[at] ^ low[to]
                met = (np.bitwise_count(x).astype(np.int64) + np.bitwise_count(y) <= radius) & (x | y > 0)
                met &= (one[at] == two[at]) | (part[at] != part[to])
                for k, (upper, lower) in enumerate(masks):
                    met &= (number[at] <= k) | (x & upper > 0) | (y & lower > 0)
                np.add.at(near, at[met], 1)
                np.add.at(near, to[met], 1)
                shift += 1
            some = near > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(v[some]) for v in (high.view(np.int64), low.view(np.int64), near)], ["high", "low", "near"]
            )

    met = rows.mapInArrow(compare, "high long, low long, near long")
    met = met.groupBy("high", "low").agg(F.sum("near").alias("n_near"))
    text = F.lower(F.concat(*(F.lpad(F.hex(c), BITS // 8, "0") for c in ("high", "low"))))
    return met.select(text.alias("fingerprint"), "n_near")


def document_prints(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``edit_prints`` with ``n_near``, the other distinct fingerprints within ``radius`` of a document's."""
    rows = written(edit_prints(documents), "prints")
    near = near_counts(rows, radius)
    return rows.join(near, "fingerprint", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0)))
