"""Packing token sequences by non-negative least squares over combinations of lengths.

Documents are cut at multiples of the window; what is left of each has a length below it. Per chunk of
documents the histogram of these lengths is taken, all combinations of two or three present lengths that
fill a window exactly are enumerated, and the number of times to use each is the non-negative least squares
solution against the histogram. Rounded, they take pieces as long as there are some; residual pieces fill
windows greedily, cut where nothing fits.

A chunk is a bounded stretch of a partition, packed where it is read: no token is shuffled but those of
the last, partly filled window of each chunk, which are packed once more in groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm import tokens
from palaver.llm.common import utf8
from palaver.session import written

WINDOW = 1024
END = 0
#: Documents and tokens after which a chunk ends.
CHUNK_ROWS = 16_384
CHUNK_TOKENS = 8_000_000
ROUNDS = 150

LAYOUT = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def fillings(lengths: np.ndarray, window: int) -> np.ndarray:
    """All ``(a, b, c)`` of the given distinct lengths, ``a <= b <= c``, with sum ``window``.

    ``a`` is 0 where two lengths fill it.
    """
    lengths = np.sort(lengths)
    present = np.zeros(window + 1, bool)
    present[lengths] = True
    half = lengths[2 * lengths <= window]
    half = half[present[window - half]]
    two = np.stack([np.zeros_like(half), half, window - half], 1)
    a, b = lengths[:, None], lengths[None, :]
    c = window - a - b
    fits = (a <= b) & (b <= c)
    fits[fits] &= present[c[fits]]
    i, j = np.nonzero(fits)
    return np.concatenate([two, np.stack([lengths[i], lengths[j], window - lengths[i] - lengths[j]], 1)])


def repeats(ways: np.ndarray, histogram: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Non-negative least squares: how often to use each way so that the lengths used meet the histogram.

    Multiplicative steps keep every number positive and never raise the squared error.
    """
    if not len(ways):
        return np.zeros(0)
    size, target = len(histogram), histogram.astype(np.float64)
    target[0] = 0
    pull = target[ways].sum(1)
    times = np.full(len(ways), target.sum() / ways.astype(bool).sum())
    for _ in range(rounds):
        used = np.bincount(ways.ravel(), np.repeat(times, 3), size)
        used[0] = 0
        times *= pull / np.maximum(used[ways].sum(1), 1e-12)
    return times


def rounded(ways: np.ndarray, times: np.ndarray, histogram: np.ndarray) -> list[tuple[int, int]]:
    """Whole numbers ``(way, times)`` that the histogram can pay for: whole parts first, then by remainder."""
    left = histogram.tolist()
    whole = np.floor(times + 1e-9).astype(int)
    parts = times - whole
    steps = [(k, int(whole[k])) for k in np.argsort(-whole, kind="stable") if whole[k]]
    steps += [(k, 1) for k in np.argsort(-parts, kind="stable") if parts[k] > 0.01]
    listed, out = ways.tolist(), []
    for k, wanted in steps:
        way = [x for x in listed[k] if x]
        can = min(wanted, *(left[x] // way.count(x) for x in way))
        if can > 0:
            for x in way:
                left[x] -= can
            out.append((int(k), can))
    return out


Piece = tuple[int, int, int]


def lay(sizes: list[int], window: int = WINDOW) -> tuple[list[list[Piece]], list[Piece]]:
    """Full windows of pieces ``(item, start, length)`` and the pieces of a last one that is not full.

    Every position of every item lies in one piece.
    """
    windows: list[list[Piece]] = []
    rest: list[list[tuple[int, int]]] = [[] for _ in range(window)]
    for item, size in enumerate(sizes):
        full = size - size % window
        windows.extend([(item, at, window)] for at in range(0, full, window))
        if size > full:
            rest[size - full].append((item, full))
    histogram = np.array([len(r) for r in rest] + [0])
    ways = fillings(np.flatnonzero(histogram), window)
    for way, count in rounded(ways, repeats(ways, histogram), histogram):
        for _ in range(count):
            windows.append([(*rest[n].pop(), n) for n in ways[way].tolist() if n])

    held = sum(1 << n for n in range(window) if rest[n])  # lengths that still have pieces
    while held:
        gap, filled = window, []
        while gap and held:
            fitting = held & ((2 << gap) - 1)
            n = (fitting or held & -held).bit_length() - 1  # the longest that fits, else the shortest of all
            item, start = rest[n].pop()
            if not rest[n]:
                held ^= 1 << n
            used = min(n, gap)
            filled.append((item, start, used))
            gap -= used
            if n > used:
                rest[n - used].append((item, start + used))
                held |= 1 << (n - used)
        if gap:
            return windows, filled
        windows.append(filled)
    return windows, []


def powers(pieces: list[Piece]) -> list[list[Piece]]:
    """The pieces laid out in sequences whose lengths are powers of two, the longest first."""
    total, out = sum(n for _, _, n in pieces), []
    waiting = pieces[::-1]
    for bit in reversed(range(total.bit_length())):
        gap, filled = total & (1 << bit), []
        while gap:
            item, start, n = waiting.pop()
            used = min(n, gap)
            filled.append((item, start, used))
            gap -= used
            if n > used:
                waiting.append((item, start + used, n - used))
        if filled:
            out.append(filled)
    return out


def pack_tokens(
    documents: DataFrame,
    file: str | None = None,
    ranks: str | None = None,
    window: int = WINDOW,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Rows of ``LAYOUT``, one per piece of a document, covering each id of each document once.

    A document is the ids of its text, then ``END``; a null or empty text is ``END`` alone. Sequences hold
    ``window`` ids, or a power of two below, so nothing is padded. Documents are told apart by row: repeated
    rows, ids that are null or occur twice are packed like any others. Text that spells a special token is
    read as the vocabulary's file says. A text of any length is packed whole. An empty table gives none.
    Further columns are ignored.
    """
    file, ranks = file or tokens.path(tokens.BYTES_FILE), ranks or tokens.path(tokens.RANKS_FILE)
    names = [field.split()[0] for field in LAYOUT.split(", ")]
    schema = pa.schema([(n, pa.int64()) for n in names] + [("chunk", pa.int64()), ("ids", pa.binary())])

    def rows(laid: list[list[Piece]], first: int, sign: int, items: list[tuple], kept: list[Piece], chunk: int) -> pa.RecordBatch:
        """``items`` are ``(doc_id, start, doc_tokens, ids)``; ``kept`` pieces go on without a sequence."""
        out = []
        for number, pieces in enumerate(laid, first):
            offset = 0
            for item, start, length in pieces:
                doc_id, before, total, ids = items[item]
                check = crc32(ids[start : start + length].tobytes())
                out.append((doc_id, before + start, length, check, total, sign * number - (sign < 0), offset, None, None))
                offset += length
        for item, start, length in kept:
            doc_id, before, total, ids = items[item]
            part = ids[start : start + length].tobytes()
            out.append((doc_id, before + start, length, crc32(part), total, None, None, chunk, part))
        columns = zip(*out, strict=True) if out else [[]] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = tokens.byte_level(file, ranks, False)
        items, held, used, chunks = [], 0, 0, 0

        def done(partition: int) -> pa.RecordBatch:
            nonlocal items, held, used, chunks
            laid, kept = lay([len(item[3]) for item in items], window)
            found = rows(laid, (partition << 33) + used, 1, items, kept, (partition << 33) + chunks)
            items, held, used, chunks = [], 0, used + len(laid), chunks + 1
            return found

        for batch in batches:
            for doc_id, text, partition in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.append(vocabulary.encode(text.decode()), np.uint32(END))
                items.append((doc_id, 0, len(ids), ids))
                held += len(ids)
                if len(items) >= chunk_rows or held >= CHUNK_TOKENS:
                    yield done(partition)
        if items:
            yield done(partition)

    def again(key: tuple, table: pa.Table) -> pa.Table:
        columns = (table.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids"))
        items = [(d, s, t, np.frombuffer(i, "<u4")) for d, s, t, i in zip(*columns, strict=True)]
        laid, kept = lay([len(item[3]) for item in items], window)
        found = rows(laid + powers(kept), key[0].as_py() << 33, -1, items, [], 0)
        return pa.Table.from_batches([found]).select(names)

    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(), F.spark_partition_id())
    first = written(own.mapInArrow(read, LAYOUT + ", chunk long, ids binary"), "packed")
    rest = first.where("sequence_id is null")
    groups = max(1, math.ceil(rest.count() / chunk_rows))
    last = rest.groupBy(F.pmod(F.xxhash64("chunk"), F.lit(groups)).alias("group")).applyInArrow(again, LAYOUT)
    return first.where("sequence_id is not null").select(*names).unionByName(last)
