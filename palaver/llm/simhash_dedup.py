"""Near duplicates by SimHash: a binary trie self-join within a Hamming budget.

Texts are fingerprinted once. Distinct fingerprints are dealt to tries by the bits of every choice
of ``exact`` out of ``budget + exact`` blocks: two fingerprints within the budget agree in full on at
least one such choice, so they meet under the same root. In a trie, pairs of nodes are followed
together bit by bit, from the root paired with itself; each branching apart costs one of the budget,
and a pair over it is pruned with all that lies below.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.llm.common import runs, shuffle_partitions, unused, utf8
from palaver.llm.components import connected_components
from palaver.session import written

BITS = 64
SHINGLE = 4
SEED = 42
BUDGET = 4
EXACT = 2
#: Rows of a trie that one task takes; a larger trie is followed in pairs of parts.
TRIE_ROWS = 2048
#: Rows whose tries are followed at once, and pairs of nodes held at once.
PIECE_ROWS = 65_536
FRONTIER = 1_000_000


def simhash(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of UTF-8 text as an unsigned number; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    last = min(shingle, len(words)) - 1
    starts, ends = (ends - sizes)[: len(words) - last].tolist(), ends[last:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts, ends, strict=True)], "<u8")
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), PIECE_ROWS):
        part = hashes[at : at + PIECE_ROWS].view(np.uint8).reshape(-1, BITS // 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.uint32)
    bits = 2 * votes > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, shingle: int = SHINGLE, mark: Column | None = None) -> DataFrame:
    """Rows ``(doc_id, alone, fp)``, one per document; ``fp`` is the fingerprint as a signed long.

    ``alone`` is ``mark``; by default it tells rows without an id apart by a hash of their text and is
    0 for all others.
    """
    mark = row_mark() if mark is None else mark

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [simhash(t, shingle) for t in batch.column(2).to_pylist()]
            fp = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), fp], ["doc_id", "alone", "fp"]
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), mark.alias("alone"), utf8())
    return rows.mapInArrow(scan, "doc_id long, alone long, fp long")


def text_mark() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def row_mark() -> Column:
    return F.when(F.col("doc_id").isNull(), text_mark()).otherwise(F.lit(0))


def blocks(count: int) -> list[tuple[int, int]]:
    """Cut 64 bits into ``count`` blocks ``(lowest bit, width)`` of nearly equal width."""
    edges = [BITS * i // count for i in range(count + 1)]
    return [(low, high - low) for low, high in zip(edges, edges[1:], strict=False)]


def trie_roots(fps: DataFrame, budget: int, exact: int) -> DataFrame:
    """Rows ``(root, fp)``: each fingerprint once per choice of ``exact`` blocks."""
    cut = blocks(budget + exact)
    roots = []
    for number, chosen in enumerate(combinations(range(budget + exact), exact)):
        key = F.lit(number).cast("long")
        for low, width in (cut[i] for i in chosen):
            bits = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1))
            key = F.shiftleft(key, width).bitwiseOR(bits)
        roots.append(key)
    return fps.select(F.explode(F.array(*roots)).alias("root"), "fp")


def follow(values: np.ndarray, start: tuple[np.ndarray, ...], budget: int, link: Callable) -> None:
    """Follow pairs of trie nodes down to pairs of leaves within ``budget`` differing bits.

    ``values`` are unsigned and sorted within each trie; a node is a range of them. ``start`` has the
    ends of both ranges of the first pairs. ``link`` gets arrays of positions of linked values. Pairs
    are held ``FRONTIER`` at a time, the rest waits on a stack of at most as many levels as bits.
    """
    ones: dict[int, np.ndarray] = {}

    def split(depth: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        if depth not in ones:
            bit = (values >> np.uint64(BITS - 1 - depth)) & np.uint64(1)
            ones[depth] = np.concatenate([[0], np.cumsum(bit, dtype=np.int64)])
        return high - (ones[depth][high] - ones[depth][low])

    stack = [(0, *start, np.zeros(len(start[0]), np.int8))]
    while stack:
        depth, a0, a1, b0, b1, spent = stack.pop()
        if len(a0) > FRONTIER:
            for half in (slice(None, len(a0) // 2), slice(len(a0) // 2, None)):
                stack.append((depth, *(x[half] for x in (a0, a1, b0, b1, spent))))
            continue
        leaves = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaves.any():
            i, j = a0[leaves], b0[leaves]
            near = np.bitwise_count(values[i] ^ values[j]) <= budget
            link(i[near], j[near])
            a0, a1, b0, b1, spent = (x[~leaves] for x in (a0, a1, b0, b1, spent))
        if not len(a0):
            continue
        if depth == BITS:  # equal values in both parts
            link(a0, b0)
            continue
        am, bm, same = split(depth, a0, a1), split(depth, b0, b1), a0 == b0
        one_more = spent + np.int8(1)
        pairs = [
            (a0, am, b0, bm, spent),
            (am, a1, bm, b1, spent),
            (a0, am, bm, b1, one_more),
            (am[~same], a1[~same], b0[~same], bm[~same], one_more[~same]),
        ]
        a0, a1, b0, b1, spent = (np.concatenate(x) for x in zip(*pairs, strict=True))
        keep = (a1 > a0) & (b1 > b0) & (spent <= budget) & ((a0 != b0) | (a1 - a0 > 1))
        if keep.any():
            stack.append((depth + 1, *(x[keep] for x in (a0, a1, b0, b1, spent))))


class Forest:
    """Sets of positions, joined link by link; each is named by its smallest."""

    def __init__(self, size: int) -> None:
        self.root = np.arange(size)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            i, j = self.root[i], self.root[j]
            apart = i != j
            i, j = np.minimum(i[apart], j[apart]), np.maximum(i[apart], j[apart])
            np.minimum.at(self.root, j, i)
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]


def _tries(root: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-end positions of the stretches on which all columns are constant."""
    new = np.ones(len(root), bool)
    new[1:] = root[1:] != root[:-1]
    for column in more:
        new[1:] |= column[1:] != column[:-1]
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(root))


def _edges(fp: np.ndarray, forest: Forest) -> pa.RecordBatch:
    """One link from each joined position to the one that names its set."""
    at = np.flatnonzero(forest.root != np.arange(len(fp)))
    a, b = pa.array(fp[at]), pa.array(fp[forest.root[at]])
    roots = pa.nulls(len(at), pa.int64())
    return pa.RecordBatch.from_arrays([roots, a, b], ["root", "a", "b"])


def trie_links(fps: DataFrame, budget: int = BUDGET, exact: int = EXACT, trie_rows: int = TRIE_ROWS) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints that span every group reachable within ``budget``.

    Of each trie only a spanning forest of its links is returned, not all pairs. A trie of more than
    ``trie_rows`` fingerprints is dealt anew as pairs of parts of that size, each followed from the
    pair of both parts' roots, so that no task holds more than two parts.
    """

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        previous = None
        for root, fp in runs(batches, 1, PIECE_ROWS):
            first, end = _tries(root)
            large = end - first > trie_rows
            large[0] |= root[0] == previous  # the end of a root that fills more than a piece
            previous = root[-1]
            for lo, hi in zip(first[large], end[large], strict=True):
                columns = [pa.array(root[lo:hi]), pa.array(fp[lo:hi]), pa.nulls(hi - lo, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["root", "a", "b"])
            forest = Forest(len(fp))
            lo, hi = first[~large & (end - first > 1)], end[~large & (end - first > 1)]
            follow(fp.view(np.uint64), (lo, hi, lo, hi), budget, forest.join)
            yield _edges(fp, forest)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for root, one, two, part, fp in runs(batches, 3, PIECE_ROWS):
            first, end = _tries(root, one, two)
            inner, inner_end = _tries(root, one, two, part)
            forest = Forest(len(fp))
            alone = one[first] == two[first]
            lo, hi = first[alone], end[alone]
            follow(fp.view(np.uint64), (lo, hi, lo, hi), budget, forest.join)
            middle = inner_end[np.searchsorted(inner, first)]
            both = ~alone & (middle < end)
            first, middle, end = first[both], middle[both], end[both]
            follow(fp.view(np.uint64), (first, middle, middle, end), budget, forest.join)
            yield _edges(fp, forest)

    spark = fps.sparkSession
    unsigned = F.col("fp").bitwiseXOR(F.lit(-(1 << 63)))
    schema = "root long, a long, b long"
    dealt = trie_roots(fps, budget, exact)
    dealt = dealt.repartition(shuffle_partitions(spark), "root").sortWithinPartitions("root", unsigned)
    found = written(dealt.mapInArrow(small, schema), "tries")
    links = found.where("b is not null").select("a", "b")

    rest = found.where("b is null").select("root", F.col("a").alias("fp"))
    sizes = rest.groupBy("root").agg(F.ceil(F.count("*") / trie_rows).cast("int").alias("n"))
    rest = rest.join(sizes, "root").withColumn("part", F.pmod(F.xxhash64("fp"), "n").cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    rest = rest.select("root", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"), "part", "fp")
    rest = rest.repartition(shuffle_partitions(spark), "root", "one", "two")
    rest = rest.sortWithinPartitions("root", "one", "two", "part", unsigned)
    return links.unionByName(rest.mapInArrow(parts, schema).select("a", "b"))


def near_duplicates(
    documents: DataFrame,
    budget: int = BUDGET,
    shingle: int = SHINGLE,
    exact: int = EXACT,
    mark: Column | None = None,
) -> DataFrame:
    """Rows ``(doc_id, alone, fingerprint, component_id, kept)``, one per document.

    ``component_id`` is the smallest id reachable over links of at most ``budget`` differing bits;
    exactly one row of a component is ``kept``, that of the smallest id (of rows with one id, all are
    marked: they cannot be told apart here, unless ``mark`` does). Null texts count as empty; empty texts have fingerprint
    0 and link like any other. Rows without an id take part: a component of such rows alone has a
    null ``component_id`` and keeps the row with the smallest ``alone``. An empty table gives none.
    """
    marks = written(fingerprints(documents, shingle, mark), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "alone")).alias("first")
    classes = marks.groupBy("fp").agg(first)
    component = connected_components(trie_links(classes.select("fp"), budget, exact))
    classes = classes.join(component, classes.fp == component.node, "left")
    classes = classes.select("fp", "first", F.coalesce("component", "fp").alias("component"))
    lowest = classes.groupBy("component").agg(F.min("first").alias("lowest"))
    classes = classes.join(lowest, "component").select("fp", "lowest")
    rows = marks.join(classes, "fp")
    return rows.select(
        "doc_id",
        "alone",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("lowest.doc_id").alias("component_id"),
        (F.col("lowest.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("lowest.alone") == F.col("alone"))).alias("kept"),
    )


def drop_near_duplicates(documents: DataFrame, budget: int = BUDGET, shingle: int = SHINGLE) -> DataFrame:
    """The documents, all columns, with one row of each component: that of the smallest id.

    Rows are decided on by id and text, so different texts under one id are different documents; of a
    component that has several of its smallest id the one of the smallest text hash stays. Of rows equal in
    both one stays, the first by its columns. Rows without an id come last. Null and empty texts are one
    component. An empty table stays empty. Columns may have any names.
    """
    kept = near_duplicates(documents, budget, shingle, mark=text_mark()).where("kept")
    keys = [F.coalesce("doc_id", F.lit(0).cast("long")), F.col("doc_id").isNull()]
    names = unused(documents, "id", "no", "mark")
    kept = kept.select(*(c.alias(n) for c, n in zip((*keys, F.col("alone")), names, strict=True))).distinct()
    whole = unused(documents, "row")[0]
    keys[0] = F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))
    rows = documents.select(
        F.struct(*documents.columns).alias(whole), *(c.alias(n) for c, n in zip((*keys, text_mark()), names, strict=True))
    )
    # The join and the window share one shuffle by these keys.
    rows = rows.join(kept, names, "left_semi")
    place = unused(documents, "place")[0]
    one = F.row_number().over(Window.partitionBy(*names).orderBy(F.col(whole).cast("string")))
    return rows.withColumn(place, one).where(F.col(place) == 1).select(f"{whole}.*")
