"""Alignment of two tokenizers' tokens by divide and conquer at shared cuts.

Both token sequences of a text spell the same bytes. Where tokens of both end is a cut. An interval of
tokens looks for a cut near its middle, by bisecting the other side's ends for each candidate, and goes on
with both halves; an interval without one is a group, and all its tokens of one side are linked to all of
the other. How many documents link a pair of ids is counted over the corpus and judged per document.

Counts of pairs are many but steep: the most frequent ``HOT`` at most are broadcast, the others meet their
documents in a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm import tokens
from palaver.llm.common import utf8
from palaver.session import written

#: Pairs broadcast with their counts, 13 bytes each.
HOT = 1_000_000
#: Distinct pairs a counting task holds before it hands them on.
HELD = 2_000_000
#: Texts aligned together, and neighbours of the middle tried one by one.
TOGETHER = 256
PROBES = 8
#: Links of a group beyond which its pairs are counted by distinct ids.
WIDE = 65_536

LAYOUT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
)


def near_middle(a: np.ndarray, b: np.ndarray, a0: np.ndarray, a1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each interval the token of ``a``, not its last, with a shared end nearest the middle, and ``b``'s; or -1.

    Each candidate's end is bisected for in ``b``: the middle, then its neighbours in turn. An interval that
    has no cut that near has all its other candidates tried at once.
    """
    middle = (a0 + a1 - 2) // 2
    found, partner = np.full(len(a0), -1), np.full(len(a0), -1)
    waiting = np.arange(len(a0))
    for step in range(PROBES):
        at = middle[waiting] + (step + 1) // 2 * (1 if step % 2 else -1)
        inside = (at >= a0[waiting]) & (at < a1[waiting] - 1)
        end = a[np.where(inside, at, 0)]
        j = np.searchsorted(b, end)
        hit = inside & (b[j] == end)
        found[waiting[hit]], partner[waiting[hit]] = at[hit], j[hit]
        waiting = waiting[~hit]
        waiting = waiting[(a1 - a0)[waiting] - 1 > step + 1]
    for k in waiting:
        end = a[a0[k] : a1[k] - 1]
        j = np.searchsorted(b, end)
        hits = np.flatnonzero(b[j] == end)
        if len(hits):
            best = hits[np.argmin(np.abs(hits + a0[k] - middle[k]))]
            found[k], partner[k] = a0[k] + best, j[best]
    return found, partner


def shared_cuts(a: np.ndarray, b: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """For each token of ``a`` the token of ``b`` that ends where it ends, or -1.

    ``a`` and ``b`` are the ends of the tokens of some texts, ascending over all of them; ``firsts`` has each
    text's first tokens on both sides, then the numbers of all. The intervals of all texts are divided
    together, a level at a time.
    """
    partner = np.full(len(a), -1)
    (a0, b0), (a1, b1) = firsts[:-1].T, firsts[1:].T
    partner[a1 - 1] = b1 - 1
    while len(a0):
        wide = (a1 - a0 > 1) & (b1 - b0 > 1)
        a0, a1, b0, b1 = a0[wide], a1[wide], b0[wide], b1[wide]
        k, j = near_middle(a, b, a0, a1)
        cut = k >= 0
        a0, a1, b0, b1, k, j = (x[cut] for x in (a0, a1, b0, b1, k, j))
        partner[k] = j
        a0, a1 = np.stack([a0, k + 1], 1).ravel(), np.stack([k + 1, a1], 1).ravel()
        b0, b1 = np.stack([b0, j + 1], 1).ravel(), np.stack([j + 1, b1], 1).ravel()
    return partner


def linked(a: np.ndarray, b: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs ``a << 16 | b`` of linked ids, ascending, and how often each is linked."""
    starts = np.vstack([[(0, 0)], cuts[:-1]])
    na, nb = (cuts - starts).T
    wide = na * nb > WIDE
    group = np.repeat(np.arange(len(cuts)), na)
    keep = ~wide[group]
    first, count = starts[group, 1][keep], nb[group][keep]
    ends = np.cumsum(count)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count) + np.repeat(first, count)
    pairs, times = np.unique(np.repeat(a[keep].astype(np.int64) << 16, count) | b[at], return_counts=True)
    for k in np.flatnonzero(wide):
        x, nx = np.unique(a[starts[k, 0] : cuts[k, 0]], return_counts=True)
        y, ny = np.unique(b[starts[k, 1] : cuts[k, 1]], return_counts=True)
        more = (x.astype(np.int64)[:, None] << 16 | y).ravel()
        pairs, times = summed(np.append(pairs, more), np.append(times, np.outer(nx, ny).ravel()))
    return pairs, times


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def joined(table: pa.Array, at: np.ndarray) -> bytes:
    """Entries of a table of bytes, one after the other: just what Arrow lays out when it takes them."""
    taken = table.take(pa.array(at))
    _, ends, data = taken.buffers()
    return data.to_pybytes()[: np.frombuffer(ends, np.int32)[len(at)]]


class Aligner:
    """Texts to the rows of ``LAYOUT`` without the first column."""

    def __init__(self, bytes_file: str, ranks_file: str, pieces_file: str) -> None:
        self.a, self.b = tokens.byte_level(bytes_file, ranks_file, True), tokens.piece_level(pieces_file)
        if max(len(self.a.bytes), len(self.b.bytes)) > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        self.sizes = [np.array(list(map(len, v.bytes))) for v in (self.a, self.b)]
        # What follows an id: another of its side and group, the other side, the next group.
        self.shown = pa.array([f"{i}{after}".encode() for after in ",|;" for i in range(1 << 16)], pa.binary())
        self.spelled = pa.array(self.b.bytes, pa.binary())

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides; none for a text without or one that a side does not spell."""
        if not text:
            return None
        a, b, whole = self.a.encode(" " + text), self.b.encode(text), (" " + text).encode()
        # Tokens of bytes always spell their text, so their length will do.
        same = self.sizes[0][a].sum() == len(whole) and joined(self.spelled, b) == whole
        return (a, b) if same else None

    def digest(self, a: np.ndarray, b: np.ndarray, cuts: np.ndarray) -> str:
        """Of the groups as text: the tokens of both sides in the order of groups, each with what follows it."""
        sizes = np.diff(cuts, axis=0, prepend=0)
        before = cuts - sizes
        laid = np.zeros(len(a) + len(b), np.int64)
        laid[np.arange(len(a)) + np.repeat(before[:, 1], sizes[:, 0])] = a
        laid[np.arange(len(b)) + np.repeat(cuts[:, 0], sizes[:, 1])] = b
        laid[cuts[:, 0] + before[:, 1] - 1] += 1 << 16
        laid[cuts.sum(1) - 1] += 2 << 16
        return sha256(joined(self.shown, laid)[:-1]).hexdigest()

    def rows(self, texts: list[str]) -> list[tuple]:
        found = [self.ids(text) for text in texts]
        some = [ids for ids in found if ids is not None]
        firsts = np.cumsum([(0, 0), *((len(a), len(b)) for a, b in some)], axis=0)
        ends = [np.cumsum(size[np.concatenate([ids[k] for ids in some])]) if some else None for k, size in enumerate(self.sizes)]
        partner = shared_cuts(*ends, firsts) if some else None
        out, number = [], 0
        for ids in found:
            if ids is None:
                out.append((0, 0, 0, 0, "", b"", b""))
                continue
            own = partner[firsts[number, 0] : firsts[number + 1, 0]]
            at = np.flatnonzero(own >= 0)
            cuts = np.stack([at + 1, own[at] + 1 - firsts[number, 1]], 1)
            pairs, times = linked(*ids, cuts)
            sizes = (len(ids[0]), len(ids[1]), len(cuts), int(times.sum()))
            out.append((*sizes, self.digest(*ids, cuts), pairs.astype("<u4").tobytes(), times.astype("<u4").tobytes()))
            number += 1
        return out


def aligned(documents: DataFrame, bytes_file: str, ranks_file: str, pieces_file: str) -> DataFrame:
    """Rows of ``LAYOUT``: what a text's alignment says by itself, and its distinct linked pairs."""
    names = [field.split() for field in LAYOUT.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in names])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(bytes_file, ranks_file, pieces_file)
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(at, TOGETHER)
                columns = zip(*aligner.rows([t.decode() for t in batch.column(1).to_pylist()]), strict=True)
                arrays = [pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], schema=schema)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), utf8()).mapInArrow(scan, LAYOUT)


def pair_counts(rows: DataFrame) -> DataFrame:
    """Rows ``(pair, n)``: how many of ``rows`` hold a pair. Tasks add up before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(pairs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64()), pa.array(n, pa.int64())], ["pair", "n"])

        pairs, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting: list[np.ndarray] = []
        size = 0
        for found in batches:
            for own in found.column(0).to_pylist():
                waiting.append(np.frombuffer(own, "<u4"))
                size += len(waiting[-1])
                if size > HELD:
                    new = np.concatenate(waiting).astype(np.int64)
                    pairs, n = summed(np.append(pairs, new), np.append(n, np.ones(len(new), np.int64)))
                    waiting, size = [], 0
                    if len(pairs) > HELD:
                        yield batch(pairs, n)
                        pairs, n = pairs[:0], n[:0]
        if waiting:
            new = np.concatenate(waiting).astype(np.int64)
            pairs, n = summed(np.append(pairs, new), np.append(n, np.ones(len(new), np.int64)))
        yield batch(pairs, n)

    return rows.select("pairs").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def hottest(counts: DataFrame, most: int) -> DataFrame:
    """The pairs of the highest counts, at most ``most``: all above a power of the fourth root of two."""
    level = F.floor(F.log2("n") * 4).cast("int")
    sizes = sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True)  # a row per level
    floor, held = None, 0
    for size in sizes:
        held += size["count"]
        if held > most:
            break
        floor = size["level"]
    return counts.where(level >= floor if floor is not None else F.lit(False))


def align(
    documents: DataFrame,
    bytes_file: str | None = None,
    ranks_file: str | None = None,
    pieces_file: str | None = None,
    hot: int = HOT,
) -> DataFrame:
    """Rows ``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``, one per document.

    A null or empty text, and one that a side does not spell (U+2581 in it reads as a blank), has zeros and
    an empty ``groups_sha256``. Repeated rows count as documents of their own. ``n_best`` counts links of
    pairs that no other pair of their first id exceeds; ties are all best. A text of any length is aligned
    whole; what a task holds of it grows with its distinct linked pairs. Rows without an id are rows like
    others. An empty table gives none. Further columns are ignored.
    """
    bytes_file, ranks_file = bytes_file or tokens.path(tokens.BYTES_FILE), ranks_file or tokens.path(tokens.RANKS_FILE)
    rows = aligned(documents, bytes_file, ranks_file, pieces_file or tokens.path(tokens.PIECES_FILE))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = written(pair_counts(rows), "pairs")
    first = F.shiftright("pair", 16).alias("a")
    best = counts.groupBy(first).agg(F.max("n").alias("best"))  # a row per id of the vocabulary
    judged = counts.withColumn("a", first).join(F.broadcast(best), "a")
    judged = written(judged.select("pair", "n", (F.col("n") == F.col("best")).alias("best")), "judged")

    known = hottest(judged, hot).toArrow()
    order = np.argsort(known["pair"].to_numpy())
    known = [known["pair"].to_numpy()[order].astype("<u4"), known["n"].to_numpy()[order], known["best"].to_numpy()[order]]
    shared = documents.sparkSession.sparkContext.broadcast(known)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = shared.value
        for batch in batches:
            sums, bests, pairs_left, times_left = [], [], [], []
            for pairs, times in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                pairs, times = np.frombuffer(pairs, "<u4"), np.frombuffer(times, "<u4").astype(np.int64)
                at = np.searchsorted(keys, pairs)
                met = np.zeros(len(pairs), bool)
                inside = at < len(keys)
                met[inside] = keys[at[inside]] == pairs[inside]
                sums.append(int((n[at[met]] * times[met]).sum()))
                bests.append(int(times[met][best[at[met]]].sum()))
                pairs_left.append(pairs[~met].tolist())
                times_left.append(times[~met].tolist())
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            arrays = [pa.array(x, k) for x, k in zip((sums, bests, pairs_left, times_left), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["row", "sum", "best", "left", "often"])

    schema = "row long, sum long, best long, left array<long>, often array<long>"
    found = written(rows.select("row", "pairs", "times").mapInArrow(judge, schema), "found")
    left = found.select("row", F.inline(F.arrays_zip(F.col("left").alias("pair"), F.col("often").alias("often"))))
    left = left.join(judged, "pair")
    left = left.select(
        "row", (F.col("n") * F.col("often")).alias("sum"), F.when(F.col("best"), F.col("often")).otherwise(0).alias("best")
    )
    sums = found.select("row", "sum", "best").unionByName(left).groupBy("row")
    sums = sums.agg(F.sum("best").alias("n_best"), F.sum("sum").alias("count_sum"))
    return rows.join(sums, "row").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
