"""LM scoring by masked pseudo-likelihood: each token predicted from the words on both of its sides.

Words are counted whole, by ending and hash, in a table that grows with the corpus. The commonest are
classes of their own, the other frequent ones share classes of about equal count, and the rest, however
many, are dealt to a few classes by hash. A network over a window on both sides predicts the class and,
from the same hidden layer, the way down a binary tree over the class's words in order of their endings;
each turn weighs what the words on either side count. So a frequent word is predicted to the word itself;
the rest are to the leaf of their ending and some bits of their hash, where they have their shares of the
count. The summed logarithms score a document. Counts of leaves are sent along; those of the rest's words
are joined, and as each of these is rare, so is each key of that join.
The network is trained by every partition on every token of its own documents, starting from common
weights, which are then averaged by the number of tokens seen; this is done a few times over.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import summed_arrays, utf8
from palaver.llm.licenses import FOLD
from palaver.session import scratch_path, written

#: Words whose class and leaf are sent to all tasks, the most frequent ones.
HEAD = 1 << 18
#: Bits of a word's name that tell its ending, and those behind them that are a hash.
ENDING, HASHED = 15, 48
BLANK = 32
#: What bytes count in a hash, and by what that grows from byte to byte.
SPELLING = np.random.default_rng(11).integers(1, 1 << 64, 256, dtype=np.uint64)
SPELLING[BLANK] = 0
RADIX = 0x9E3779B97F4A7C15
#: Bytes of texts whose words are named together, about.
SPELLED = 1 << 16
#: Bits of the names of other words, the first ones, that tell the leaf.
TAIL_BITS = 16
OWN_CLASSES = 64
#: Classes of words of the head, and behind them those of all others.
HEAD_CLASSES = 92
TAIL_CLASSES = 4
CLASSES = HEAD_CLASSES + TAIL_CLASSES
#: The class of what lies before and after a document.
EDGE = CLASSES
SIDE = 2
EMBEDDED = 8
HIDDEN = 16
OFFSETS = [k for k in range(2 * SIDE + 1) if k != SIDE]
ROUNDS = 2
BATCH = 2048
RATE = 0.02
PIECE = 2048
#: Tokens that a task counts at once.
COUNTED = 1 << 21
#: Scores of classes below this need no shift before their exponentials are taken.
SAFE = 40

#: A tree's first turns have weights at each node, the others at each level.
NODES, DEPTH = 5, HEAD.bit_length() - 1
TURNS = (1 << NODES) - 1 + DEPTH - NODES
#: Weights of the turns within each class of several words.
WITHIN = (CLASSES - OWN_CLASSES, HIDDEN + 1, TURNS)

SHAPES = [
    (CLASSES + 1, EMBEDDED),
    (len(OFFSETS), EMBEDDED, HIDDEN),
    (HIDDEN,),
    (HIDDEN, CLASSES),
    (CLASSES,),
]


@lru_cache(maxsize=2)
def powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``2 ** bits`` powers of ``RADIX``, and of its inverse, in 64 bits."""
    return tuple(
        np.append(np.uint64(1), np.cumprod(np.full((1 << bits) - 1, x, np.uint64)))
        for x in (RADIX, pow(RADIX, -1, 1 << 64))
    )


def spelled(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The words' names in order, and where the words end. A name is five bits for each of the last three
    bytes, from the last on, then a hash: a polynomial over random numbers for the bytes, stirred."""
    line = np.frombuffer(b"   " + text.translate(FOLD) + b" ", np.uint8)
    filled = line != BLANK
    turns = np.flatnonzero(filled[1:] != filled[:-1])
    first, last = turns[::2] + 1, turns[1::2]
    if not len(first):
        return first, last
    up, down = powers(max(16, len(line).bit_length()))
    own = np.add.reduceat(np.take(SPELLING, line) * up[: len(line)], first) * down[first]
    own ^= own >> np.uint64(32)
    own *= np.uint64(RADIX)
    own >>= np.uint64(64 - HASHED)
    before = filled[last - 1]
    low = line & 31
    ending = low[last].astype(np.int64) << 10
    ending |= (low[last - 1] * before).astype(np.int64) << 5
    ending |= low[last - 2] * (before & filled[last - 2])
    return own.view(np.int64) | ending << HASHED, last - 3


def hashes(text: bytes) -> np.ndarray:
    return spelled(text)[0]


def named(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For some texts at a time their words' names in a row, and how many words each has."""
    held, size = [], 0
    for k, text in enumerate(texts, 1):
        held.append(text.as_py())
        size += len(held[-1])
        if size >= SPELLED or k == len(texts):
            names, last = spelled(b" ".join(held))
            ends = np.cumsum([len(x) + 1 for x in held])
            yield names, np.diff(np.searchsorted(last, ends), prepend=0)
            held, size = [], 0


def vocabulary(documents: DataFrame) -> DataFrame:
    """Rows ``(word, n)``: how often each word, named by its hash, stands in all documents."""

    def counted(own: list[np.ndarray]) -> pa.RecordBatch:
        words, n = np.unique(np.concatenate(own), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(words), pa.array(n.astype(np.int64))], ["word", "n"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for names, _ in named(batch.column(0)):
                held.append(names)
                size += len(names)
                if size >= COUNTED:
                    yield counted(held)
                    held, size = [], 0
        if size:
            yield counted(held)

    found = documents.select(utf8()).mapInArrow(scan, "word long, n long")
    return written(found.groupBy("word").agg(F.sum("n").alias("n")), "vocabulary")


def classes_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per word of the head, most frequent first, its class and the logarithm of its share in it."""
    classes = np.arange(len(counts))
    rest = counts[OWN_CLASSES:].astype(np.float64)
    if len(rest):
        mass, bands = np.cumsum(rest), HEAD_CLASSES - OWN_CLASSES
        classes[OWN_CLASSES:] = OWN_CLASSES + np.minimum((mass - rest) / mass[-1] * bands, bands - 1).astype(int)
    share = np.bincount(classes, counts, HEAD_CLASSES)
    return classes.astype(np.uint8), np.log(counts / share[classes])


class Leaves:
    """Classes' leaves, one class after the other (``starts``), and how many tokens each has (``counts``).

    A class is bisected by places until a leaf stands alone. Of a word's turns only those with tokens on
    both sides are decisions. Those of leaf ``k`` are ``first[k]`` and the ``size[k]`` from there on: the
    turn's place among ``TURNS``, for the upper side behind all of these, and the logarithm of the other
    side's tokens to this one's.
    """

    def __init__(self, starts: np.ndarray, counts: np.ndarray) -> None:
        self.starts, self.counts = starts, counts

    def __reduce__(self) -> tuple:
        return Leaves, (self.starts, self.counts)

    @cached_property
    def paths(self) -> tuple[np.ndarray, ...]:
        own = np.flatnonzero(self.counts)
        kind = np.searchsorted(self.starts, own, "right")
        low, high = self.starts[kind - 1], self.starts[kind]
        upto = np.append(0.0, np.cumsum(self.counts, dtype=np.float64))
        node, found, level = np.zeros(len(own), np.int64), [], 0
        while (high - low).max(initial=0) > 1:
            middle = (low + high) // 2
            right = own >= middle
            under, over = upto[middle] - upto[low], upto[high] - upto[middle]
            at = np.flatnonzero((under > 0) & (over > 0))
            turn = (1 << level) - 1 + node if level < NODES else np.full(len(own), min(TURNS, (1 << NODES) + level - NODES) - 1)
            odds = np.log(over[at] / under[at])
            found.append((at, turn[at] + TURNS * right[at], np.where(right[at], -odds, odds)))
            node, level = 2 * node + right, level + 1
            low, high = np.where(right, middle, low), np.where(right, high, middle)
        size = np.zeros(len(self.counts), np.int32)
        for at, *_ in found:
            size[own[at]] += 1
        first = (np.cumsum(size) - size).astype(np.int32)
        turns, odds = np.empty(size.sum(), np.uint8), np.empty(size.sum(), np.float32)
        place = first.copy()
        for at, *parts in found:
            for whole, part in zip((turns, odds), parts, strict=True):
                whole[place[own[at]]] = part
            place[own[at]] += 1
        return first, size, turns, odds


def split_vocabulary(words: DataFrame, head: int = HEAD) -> tuple[tuple[np.ndarray, ...], DataFrame]:
    """``(name, class, leaf)`` of the ``head`` most frequent words in order of name with all leaves' starts
    and counts, and the other words ``(word, n)``."""
    top = words.orderBy(F.desc("n"), "word").limit(head).toArrow()  # bounded by ``head``
    names, counts = top["word"].to_numpy(), top["n"].to_numpy()
    classes, _ = classes_of(counts)
    placed = np.lexsort((names, classes))
    leaf = np.empty(len(names), np.int32)
    leaf[placed] = np.arange(len(names))
    order = np.argsort(names)
    tail = words.where("false")
    if len(names):
        last, name = int(counts[-1]), int(names[-1])
        tail = words.where((F.col("n") < last) | ((F.col("n") == last) & (F.col("word") > name)))
    kind = F.pmod("word", F.lit(TAIL_CLASSES))
    place = F.shiftright("word", ENDING + HASHED - TAIL_BITS)
    rest = tail.groupBy(kind.alias("kind"), place.alias("place")).agg(F.sum("n").alias("n")).toArrow()  # a row per leaf
    sizes = np.zeros((TAIL_CLASSES, 1 << TAIL_BITS), np.int64)
    sizes[rest["kind"].to_numpy(), rest["place"].to_numpy()] = rest["n"].to_numpy()
    starts = np.searchsorted(classes[placed], np.arange(HEAD_CLASSES + 1))
    starts = np.append(starts, len(names) + (np.arange(TAIL_CLASSES) + 1 << TAIL_BITS))
    return (names[order], classes[order], leaf[order], starts, np.append(counts[placed], sizes.ravel())), tail


def cut(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Pieces of these lengths as bytes."""
    ends = np.append(0, np.cumsum(lengths) * values.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(values)])


def encoded(documents: DataFrame, head: tuple[np.ndarray, ...]) -> DataFrame:
    """Rows ``(row, doc_id, n_tokens, inner, classes, leaves, tail)``: classes as bytes, leaves as 32-bit numbers,
    summed logarithms of words' shares in their leaves (of words outside the head only the leaf's size is in)
    and these words. The column of leaves tells in its metadata where their starts and counts are."""
    spark = documents.sparkSession
    names, classes, leaves, starts, counts = head
    path = scratch_path(spark, "leaves")
    parts = {"starts": [starts.astype(np.int64).tobytes()], "counts": [counts.astype(np.int64).tobytes()]}
    spark.createDataFrame(pa.table(parts)).write.parquet(path)
    behind = starts[HEAD_CLASSES]
    sizes = np.log(np.maximum(counts[behind:], 1))
    shared = spark.sparkContext.broadcast((names, classes, leaves, behind, sizes))  # bounded by words and leaves

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, classes, leaves, behind, sizes = shared.value
        for batch in batches:
            parts = [[names[:0], classes[:0], leaves[:0], names[:0], names[:0], sizes[:0]]]
            for own, length in named(batch.column(1)):
                at = np.minimum(np.searchsorted(names, own), len(names) - 1)
                kind, place = classes[at], leaves[at]
                out = np.flatnonzero(names[at] != own)
                tail = own[out]
                dealt = tail % TAIL_CLASSES
                within = (dealt << TAIL_BITS) + (tail >> ENDING + HASHED - TAIL_BITS)
                kind[out], place[out] = HEAD_CLASSES + dealt, behind + within
                text = np.repeat(np.arange(len(length)), length)[out]
                rare = np.bincount(text, minlength=len(length))
                parts.append([length, kind, place, tail, rare, -np.bincount(text, sizes[within], len(length))])
            length, kind, place, tail, rare, inner = map(np.concatenate, zip(*parts, strict=True))
            columns = [
                batch.column(0),
                pa.array(length, pa.int64()),
                pa.array(inner, pa.float64()),
                cut(kind, length),
                cut(place, length),
                pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(rare)), pa.int32()), pa.array(tail)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "inner", "classes", "leaves", "tail"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), utf8())
    schema = "doc_id long, n_tokens long, inner double, classes binary, leaves binary, tail array<long>"
    rows = rows.mapInArrow(scan, schema).withColumn("leaves", F.col("leaves").alias("leaves", metadata={"path": path}))
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "encoded")


def leaves_of(rows: DataFrame) -> Leaves:
    """The leaves of ``encoded`` rows."""
    path = rows.schema["leaves"].metadata["path"]
    found = rows.sparkSession.read.parquet(path).first()
    return Leaves(np.frombuffer(found.starts, np.int64), np.frombuffer(found.counts, np.int64))


def initial(seed: int = 3) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    scales = (0.5, 1 / np.sqrt(EMBEDDED * len(OFFSETS)), 0.0, 0.3, 0.0)
    return [(rng.normal(size=s) * k).astype(np.float32) for s, k in zip(SHAPES, scales, strict=True)]


def views(values: np.ndarray) -> list[np.ndarray]:
    """The parts of one array in the network's shapes; those of the trees' turns may be absent."""
    shapes = [*SHAPES, WITHIN]
    ends = np.cumsum([int(np.prod(shape)) for shape in shapes])
    parts = zip(np.split(values, ends[:-1]), shapes, strict=True)
    return [part.reshape(shape) for part, shape in parts if len(part)]


def padded(documents: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The documents' classes in a row with edges between; positions of tokens, and their document."""
    sizes = np.fromiter(map(len, documents), np.int64, len(documents))
    edge = bytes([EDGE]) * SIDE
    line = np.frombuffer(edge + edge.join(documents) + edge, np.uint8)
    owner = np.repeat(np.arange(len(documents)), sizes)
    return line, np.arange(len(owner)) + SIDE * (owner + 1), owner


def placed(documents: pa.Array) -> np.ndarray:
    """The tokens' leaves in a row."""
    return np.frombuffer(b"".join(documents.to_pylist()), np.int32)


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def hidden(tables: list[np.ndarray], bias: np.ndarray, context: list[np.ndarray]) -> np.ndarray:
    """The hidden layer, a column per window, and a row of ones; ``tables`` are what classes add at each offset."""
    total = np.take(tables[0], context[0], axis=0)
    for table, classes in zip(tables[1:], context[1:], strict=True):
        total += np.take(table, classes, axis=0)
    total += bias
    h = np.ones((HIDDEN + 1, len(total)), np.float32)
    np.tanh(total.T, out=h[:-1])
    return h


def class_scores(out: np.ndarray, out_bias: np.ndarray, h: np.ndarray, held: np.ndarray | None = None) -> np.ndarray:
    """A row per class and a column per window, safe to take exponentials of. ``held`` is memory to use."""
    whole = np.vstack([out, out_bias]).T
    z = np.matmul(whole, h, out=None if held is None else held[: CLASSES * h.shape[1]].reshape(CLASSES, -1))
    # No hidden value exceeds 1.
    if np.abs(whole).sum(1).max() >= SAFE:
        z -= z.max(0)
    return z


class Turns:
    """The decisions of some tokens on their ways to their leaves, given their hidden layers.

    Tokens lie by class in a table of one row a class, so that one product serves them all.
    """

    def __init__(self, within: np.ndarray, leaves: Leaves, kinds: np.ndarray, own: np.ndarray, h: np.ndarray) -> None:
        self.within = within
        at = np.flatnonzero(kinds >= OWN_CLASSES)
        kinds = kinds[at] - OWN_CLASSES
        order = np.argsort(kinds, kind="stable")
        self.at, kinds = at[order], kinds[order]
        met = np.bincount(kinds, minlength=len(within))
        width = met.max(initial=0)
        self.cell = np.arange(len(kinds)) + (np.arange(len(within)) * width - np.cumsum(met) + met)[kinds]
        self.table = np.zeros((len(within) * width, HIDDEN + 1), np.float32)
        self.table[self.cell] = np.ascontiguousarray(h.T)[self.at]
        self.table = self.table.reshape(len(within), width, HIDDEN + 1)
        first, size, turns, odds = leaves.paths
        leaf = own[self.at]
        self.size = size[leaf]
        ends = np.cumsum(self.size)
        found = np.arange(ends[-1] if len(ends) else 0)
        found += np.repeat(first[leaf] - ends + self.size, self.size)
        self.place = np.repeat(self.cell * 2 * TURNS, self.size)
        self.place += np.take(turns, found)
        # The wrong side's probability to the right one's.
        up = np.matmul(self.table, within)
        self.wrong = np.take(np.concatenate([up, -up], axis=2), self.place)
        self.wrong += np.take(odds, found)
        np.minimum(self.wrong, 2 * SAFE, out=self.wrong)
        np.exp(self.wrong, out=self.wrong)

    def log_probabilities(self) -> np.ndarray:
        """Per token of ``at``."""
        total, some = np.zeros(len(self.at)), self.size > 0
        if some.any():
            starts = (np.cumsum(self.size) - self.size)[some]
            total[some] = -np.add.reduceat(np.log(1 + self.wrong), starts)
        return total

    def slopes(self, d_within: np.ndarray, tokens: int) -> np.ndarray:
        """Sets the slope of the mean loss over ``tokens``; returns that of the hidden layers of ``at``."""
        d = np.zeros((*self.table.shape[:2], 2 * TURNS), np.float32)
        off = self.wrong + 1
        np.divide(self.wrong, off, out=off)
        off *= 1 / tokens
        d.reshape(-1)[self.place] = off
        d = d[:, :, :TURNS] - d[:, :, TURNS:]
        np.matmul(self.table.transpose(0, 2, 1), d, out=d_within)
        back = np.matmul(d, self.within[:, :HIDDEN].transpose(0, 2, 1))
        return back.reshape(-1, HIDDEN)[self.cell]


class Trainer:
    """Adam on batches of windows. All weights are views of one array, as are their slopes."""

    def __init__(self, weights: list[np.ndarray]) -> None:
        self.whole = np.concatenate([w.ravel() for w in weights])
        self.weights = views(self.whole)
        self.slope, self.first, self.second = (np.zeros_like(self.whole) for _ in range(3))
        self.slopes = views(self.slope)
        self.steps = 0
        self.held = np.empty(CLASSES * BATCH, np.float32)  # fresh memory for each step would cost page faults

    def step(
        self, line: np.ndarray, at: np.ndarray, rate: float, own: np.ndarray | None = None, leaves: Leaves | None = None
    ) -> None:
        """One batch, the windows around ``at``; with the tokens' ``own`` leaves their ways to these, too."""
        embed, enter, bias, out, out_bias = self.weights[: len(SHAPES)]
        d_embed, d_enter, d_bias, d_out, d_out_bias = self.slopes[: len(SHAPES)]
        # A column per window, so that sums over classes run along memory.
        context = [line[at + k - SIDE] for k in OFFSETS]
        h = hidden([embed @ w for w in enter], bias, context)
        d = class_scores(out, out_bias, h, self.held if len(at) <= BATCH else None)
        np.exp(d, out=d)
        total = d.sum(0)
        # Probabilities less the right classes, times ``total``; what is made of them is divided.
        d[line[at], np.arange(len(at))] -= total
        divided = 1 / (total * len(at))
        d_h = ((out @ d) * ((1 - h[:-1] * h[:-1]) * divided)).T.copy()
        if own is not None:
            turns = Turns(self.weights[-1], leaves, line[at], own, h)
            steep = 1 - h[:-1].T[turns.at] ** 2
            d_h[turns.at] += turns.slopes(self.slopes[-1], len(at)) * steep
        d_embed[:] = 0
        for k, (c, w) in enumerate(zip(context, enter, strict=True)):
            order = np.argsort(c, kind="stable")
            size = np.bincount(c, minlength=CLASSES + 1)
            met = np.flatnonzero(size)
            sums = np.add.reduceat(np.take(d_h, order, axis=0), (np.cumsum(size) - size)[met])  # per class seen
            d_embed[met] += sums @ w.T
            d_enter[k] = embed[met].T @ sums
        d_bias[:] = d_h.sum(0)
        d_both = d @ (h * divided).T
        d_out[:], d_out_bias[:] = d_both[:, :-1].T, d_both[:, -1]
        self.steps += 1
        self.first += 0.1 * (self.slope - self.first)
        self.second += 0.01 * (self.slope * self.slope - self.second)
        move = self.first / (np.sqrt(self.second / (1 - 0.99**self.steps)) + 1e-8)
        self.whole -= move * (rate / (1 - 0.9**self.steps))


def train(rows: DataFrame, rounds: int = ROUNDS, seed: int = 3) -> list[np.ndarray]:
    """The network's weights after ``rounds`` of training by all partitions and averaging."""
    weights = [*initial(seed), np.zeros(WITHIN, np.float32)]
    shared = rows.sparkSession.sparkContext.broadcast(leaves_of(rows))
    for number in range(rounds):
        rate = RATE / (1 + 2 * number)
        start = weights

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trainer, seen, leaves = Trainer(start), 0, shared.value
            for batch in batches:
                line, at, _ = padded(batch.column(0).to_pylist())
                order = np.random.default_rng(len(at)).permutation(len(at))
                at, own = at[order], placed(batch.column(1))[order]
                for low in range(0, len(at), BATCH):
                    trainer.step(line, at[low : low + BATCH], rate, own[low : low + BATCH], leaves)
                seen += len(at)
            if seen:
                total = np.append(trainer.whole.astype(np.float64) * seen, float(seen)).tobytes()
                part = pa.array([TaskContext.get().partitionId()], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([0], pa.int64()), part, pa.array([total], pa.binary())], ["key", "part", "total"]
                )

        parts = rows.select("classes", "leaves").mapInArrow(learn, "key long, part long, total binary")
        found = summed_arrays(parts).collect()  # one row
        if not found:
            break
        total = np.frombuffer(found[0].total)
        weights = views((total[:-1] / total[-1]).astype(np.float32))
    return weights


def scores(
    weights: list[np.ndarray], documents: list[bytes], places: np.ndarray | None = None, leaves: Leaves | None = None
) -> np.ndarray:
    """Summed log-probabilities of the classes of each document given their windows, and of the tokens' leaves
    (``places``) if these are given. Without weights of turns a leaf has its share of its class."""
    embed, enter, bias, out, out_bias = weights[: len(SHAPES)]
    within = weights[-1] if len(weights) > len(SHAPES) else np.zeros(WITHIN, np.float32)
    tables = [embed @ w for w in enter]
    held = np.empty(CLASSES * PIECE, np.float32)
    line, at, owner = padded(documents)
    total = np.zeros(len(documents))
    for low in range(0, len(at), PIECE):
        own = at[low : low + PIECE]
        h = hidden(tables, bias, [line[own + k - SIDE] for k in OFFSETS])
        z = class_scores(out, out_bias, h, held)
        right = z[line[own], np.arange(len(own))]
        np.exp(z, out=z)
        mine = owner[low : low + PIECE]
        found = right - np.log(z.sum(0))
        if places is not None:
            turns = Turns(within, leaves, line[own], places[low : low + PIECE], h)
            found[turns.at] += turns.log_probabilities()
        total[mine[0] : mine[-1] + 1] += np.bincount(mine - mine[0], found)
    return total


def language_scores(documents: DataFrame, rounds: int = ROUNDS, head: int = HEAD) -> DataFrame:
    """Rows ``(doc_id, n_tokens, log_prob, mean_log_prob)``, one per document.

    Null texts and texts without words have 0 tokens, a ``log_prob`` of 0 and a null mean. Longer
    texts are read whole. Repeated rows count and are scored each by itself, alike; of words equally
    frequent those of the smaller name come first. An empty table gives no rows.
    """
    known, others = split_vocabulary(vocabulary(documents), head)
    rows = encoded(documents, known)
    weights = train(rows, rounds)
    shared = rows.sparkSession.sparkContext.broadcast(leaves_of(rows))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("classes").to_pylist(), placed(batch.column("leaves")), shared.value
            total = batch.column("inner").to_numpy() + scores(weights, *own)
            columns = [*(batch.column(c) for c in ("row", "doc_id", "n_tokens")), pa.array(total)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_tokens", "known"])

    found = rows.select("row", "doc_id", "n_tokens", "inner", "classes", "leaves")
    found = found.mapInArrow(scan, "row long, doc_id long, n_tokens long, known double")
    rare = rows.select("row", F.explode("tail").alias("word")).join(others, "word")
    rare = rare.groupBy("row").agg(F.sum(F.log("n")).alias("rare"))
    found = found.join(rare, "row", "left")
    found = found.select("doc_id", "n_tokens", (F.col("known") + F.coalesce("rare", F.lit(0.0))).alias("log_prob"))
    return found.withColumn("mean_log_prob", F.try_divide("log_prob", "n_tokens"))
