"""Quality classifier: ridge regression on random Fourier features, calibrated by isotonic regression.

Each text becomes a few statistics of its bytes, words and lines. Random cosines of them approximate
a Gaussian kernel; the ridge weights come from normal equations that every partition sums on its own
and a tree adds up. The equations are kept per fold, so scores for the calibration come from weights
that have not seen the row. All labelled rows are used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import summed_arrays, utf8
from palaver.session import written

#: Shares of bytes in these sets are statistics, along with those of letters, digits and so on.
SIGNS = (b"#$%&*^~=", b"!?", b"|", b"<>{}[]\\/", b".,;:", b"'\"()-", b"@+_")
COSINES = 256
RIDGE = 1e-3
FOLDS = 3
#: Raw scores are counted in bins of 1/1000 for the calibration, ends taking what lies beyond.
BINS = (-500, 1500)


def _byte_sets() -> np.ndarray:
    sets = np.zeros((256, 7 + len(SIGNS)), np.float32)
    for k, (low, high) in enumerate(((97, 122), (65, 90), (48, 57), (32, 32), (10, 10), (0, 31), (128, 255))):
        sets[low : high + 1, k] = 1
    for k, signs in enumerate(SIGNS, 7):
        sets[list(signs), k] = 1
    return sets


BYTE_SETS = _byte_sets()
STATISTICS = BYTE_SETS.shape[1] + 12


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of ``STATISTICS`` numbers per text; all zero for an empty text."""
    out = np.zeros((len(texts), STATISTICS), np.float32)
    for row, text in zip(out, texts, strict=True):
        if not text:
            continue
        counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256).astype(np.float32)
        size = len(text)
        share = counts[counts > 0] / size
        row[: BYTE_SETS.shape[1]] = counts @ BYTE_SETS / size
        words = text.split()
        lines = text.split(b"\n")
        count = max(1, len(words))
        word_sizes = np.fromiter(map(len, words), np.float32, len(words))
        spread = word_sizes.std() if len(words) else 0.0
        kinds = len(set(words))
        row[BYTE_SETS.shape[1] :] = (
            np.log1p(size),
            np.log1p(len(words)),
            size / count,
            spread,
            kinds / count,
            np.log1p(kinds),
            np.log1p(len(lines)),
            len(set(lines)) / len(lines),
            np.log1p(size / len(lines)),
            -(share * np.log2(share)).sum(),
            sum(w[-1] in b"#$%&*|!" for w in words) / count,
            sum(w.isupper() for w in words) / count,
        )
    return out


def text_statistics(documents: DataFrame) -> DataFrame:
    """Rows ``(doc_id, x)`` for all documents, the order of rows being of no meaning."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(1).to_pylist())
            offsets = np.arange(0, x.size + 1, STATISTICS, dtype=np.int32)
            rows = pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), rows], ["doc_id", "x"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), utf8())
    return rows.mapInArrow(scan, "doc_id long, x array<float>")


@dataclass(frozen=True)
class Model:
    """Weights per left-out fold, the last for none; the calibration maps raw scores by interpolation."""

    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    raw: np.ndarray
    score: np.ndarray

    def cosines(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        z = np.cos(z @ self.waves + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([z, np.ones((len(x), 1))])

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.cosines(x) @ self.weights[-1], self.raw, self.score)


def matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    values = batch.column(column)
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def isotonic(raw: np.ndarray, good: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool neighbours that are out of order; the mean raw score and label mean of each pool."""
    pools: list[list[float]] = []
    for x, y, n in zip(raw, good, count, strict=True):
        pools.append([x * n, y, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    sums = np.array(pools)
    return sums[:, 0] / sums[:, 2], sums[:, 1] / sums[:, 2]


def fit(x: DataFrame, labels: DataFrame, cosines: int = COSINES, ridge: float = RIDGE, seed: int = 7) -> Model:
    """Fit on ``x (doc_id, x)`` joined with ``labels (doc_id, label)``.

    Rows with a null label or id are left out; several labels of an id count as their mean. Without
    any labelled row every text scores 0.5.
    """
    labels = labels.where("label is not null").groupBy("doc_id").agg(F.avg("label").alias("y"))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")
    rows = written(x.join(labels, "doc_id").select("x", "y", fold.alias("fold")), "labelled")

    moments = [F.avg(F.col("x")[k]) for k in range(STATISTICS)] + [F.stddev_pop(F.col("x")[k]) for k in range(STATISTICS)]
    found = rows.agg(F.count("*"), *moments).collect()[0]
    rng = np.random.default_rng(seed)
    waves = rng.normal(size=(STATISTICS, cosines)) / np.sqrt(STATISTICS)
    phases = rng.uniform(0, 2 * np.pi, cosines)
    if not found[0]:
        none = np.zeros((FOLDS + 1, cosines + 1))
        return Model(np.zeros(STATISTICS), np.ones(STATISTICS), waves, phases, none, np.zeros(1), np.full(1, 0.5))
    values = np.array(found[1:], np.float64)
    scale = values[STATISTICS:]
    model = Model(values[:STATISTICS], np.where(scale > 1e-9, scale, 1.0), waves, phases, None, None, None)

    size = cosines + 1

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((FOLDS, size + 2, size))  # the matrix, the right side, the number of rows
        for batch in batches:
            z, y = model.cosines(matrix(batch, "x")), batch.column("y").to_numpy()
            folds = batch.column("fold").to_numpy()
            for k in range(FOLDS):
                own = z[folds == k]
                sums[k, :size] += own.T @ own
                sums[k, size] += y[folds == k] @ own
                sums[k, size + 1] += len(own)
        columns = [np.arange(FOLDS), np.full(FOLDS, TaskContext.get().partitionId()), [s.tobytes() for s in sums]]
        kinds = (pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "part", "total"]
        )

    parts = rows.mapInArrow(equations, "key long, part long, total binary")
    sums = np.zeros((FOLDS, size + 2, size))
    for row in summed_arrays(parts).collect():  # one per fold
        sums[row.key] = np.frombuffer(row.total).reshape(size + 2, size)

    def solve(total: np.ndarray) -> np.ndarray:
        penalty = ridge * max(1.0, total[size + 1, 0]) * np.eye(size)
        penalty[-1, -1] = 1e-9
        return np.linalg.solve(total[:size] + penalty, total[size])

    whole = sums.sum(0)
    weights = np.array([solve(whole - own) for own in sums] + [solve(whole)])

    def unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, folds = model.cosines(matrix(batch, "x")), batch.column("fold").to_numpy()
            bins = np.clip(np.rint((z * weights[folds]).sum(1) * 1000), *BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column("y")], ["bin", "y"])

    bins = rows.mapInArrow(unseen, "bin int, y double").groupBy("bin").agg(F.sum("y"), F.count("*"))
    raw, good, count = np.array(sorted(map(tuple, bins.collect())), np.float64).T  # at most as many as bins
    raw, score = isotonic(raw / 1000, good, count)
    return Model(model.mean, model.scale, waves, phases, weights, raw, score)


def held_out(column: str = "doc_id") -> Column:
    """True for one id in five, by its checksum; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(False))


def training_labels(labels: DataFrame) -> DataFrame:
    rows = labels.where(~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    return rows.withColumnRenamed("quality", "label")


def score_quality(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Rows ``(doc_id, held_out, score, predicted)``, one per document, null and empty texts too.

    Only labels of ids not held out are learned from. Inputs of a score are the text's statistics.
    """
    x = written(text_statistics(documents), "statistics")
    model = fit(x, training_labels(labels))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array(model.scores(matrix(batch, "x")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), scores], ["doc_id", "score"])

    rows = x.mapInArrow(scan, "doc_id long, score double")
    predicted = (F.col("score") >= threshold).cast("int")
    return rows.select("doc_id", held_out().alias("held_out"), "score", predicted.alias("predicted"))


def keep_quality(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents, all columns, that score ``threshold`` or more; no row is shuffled."""
    model = fit(text_statistics(documents), training_labels(labels))
    at = documents.columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).fill_null(b"").to_pylist()
            yield batch.filter(pa.array(model.scores(statistics(texts)) >= threshold))

    return documents.mapInArrow(scan, documents.schema)
