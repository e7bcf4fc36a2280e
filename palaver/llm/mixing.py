"""Mixing sources to target weights along a curriculum that changes over training.

Native DataFrame operations only. A source's target is its share of all words by weight, at most
``MOST`` times what it has, the excess shared out again. Its documents form a stream in hashed order,
read over and over until the target is met, the last document in part. A schedule says how the
source's demand changes over training time 0 to 1; integrated it gives the words demanded up to a
time, and inverted the time at which a word of the stream is due: the document's position.

Offsets within a stream are running sums over the hash's leading bits, in two levels, and within a
bucket of equal leading bits, so a source with a third of all rows is spread over its buckets.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.session import written

WEIGHTS = (5, 2, 1)
MOST = 3
#: Demand over training time by weight, as (time, demand) joined by lines; the scale has no effect.
SCHEDULES = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 0.5), (1.0, 2.0)),
)
#: Documents that share all leading bits, about.
BUCKET_ROWS = 2048
#: Bits of the hash that orders a source's documents; any SQL engine can compute it.
ORDER_BITS = 60
WORD = r"[^\x20\x09-\x0D]+"


def word_count(column: str = "text") -> Column:
    return F.regexp_count(F.coalesce(column, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Rows ``(sid, source, words, weight, target)`` from ``sizes (source, size)``.

    Sources are numbered by code point, null last, and take the weights in turn. With sources in the
    order in which they reach their limit, the level at which the rest share is the greatest of
    "what is left after the limits of those before, per weight left". Works on one row per source.
    """
    found = sizes.groupBy("source").agg(F.sum("size").alias("words"))
    number = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    found = found.withColumn("sid", number)
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("sid") % len(weights) + 1)
    found = found.withColumn("weight", weight.cast("double")).withColumn("limit", most * F.col("words"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), "sid")
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    found = found.withColumn("level", (F.sum("words").over(everything) - before) / left)
    target = F.least(F.col("limit").cast("double"), F.col("weight") * F.max("level").over(everything))
    return found.select("sid", "source", "words", "weight", target.alias("target"))


def due(share: Column, schedule: Sequence[tuple[float, float]]) -> Column:
    """The time by which ``share`` of a source's demand has come up under ``schedule``."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False)]
    asked, time, done = share * sum(areas), F.lit(schedule[-1][0]), sum(areas)
    for ((t0, w0), (t1, w1)), area in reversed(list(zip(zip(schedule, schedule[1:], strict=False), areas, strict=True))):
        done -= area
        rest = F.greatest(asked - done, F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + rest * (2 * (w1 - w0) / (t1 - t0)), F.lit(0.0)))
        within = F.least(F.lit(t1), F.lit(t0) + F.when(rest > 0, 2 * rest / (root + w0)).otherwise(0.0))
        time = F.when(asked < done + area, within).otherwise(time)
    return time


def mix(
    documents: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    seed: int = 5,
    carry: bool = False,
) -> DataFrame:
    """Rows ``(doc_id, size, source_size, target, taken, positions)``, one per document.

    ``taken`` counts the words the mix takes, repeats included; ``positions`` has one training time
    per pass over the document, in order. A null text has size 0 and is taken 0 times; a null source
    is a source. Rows alike in id and size are interchangeable. With ``carry`` all columns of the
    documents come in one struct ``__doc`` and the new ones in another, ``__mix``.
    An empty table gives none.
    """
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    # Rows without an id are told apart by their text.
    name = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    key = F.concat_ws(":", F.lit(str(seed)), name)
    order = F.conv(F.substring(F.md5(key), 1, ORDER_BITS // 4), 16, 10).cast("long").alias("__order")
    sizes = written(documents.select(doc_id, "source", word_count().alias("size"), order), "sizes")
    sources = written(source_targets(sizes, weights, most), "sources").withColumnRenamed("source", "__source")
    bits = max(2, min(40, math.ceil(math.log2(max(1, sizes.count()) / BUCKET_ROWS))))

    def placed(rows: DataFrame) -> DataFrame:
        rows = rows.join(sources, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
        rows = rows.withColumn("__bucket", F.shiftright("__order", ORDER_BITS - bits))
        return rows.withColumn("__top", F.shiftright("__order", ORDER_BITS - bits // 2))

    def running(*keys: str) -> Window:
        return Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)

    def sum_before(column: str, window: Window) -> Column:
        return F.coalesce(F.sum(column).over(window), F.lit(0))

    buckets = placed(sizes).groupBy("sid", "__top", "__bucket").agg(F.sum("size").alias("size"))
    buckets = written(buckets, "buckets")
    tops = buckets.groupBy("sid", "__top").agg(F.sum("size").alias("size"))
    tops = tops.select("sid", "__top", sum_before("size", running("sid").orderBy("__top")).alias("__high"))
    within = sum_before("size", running("sid", "__top").orderBy("__bucket"))
    starts = buckets.withColumn("__low", within).join(tops, ["sid", "__top"])
    starts = written(starts.select("sid", "__bucket", (F.col("__low") + F.col("__high")).alias("__start")), "starts")

    # The documents travel in one struct, so that none of their names can meet one of these.
    whole = documents.select(F.struct(*documents.columns).alias("__doc"), doc_id, "source", word_count().alias("__size"), order)
    rows = placed(whole if carry else sizes.withColumnRenamed("size", "__size"))
    rows = rows.join(starts, ["sid", "__bucket"])
    order = running("sid", "__bucket").orderBy("__order", "doc_id", "__size")
    rows = rows.withColumn("__at", F.col("__start") + sum_before("__size", order))
    passes = F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words"))).otherwise(0)
    rest = F.round(F.col("target") - passes * F.col("words")).cast("long")
    part = F.greatest(F.lit(0), F.least(rest - F.col("__at"), F.col("__size")))
    taken = F.when(F.col("__size") > 0, passes * F.col("__size") + part).otherwise(0).cast("long")
    rows = rows.withColumn("__passes", passes).withColumn("__part", part).withColumn("__taken", taken)
    last = F.col("__passes") - F.when(F.col("__part") > 0, 0).otherwise(1)

    def position(number: Column) -> Column:
        share = (number * F.col("words") + F.col("__at")) / F.col("target")
        time = F.lit(None).cast("double")
        for k, schedule in enumerate(schedules):
            time = F.when(F.col("sid") % len(schedules) == k, due(share, schedule)).otherwise(time)
        return time

    positions = F.when(
        F.col("__taken") > 0, F.transform(F.sequence(F.lit(0).cast("long"), last), position)
    )
    new = {
        "size": F.col("__size"),
        "source_size": F.col("words"),
        "target": F.col("target"),
        "taken": F.col("__taken"),
        "positions": positions,
    }
    if carry:
        packed = F.struct(*(c.alias(k) for k, c in new.items())).alias("__mix")
        return rows.select("__doc", "doc_id", packed)
    return rows.select("doc_id", *(c.alias(k) for k, c in new.items()))


def mixing_plan(documents: DataFrame, **how) -> DataFrame:
    """``mix`` with ``position``, the first of a document, range-sorted by it; what is not taken last."""
    rows = mix(documents, **how).withColumn("position", F.try_element_at("positions", F.lit(1)))
    return rows.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mixed_documents(documents: DataFrame, **how) -> DataFrame:
    """The documents as the mix takes them, all columns, one row per pass, in order of position.

    The last pass over a document may take only its first words; its text and ``n_chars`` are cut then. A
    null or empty text is never taken. Repeated rows are taken each by itself. Columns may have any names.
    """
    rows = mix(documents, carry=True, **how).where("__mix.taken > 0")
    number = F.posexplode("__mix.positions").alias("__pass", "__position")
    rows = rows.select("*", number)
    words = F.least(F.col("__mix.size"), F.col("__mix.taken") - F.col("__pass") * F.col("__mix.size"))
    text = F.col("__doc")["text"]
    # Pieces are a word with the blanks before it; only the few documents cut are split.
    pieces = F.slice(F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), F.lit(1), words.cast("int"))
    cut = words < F.col("__mix.size")
    text = F.when(cut, F.array_join(pieces, "")).otherwise(text)
    new = {"text": text}
    if "n_chars" in documents.columns:
        length = F.length(text).cast(documents.schema["n_chars"].dataType)
        new["n_chars"] = F.when(cut, length).otherwise(F.col("__doc")["n_chars"])
    rows = rows.orderBy("__position", "doc_id")
    return rows.select(*(new.get(c, F.col("__doc")[c]).alias(c) for c in documents.columns))
