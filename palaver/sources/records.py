"""Delimited files whose quoted cells may hold line breaks, read by many tasks a file.

Every line is read by the task of its byte range. Whether it starts inside a quoted cell depends on
all lines before it, so each line is taken as a function of that state: it may keep it, turn it, or
set it whatever it was. One pass composes the functions along each range; the few ranges of a file are
composed along the file; a second pass, which knows the state each range is entered in, puts its lines
together to records. No line is shuffled but those of records that cross ranges, and no file is read as
a whole by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RANGE = ["file", "start"]


def read_records(spark: SparkSession, paths: str | list[str], delimiter: str = ",") -> DataFrame:
    """``record``, as it stands in its file, and ``is_first`` (the file's first record).

    A quote opens a quoted cell at the beginning of a cell only, and is doubled inside. Line ends are
    LF, CR LF or CR; those inside quoted cells are kept. Blank records are left out. A cell that is
    never closed goes on to the end of its file. No file or an empty one gives no records. A file
    whose line ends are all CR, or that is compressed as a whole, is one task.

    The files are read three times: for the states, for the records of one range, and for those that
    cross ranges. A task holds a batch of lines and one record; the states of all ranges, a few
    numbers each, go to every task. Only records that cross from one range to the next are shuffled.
    """
    lines = _lines(spark, paths, delimiter)
    pieces = _pieces(lines, _ranges(lines))
    crossing = pieces.where("crosses").groupBy("key").agg(
        _joined("start", "piece").alias("piece"), F.first("first_id").alias("first_id"))
    columns = ["key", "piece", "first_id"]
    records = pieces.where("not crosses").select(*columns).unionByName(crossing.select(*columns))
    bare = F.regexp_replace("piece", r"\r\z", "")
    # Lone carriage returns outside of quoted cells end a record, too.
    parts = F.when(F.contains(bare, F.lit("\r")), _at_returns(bare, delimiter)).otherwise(F.array(bare))
    split = records.select("key", "first_id", F.posexplode(parts).alias("part", "record"))
    is_first = (F.col("key") == F.col("first_id")) & (F.col("part") == 0)
    return split.select("record", is_first.alias("is_first")).where("record <> ''")


def _lines(spark: SparkSession, paths: str | list[str], delimiter: str) -> DataFrame:
    """Lines with their file, the start of their byte range, an id that ascends along a range, and the state
    after each line for both states before it (1: inside a quoted cell)."""
    read = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("id"), "value",
    )
    quoted = F.contains("value", F.lit('"'))
    return read.select(
        "*",
        _opens(F.col("value"), delimiter).alias("to0"),
        # A line inside a quoted cell reads like one that opens a cell itself.
        F.when(quoted, _opens(F.concat(F.lit('"'), "value"), delimiter)).otherwise(1).alias("to1"),
    )


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """The parts of a batch that lie in one range, with the range."""
    if not batch.num_rows:
        return
    file, start = batch.column("file"), batch.column("start")
    other = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(start[1:], start[:-1]))
    ends = [0, *(np.flatnonzero(other.to_numpy(zero_copy_only=False)) + 1).tolist(), batch.num_rows]
    for low, high in zip(ends, ends[1:]):
        yield (file[low].as_py(), start[low].as_py()), batch.slice(low, high - low)


def _states(part: pa.RecordBatch, at: int) -> np.ndarray:
    """The state before each line and, as the last element, after all of them, if it is ``at`` before the first."""
    to0, to1 = (part.column(c).to_numpy(zero_copy_only=False) for c in ("to0", "to1"))
    turns = np.cumsum((to0 == 1) & (to1 == 0)) & 1
    sets = to0 == to1
    # The latest line that sets the state, whatever it was.
    latest = np.maximum.accumulate(np.where(sets, np.arange(len(sets)), -1))
    based = np.where(latest < 0, at, to0[latest] ^ turns[latest])
    return np.concatenate([[at], based ^ turns])


def _pieces(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """``(key, start, piece, crosses, first_id)``: the lines of a record that lie in one range, put together. ``key`` is
    the record's first line; ``crosses`` says that the record goes on from an earlier range or into the next."""
    names = ["key", "start", "piece", "crosses", "first_id"]
    # A row per range: bounded by the files' bytes over those of a range.
    known = {(r["file"], r["start"]): (r["enters"], r["carried"], r["goes_on"], r["first_id"]) for r in ranges.collect()}
    shared = lines.sparkSession.sparkContext.broadcast(known)

    def out(place: tuple, keys: pa.Array, pieces: pa.Array, crosses: bool) -> pa.RecordBatch:
        size = len(keys)
        first = shared.value[place][3]
        return pa.RecordBatch.from_arrays([
            keys.cast(pa.int64()), pa.array(np.full(size, place[1], np.int64)), pieces.cast(pa.string()),
            pa.array(np.full(size, crosses)), pa.array([first] * size, pa.int64()),
        ], names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, state, key, held, carried = None, 0, None, [], False

        def last(crosses: bool) -> pa.RecordBatch:
            text = held[0] if len(held) == 1 else "\n".join(held)
            return out(place, pa.array([key], pa.int64()), pa.array([text], pa.string()), crosses)

        for batch in batches:
            for at, part in _stretches(batch):
                if at != place:
                    if held:
                        yield last(carried or shared.value[place][2])
                    place, (state, key, _, _) = at, shared.value[at]
                    held, carried = [], True
                before = _states(part, state)
                state = int(before[-1])
                begins = np.flatnonzero(before[:-1] == 0)
                values, ids = part.column("value"), part.column("id")
                if not len(begins):
                    held.append("\n".join(values.to_pylist()))
                    continue
                if begins[0]:
                    held.append("\n".join(values[: begins[0]].to_pylist()))
                if held:
                    yield last(carried)
                # All records of these lines but the last, which may go on in the next batch.
                if len(begins) > 1:
                    inner = values.slice(begins[0], begins[-1] - begins[0]).cast(pa.string())
                    grouped = pa.ListArray.from_arrays(pa.array(begins - begins[0], pa.int32()), inner)
                    yield out(place, ids.take(pa.array(begins[:-1])), pc.binary_join(grouped, "\n"), False)
                key, held, carried = ids[int(begins[-1])].as_py(), ["\n".join(values[begins[-1]:].to_pylist())], False
        if held:
            yield last(carried or shared.value[place][2])

    columns = lines.select("file", "start", "id", "value", "to0", "to1")
    return columns.mapInArrow(scan, "key long, start long, piece string, crosses boolean, first_id long")


def cell_pattern(delimiter: str) -> str:
    """A complete cell, quotes included. Possessive, so no text is walked twice and long ones need no stack."""
    sign = "\\" + delimiter
    return f'(?:"(?:[^"]++|"")*+"[^{sign}]*+|[^"{sign}][^{sign}]*+|)'


def _opens(line: Column, delimiter: str) -> Column:
    """1 if a line that starts outside of quoted cells ends inside one."""
    sign = "\\" + delimiter
    unclosed = rf'(?s)\A(?:{cell_pattern(delimiter)}{sign})*+"(?:[^"]++|"")*+\z'
    return F.when(F.contains(line, F.lit('"')), line.rlike(unclosed).cast("int")).otherwise(0)


def _at_returns(record: Column, delimiter: str) -> Column:
    """The records between lone carriage returns outside of quoted cells; blank ones vanish."""
    sign = "\\" + delimiter
    cell = f'(?:"(?:[^"]++|"")*+"[^{sign}\\r]*+|[^"{sign}\\r][^{sign}\\r]*+|"(?:[^"]++|"")*+\\z|)'
    return F.regexp_extract_all(record, F.lit(f"(?s)((?=[^\\r]){cell}(?:{sign}{cell})*+)"), F.lit(1))


def _running(order: str, keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def _along(rows: DataFrame, order: str, keys: list[str]) -> DataFrame:
    """``rows`` (functions ``to0``, ``to1``) with ``after0``, ``after1``: the state after each row if the first
    row of its group starts at 0 or 1; and likewise ``before0``, ``before1``."""
    running = _running(order, keys)
    turns = (F.sum(F.when((F.col("to0") == 1) & (F.col("to1") == 0), 1).otherwise(0)).over(running) % 2).cast("int")
    turned = rows.withColumn("_turns", turns)
    # The latest row that sets the state, as the state the group would have started with.
    sets = F.when(F.col("to0") == F.col("to1"), F.col("to0").bitwiseXOR(F.col("_turns")))
    reset = turned.withColumn("_set", F.last(sets, ignorenulls=True).over(running))
    before = Window.partitionBy(*keys).orderBy(order)
    for state in (0, 1):
        after = F.coalesce(F.col("_set"), F.lit(state)).bitwiseXOR(F.col("_turns"))
        reset = reset.withColumn(f"after{state}", after)
        reset = reset.withColumn(f"before{state}", F.lag(f"after{state}", 1, state).over(before))
    return reset.drop("_turns", "_set")


def _ranges(lines: DataFrame) -> DataFrame:
    """One row per range that holds lines: the state it is entered with (``enters``), whether its last record
    goes on (``goes_on``), the line that began it (``tail``), the line that began the record it is entered in
    (``carried``) and the file's first line that is not blank (``first_id``)."""
    size = F.length(F.regexp_replace("value", r"\r", ""))
    flags = lines.select(*RANGE, "id", "to0", "to1", (size > 0).alias("filled"))
    names = [*RANGE, "to0", "to1", "tail0", "tail1", "first_line"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, found = None, [0, 1, None, None, None]

        def row() -> pa.RecordBatch:
            types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 3]
            cells = [pa.array([x], t) for x, t in zip([*place, *found], types, strict=True)]
            return pa.RecordBatch.from_arrays(cells, names)

        for batch in batches:
            for at, part in _stretches(batch):
                if at != place:
                    if place is not None:
                        yield row()
                    place, found = at, [0, 1, None, None, None]
                ids = part.column("id").to_numpy()
                for entered in (0, 1):
                    before = _states(part, found[entered])
                    outside = np.flatnonzero(before[:-1] == 0)
                    found[entered] = int(before[-1])
                    if len(outside):
                        found[2 + entered] = int(ids[outside[-1]])
                filled = np.flatnonzero(part.column("filled").to_numpy(zero_copy_only=False))
                if found[4] is None and len(filled):
                    found[4] = int(ids[filled[0]])
        if place is not None:
            yield row()

    ranges = flags.mapInArrow(
        scan, "file string, start long, to0 int, to1 int, tail0 long, tail1 long, first_line long")
    placed = _along(ranges, "start", ["file"])
    tail = F.when(F.col("before0") == 0, F.col("tail0")).otherwise(F.col("tail1"))
    earlier = _running("start", ["file"]).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file").orderBy("start").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    return placed.withColumn("tail", tail).select(
        *RANGE, F.col("before0").alias("enters"), (F.col("after0") == 1).alias("goes_on"), "tail",
        F.last("tail", ignorenulls=True).over(earlier).alias("carried"),
        F.first("first_line", ignorenulls=True).over(whole).alias("first_id"),
    )


def _joined(order: str, text: str) -> Column:
    """Pieces in their order, with the line breaks between them put back."""
    ordered = F.array_sort(F.collect_list(F.struct(order, F.col(text).alias("text"))))
    return F.array_join(F.transform(ordered, lambda p: p["text"]), "\n")
