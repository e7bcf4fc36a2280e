"""Pending revisions as keyed state: asked for again after a wait that doubles, stored once when they come.

The state of a revision is how often it came back pending, with a timer for the next request. Nothing that was
written before is read again: a restarted stream goes on from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from palaver.operators.entries import attach_revisions
from palaver.sources.revisions import revision_rows

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
KEYED = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

FIELDS = ("title", "sender", "comment", "timestamp", "size", "diff")
REVISION = "title string, sender string, comment string, timestamp timestamp, size int, diff string"
EVENTS = f"rev_id long, event string, tries int, {REVISION}"

#: What may be said of a revision: it is there, is to be asked for again, or was pending too often.
STORED, ASK, GIVEN_UP = "stored", "ask", "given up"


class Retries(StatefulProcessor):
    def __init__(self, wait_ms: int, most: int, remember_ms: int | None) -> None:
        self.wait_ms, self.most, self.remember_ms = wait_ms, most, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tries = handle.getValueState("tries", "n int")
        self.done = handle.getValueState("done", "n int", self.remember_ms)

    def event(self, key: tuple, event: str, tries: int, revision: Row | None = None) -> Row:
        values = [revision[f] if revision else None for f in FIELDS]
        return Row("rev_id", "event", "tries", *FIELDS)(key[0], event, tries, *values)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        newest, order, pending = None, None, 0
        for row in rows:  # one at a time; only the newest is held
            if row.pending:
                pending += 1
                continue
            own = [(v is not None, v) for v in (row.timestamp, row.size, row.diff)]
            if newest is None or own > order:
                newest, order = row, own
        if self.done.exists():
            return
        tries = self.tries.get()[0] if self.tries.exists() else 0
        if newest is None:
            tries += pending
        over = newest is None and tries > self.most
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if newest is not None or over:
            self.tries.clear()
            self.done.update((tries,))
            yield self.event(key, GIVEN_UP if over else STORED, tries, newest)
            return
        self.tries.update((tries,))
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms * 2 ** (tries - 1))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.tries.exists():
            yield self.event(key, ASK, self.tries.get()[0])

    def close(self) -> None:
        pass


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Within it the session's queries keep state in RocksDB, which state with timers needs."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, KEYED)
    _ = spark.streams  # asking for it starts what keeps track of state, which a query over a table does not
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def retry_events(
    revisions: DataFrame, wait: float = 60.0, most: int = 5, remember: float | None = None
) -> DataFrame:
    """Events ``(rev_id, event, tries, revision fields)`` from a stream of ``revision_rows``.

    ``stored`` comes once per revision, with the newest of the answers in a micro-batch that are there; later
    answers are ignored for ``remember`` seconds (without end if not given). ``ask`` comes ``wait`` seconds after
    a pending answer, twice as late after each further one, and ``given up`` once there are more than ``most``
    pending answers; ``tries`` counts these. Rows without an id are dropped. The state of a revision is a number
    and a timer, whatever the number of answers. Needs the RocksDB state store, see ``keyed_state``. A table in
    place of a stream gives the events that its rows, taken as one micro-batch, lead to.
    """
    keyed = revisions.where("rev_id is not null").select("rev_id", "pending", *FIELDS).groupBy("rev_id")
    remember_ms = None if remember is None else int(remember * 1000)
    processor = Retries(int(wait * 1000), most, remember_ms)
    return keyed.transformWithState(processor, EVENTS, "Append", "ProcessingTime")


def start_retries(
    responses: DataFrame,
    entries: DataFrame,
    target: str,
    checkpoint: str,
    column: str = "xml",
    wait: float = 60.0,
    most: int = 5,
    remember: float | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start a stream from revision XML to ``target``; ``entries`` is the static coded table.

    ``target/entries`` gets entries as their revisions come, ``target/events`` what is to be asked for again and
    what was given up. A micro-batch writes folders of its own in overwrite mode, so that one run again after
    a failure stores nothing twice. ``trigger`` is that of ``DataStreamWriter.trigger``; by default the
    stream runs on, a batch a second, as timers go off without input too.
    """
    spark = responses.sparkSession
    events = retry_events(revision_rows(responses, column), wait, most, remember)

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            ready = batch.where(F.col("event") == STORED)
            wanted = entries.join(ready.select("rev_id"), F.col("entry.id.rev_id") == F.col("rev_id"), "left_semi")
            attach_revisions(wanted, ready).write.mode("overwrite").parquet(f"{target}/entries/batch={number}")
            others = batch.where(F.col("event") != STORED).select("rev_id", "event", "tries")
            others.write.mode("overwrite").parquet(f"{target}/events/batch={number}")
        finally:
            batch.unpersist()

    with keyed_state(spark):  # a started query keeps the settings it began with
        writer = events.writeStream.foreachBatch(write).outputMode("append")
        writer = writer.option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()


def requests(spark: SparkSession, target: str) -> DataFrame:
    """All that was to be asked for again or given up, ``(batch, rev_id, event, tries)``."""
    return spark.read.parquet(f"{target}/events").select("batch", "rev_id", "event", "tries")
