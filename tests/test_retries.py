"""Pending revisions as keyed state."""

import os
import time

import pytest
from test_sources import ADDED, coded, response

from palaver.streaming.retries import requests, start_retries


@pytest.fixture
def stream(spark, tmp_path):
    """Send responses in, run to the end of what there is, and stop; the next call is a restart."""

    def arrive(*batches, until=None, **how):
        source = str(tmp_path / "in")
        for responses in batches:
            spark.createDataFrame(list(responses), "xml string").coalesce(1).write.mode("append").parquet(source)
        responses = spark.readStream.schema("xml string").option("maxFilesPerTrigger", 1).parquet(source)
        entries = coded(spark).drop("rev_id")
        query = start_retries(
            responses, entries, str(tmp_path / "out"), str(tmp_path / "ck"), trigger={"processingTime": "200 milliseconds"}, **how
        )
        try:
            # With timers there is always another batch, so wait for what is expected of this run.
            end, seen = time.time() + 40, 0
            while time.time() < end and (seen < len(batches) or (until and not until())):
                assert query.exception() is None
                time.sleep(0.3)
                seen = sum(p.numInputRows > 0 for p in query.recentProgress)
            assert time.time() < end
        finally:
            query.stop()

    return arrive


def test_pending_twice_then_stored_once_over_restarts(spark, tmp_path, stream):
    target = str(tmp_path / "out")

    def events():
        if not os.path.exists(f"{target}/events"):
            return []
        return sorted((r.rev_id, r.event, r.tries) for r in requests(spark, target).collect())

    def stored():
        rows = spark.read.parquet(f"{target}/entries").select("entry.id.rev_id", "entry.content.added").collect()
        return sorted((r.rev_id, bool(r.added)) for r in rows)

    stream([response("T", (1, ADDED), (2, None))], wait=0.5, until=lambda: events())
    assert stored() == [(1, True)] and events() == [(2, "ask", 1)]
    stream([response("T", (2, None))], wait=0.5, until=lambda: len(events()) > 1)
    assert stored() == [(1, True)] and events() == [(2, "ask", 1), (2, "ask", 2)]
    # There at last, twice in a batch, and once more in the next.
    stream([response("T", (2, ADDED)), response("T", (2, ADDED))], [response("T", (2, ADDED))], wait=0.5)
    assert stored() == [(1, True), (2, True)]
    stream([response("T", (2, None), (1, ADDED))], wait=0.5)
    at = time.time()
    stream(wait=0.5, until=lambda: time.time() > at + 5)
    assert stored() == [(1, True), (2, True)] and len(events()) == 2


def test_given_up_after_too_many(spark, tmp_path, stream):
    target = str(tmp_path / "out")
    stream(*[[response("T", (2, None))]] * 4, wait=3600, most=2)
    assert [(r.rev_id, r.event, r.tries) for r in requests(spark, target).collect()] == [(2, "given up", 3)]
    assert spark.read.parquet(f"{target}/entries").count() == 0
