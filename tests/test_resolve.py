import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from palaver.operators.resolve import resolve, resolve_registered_and_anonymous

START = datetime(2011, 3, 1)


def by_hand(log, revs, window, unique):
    out = {}
    for i, actor, ts in log:
        hits = sorted(
            (r[1], r[2]) for r in revs
            if r[0] == actor and abs((r[1] - ts).total_seconds()) <= window
        )
        out[i] = hits[0][1] if hits and (len(hits) == 1 or not unique) else None
    return out


def tables(spark, log, revs, kind):
    return (
        spark.createDataFrame(log, f"id int, who int, ts {kind}"),
        spark.createDataFrame(revs, f"actor int, ts {kind}, rev_id int"),
    )


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
@pytest.mark.parametrize("window,span", [(10, 400), (10, 100_000), (3600, 90_000), (0, 60)])
def test_equals_brute_force_with_a_hot_actor(spark, kind, window, span):
    rnd = random.Random(window + span)

    def when(whole):
        s = rnd.randrange(span) if whole else rnd.random() * span
        return START + timedelta(seconds=s)

    def actor():
        return 1 if rnd.random() < 0.5 else rnd.randrange(2, 8)

    log = [(i, actor(), when(i % 2)) for i in range(150)]
    revs = [(actor(), when(i % 2), i) for i in range(120)]
    left, right = tables(spark, log, revs, kind)
    for unique in (True, False):
        found = resolve(left, right, "who", "ts", window, unique)
        assert {r["id"]: r["rev_id"] for r in found.collect()} == by_hand(log, revs, window, unique)
        kinds = [F.lit(min(t for *_, t in log)), F.lit(max(t for *_, t in log))]
        period = tuple(k.cast(kind) for k in kinds)
        timed = resolve(left, right, "who", "ts", window, unique, period=period)
        assert {r["id"]: r["rev_id"] for r in timed.collect()} == by_hand(log, revs, window, unique)


def test_both_ends_count_and_rows_are_kept(spark):
    at = START + timedelta(seconds=1000)
    log = [(1, 1, at), (1, 1, at), (2, 2, at), (3, 3, at), (4, None, at)]
    revs = [(1, at - timedelta(seconds=10), 7), (2, at + timedelta(seconds=10), 8),
            (2, at + timedelta(seconds=11), 9), (3, at, 4), (3, at, 5)]
    left, right = tables(spark, log, revs, "timestamp_ntz")
    found = sorted((r["id"], r["rev_id"]) for r in
                   resolve(left, right, "who", "ts", 10).select("id", F.coalesce("rev_id", F.lit(-1))
                                                              .alias("rev_id")).collect())
    assert found == [(1, 7), (1, 7), (2, 8), (3, -1), (4, -1)]


@pytest.mark.parametrize("chunk", [20, 21, 33, 1000])
def test_chunk_width_does_not_matter(spark, chunk):
    rnd = random.Random(chunk)
    log = [(i, 1, START + timedelta(seconds=rnd.randrange(500))) for i in range(80)]
    revs = [(1, START + timedelta(seconds=rnd.randrange(500)), i) for i in range(30)]
    left, right = tables(spark, log, revs, "timestamp_ntz")
    found = resolve(left, right, "who", "ts", 10, chunk_seconds=chunk)
    assert {r["id"]: r["rev_id"] for r in found.collect()} == by_hand(log, revs, 10, True)


def test_anonymous_actors_go_by_text(spark):
    log = spark.createDataFrame(
        [(1, 0, "1.2.3.4", START), (2, 5, "Ann", START), (3, 0, "9.9.9.9", START)],
        "id int, uid int, name string, ts timestamp_ntz")
    revs = spark.createDataFrame(
        [(0, "1.2.3.4", START, 11), (5, "Ann", START, 12)],
        "user_id int, user_text string, ts timestamp_ntz, rev_id int")
    found = resolve_registered_and_anonymous(log, revs, "uid", "name", "ts")
    assert {r["id"]: r["rev_id"] for r in found.collect()} == {1: 11, 2: 12, 3: None}


def test_the_period_reaches_the_scan_of_the_revisions(spark, tmp_path):
    at = START + timedelta(seconds=1000)
    left, right = tables(spark, [(1, 1, at)], [(1, at, 7)], "timestamp_ntz")
    right.write.parquet(str(tmp_path / "rev"))
    stored = spark.read.parquet(str(tmp_path / "rev"))
    period = (F.lit(at).cast("timestamp_ntz"), F.lit(at).cast("timestamp_ntz"))
    found = resolve(left, stored, "who", "ts", 10, period=period)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts," in plan and "LessThanOrEqual(ts," in plan
    assert [r["rev_id"] for r in found.collect()] == [7]
