"""Interaction log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.operators import filters, joins, ranking, resolve
from palaver.plans import extracts
from palaver.streaming.trailing import trailing_window
from palaver.workload import inputs as inp
from palaver.workload.registry import query


@query("filter_time_range", """
SELECT event_id, ts FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'""")
def filter_time_range(spark, sf_dir):
    rows = inp.table(spark, sf_dir, "events").select("event_id", "ts")
    lo, hi = (
        F.lit(x).cast("timestamp_ntz") for x in ("2024-01-10 00:00:00", "2024-01-20 12:00:00")
    )
    return filters.time_range(rows, "ts", lo, hi)


NULLED = "CASE WHEN receiver_id % 7 = 0 THEN NULL ELSE receiver_id END"


@query("filter_not_self", f"""
WITH {inp.LOG_SQL}, n AS (SELECT id, sender_id, {NULLED} AS receiver_id FROM log)
SELECT * FROM n WHERE receiver_id IS DISTINCT FROM sender_id""")
def filter_not_self(spark, sf_dir):
    rows = inp.log(spark, sf_dir).select(
        "id", "sender_id", F.expr(NULLED).alias("receiver_id")
    )
    return filters.not_self(rows, "sender_id", "receiver_id")


@query("log_two_left_joins", f"""
WITH {inp.LOG_SQL}
SELECT id, ts, sender_id, receiver_id, s.user_name AS sender_name, r.user_name AS receiver_name
FROM log LEFT JOIN users s ON s.user_id = sender_id LEFT JOIN users r ON r.user_id = receiver_id""")
def log_two_left_joins(spark, sf_dir):
    named = joins.name_parties(
        inp.log(spark, sf_dir).drop("subject"), inp.users(spark, sf_dir),
        "sender_id", "receiver_id", "user_id", "user_name",
    )
    return named


TITLED_SQL = """titled AS (SELECT event_id AS id, event_type AS action,
    'Customer#' || lpad((json_extract_string(props, '$.k')::BIGINT * 17)::VARCHAR, 9, '0') AS title
    FROM events WHERE event_type = 'error')"""


@query("log_left_join_name", f"""
WITH {inp.LOG_SQL}, {TITLED_SQL}
SELECT id, action, title, user_id AS title_user_id
FROM titled LEFT JOIN users ON user_name = title""")
def log_left_join_name(spark, sf_dir):
    target = (F.get_json_object("props", "$.k").cast("bigint") * 17).cast("string")
    log = inp.table(spark, sf_dir, "events").where(F.col("event_type") == "error").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("action"),
        F.concat(F.lit("Customer#"), F.lpad(target, 9, "0")).alias("title"),
    )
    return joins.identify_by_name(log, inp.users(spark, sf_dir), "title", "user_id", "user_name")


def candidates_sql(actor: str = "sender_id") -> str:
    return f"""
hits AS (SELECT log.id, count(rev_id) AS n, arg_min(rev_id, (rev.ts, rev_id)) AS first_rev
    FROM log LEFT JOIN rev ON rev.actor = {actor}
        AND rev.ts BETWEEN log.ts - INTERVAL {inp.WINDOW} SECOND
        AND log.ts + INTERVAL {inp.WINDOW} SECOND GROUP BY log.id)"""


@query("resolve_unique", f"""
WITH {inp.LOG_SQL}, {candidates_sql()}
SELECT id, sender_id, CASE WHEN n = 1 THEN first_rev END AS rev_id FROM log JOIN hits USING (id)""")
def resolve_unique(spark, sf_dir):
    found = resolve.resolve(
        inp.log(spark, sf_dir), inp.revisions(spark, sf_dir), "sender_id", "ts", inp.WINDOW
    )
    return found.select("id", "sender_id", "rev_id")


@query("resolve_any", f"""
WITH {inp.LOG_SQL}, {candidates_sql()}
SELECT id, sender_id, first_rev AS rev_id FROM log JOIN hits USING (id)""")
def resolve_any(spark, sf_dir):
    found = resolve.resolve(
        inp.log(spark, sf_dir), inp.revisions(spark, sf_dir), "sender_id", "ts", inp.WINDOW,
        unique=False,
    )
    return found.select("id", "sender_id", "rev_id")


# Every tenth user is anonymous: id 0 and known by text only. Some rows have no sender.


@query("resolve_any_union", f"""
WITH {inp.LOG_SQL}, {candidates_sql()}
SELECT id, CASE WHEN id % 13 = 0 THEN NULL WHEN sender_id % 10 = 0 THEN 0 ELSE sender_id END AS sender_id,
    sender_id::VARCHAR AS sender_name, ts, CASE WHEN id % 13 <> 0 THEN first_rev END AS rev_id
FROM log JOIN hits USING (id)""")
def resolve_any_union(spark, sf_dir):
    hidden = F.when(F.pmod("sender_id", F.lit(10)) == 0, 0).otherwise(F.col("sender_id"))
    log = inp.log(spark, sf_dir).select(
        "id", F.col("sender_id").cast("string").alias("sender_name"),
        F.when(F.pmod("id", F.lit(13)) != 0, hidden).alias("sender_id"), "ts",
    )
    actor = F.col("actor")
    revs = inp.revisions(spark, sf_dir).select(
        F.when(F.pmod(actor, F.lit(10)) == 0, 0).otherwise(actor).alias("user_id"),
        actor.cast("string").alias("user_text"), "ts", "rev_id",
    )
    found = resolve.resolve_registered_and_anonymous(
        log, revs, "sender_id", "sender_name", "ts", inp.WINDOW
    )
    return resolve.flatten_log(found, ["id", "sender_id", "sender_name", "ts"])


EXTRACT = ("2024-01-05 00:00:00", "2024-01-25 00:00:00")


@query("filter_log_extract", f"""
WITH acts AS (SELECT event_id AS id, ts, (user_id % 3)::INTEGER AS filter, event_type AS action,
        CASE WHEN user_id % 10 = 0 THEN 0 ELSE user_id END AS actor_id, user_id::VARCHAR AS actor_text,
        'Customer#' || lpad((json_extract_string(props, '$.k')::BIGINT * 17)::VARCHAR, 9, '0') AS title,
        user_id AS actor FROM events WHERE event_type <> 'click'),
log AS (SELECT * FROM acts WHERE filter = 1 AND action = 'error'
    AND ts BETWEEN TIMESTAMP '{EXTRACT[0]}' AND TIMESTAMP '{EXTRACT[1]}'),
rev AS (SELECT user_id AS actor, ts, event_id AS rev_id FROM events WHERE event_type = 'click'),
users AS (SELECT c_custkey AS user_id, c_name AS user_name FROM customer), {candidates_sql("log.actor")}
SELECT first_rev AS rev_id, actor_id AS sender_id, actor_text AS sender_name, user_id AS receiver_id,
    title AS receiver_name, ts AS timestamp, NULL::VARCHAR AS message, id, ts, filter, action,
    actor_id, actor_text, title
FROM log JOIN hits USING (id) LEFT JOIN users ON user_name = title""")
def filter_log_extract(spark, sf_dir):
    events = inp.table(spark, sf_dir, "events")
    hidden = F.when(F.pmod("user_id", F.lit(10)) == 0, 0).otherwise(F.col("user_id"))
    name = F.col("user_id").cast("string")
    target = (F.get_json_object("props", "$.k").cast("bigint") * 17).cast("string")
    log = events.where("event_type <> 'click'").select(
        F.col("event_id").alias("id"), "ts", F.pmod("user_id", F.lit(3)).cast("int").alias("filter"),
        F.col("event_type").alias("action"), hidden.alias("actor_id"), name.alias("actor_text"),
        F.concat(F.lit("Customer#"), F.lpad(target, 9, "0")).alias("title"),
    )
    revs = events.where("event_type = 'click'").select(
        hidden.alias("user_id"), name.alias("user_text"), "ts", F.col("event_id").alias("rev_id")
    )
    start, end = (F.lit(x).cast("timestamp_ntz") for x in EXTRACT)
    found = extracts.filter_log_extract(
        log, inp.users(spark, sf_dir), revs, 1, "error", start, end, inp.WINDOW
    )
    return extracts.flattened(found)


@query("newest_n", "SELECT event_id, ts, user_id FROM events ORDER BY ts DESC, event_id LIMIT 1000")
def newest_n(spark, sf_dir):
    rows = inp.table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    return ranking.newest(rows, "ts", "event_id", 1000)


@query("topk_per_key", """
SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER
    AS rank FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 2""")
def topk_per_key(spark, sf_dir):
    rows = inp.table(spark, sf_dir, "events")
    found = ranking.top_per_key(rows, ["user_id"], [F.col("ts"), F.col("event_id")], 2)
    return found.select("event_id", "user_id", "rank")


@query("trailing_window", f"""
WITH {inp.LOG_SQL}
SELECT id, ts, sender_id FROM log WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 24 HOUR
ORDER BY ts DESC, id LIMIT 300""")
def trailing(spark, sf_dir):
    rows = inp.log(spark, sf_dir).select("id", "ts", "sender_id")
    return trailing_window(rows, "ts", "id", "2024-01-31 00:00:00")
