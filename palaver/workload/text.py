"""Text expression queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.functions import text as tx
from palaver.functions.keys import (
    format_wikidate, int_if, int_if_order, parse_wikidate, shift_seconds,
)
from palaver.operators.features import substitute_lemmas
from palaver.operators.lemmas import NOUN_SUFFIXES, Lemmatizer
from palaver.workload.inputs import CHANNELS_SQL, SPLIT, calm_sql, table, texts
from palaver.workload.registry import query

CELL, SPAN = r"(?s)<(?:li|p)[^>]*>(.*?)</(?:li|p)>", r"(?s)<a [^>]*>(.*?)</a>"


@query("diff_segments", f"""
WITH c AS (SELECT page_id, unnest(regexp_extract_all(html, '{CELL}', 1)) AS cell FROM pages)
SELECT page_id, unnest(CASE WHEN regexp_matches(cell, '{SPAN}')
    THEN regexp_extract_all(cell, '{SPAN}', 1) ELSE [cell] END) AS segment FROM c""")
def diff_segments(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select(
        "page_id", F.explode(tx.diff_segments(F.col("html"), CELL, SPAN)).alias("segment")
    )


@query("text_channels", """
SELECT conv_id, turn, 'added' AS channel, CASE WHEN role = 'user' THEN text ELSE '' END AS text
FROM conversations
UNION ALL SELECT conv_id, turn, 'removed', text || ' ' || role FROM conversations
WHERE role <> 'user'
UNION ALL SELECT conv_id, turn, 'comment',
    array_to_string(regexp_extract_all(role, '.'), ' ') FROM conversations""")
def text_channels(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    user = F.col("role") == "user"
    empty = F.array().cast("array<string>")
    channels = tx.text_channels(
        F.when(user, F.array("text")).otherwise(empty),
        F.when(~user, F.array("text", "role")),
        F.col("role"),
        spaced_comment=True,
    )
    return turns.select("conv_id", "turn", F.inline(channels))


@query("deshout", f"""
WITH src AS (SELECT doc_id AS id, text FROM documents), {calm_sql("src", "c")}
SELECT id, calm FROM c""")
def deshout(spark, sf_dir):
    return texts(spark, sf_dir).select(
        F.col("doc_id").alias("id"), tx.deshout(F.col("text")).alias("calm")
    )


@query("tokenize", f"""
SELECT doc_id AS id, unnest(string_split_regex(text, {SPLIT})) AS token FROM documents""")
def tokenize(spark, sf_dir):
    return texts(spark, sf_dir).select(
        F.col("doc_id").alias("id"), F.explode(tx.tokenize(F.col("text"))).alias("token")
    )


TOKENS_SQL = rf"""src AS (SELECT doc_id AS id, text FROM documents), {calm_sql("src", "c")},
toks AS (SELECT id, regexp_replace(t, '[?!.,;:\-"'']$', '') AS token FROM (
    SELECT id, unnest(string_split_regex(calm, {SPLIT})) AS t FROM c) WHERE t <> '')"""


@query("lexicon_tokens", f"WITH {TOKENS_SQL} SELECT id, token FROM toks")
def lexicon_tokens(spark, sf_dir):
    tokens = tx.lexicon_tokens(tx.tokenize(tx.deshout(F.col("text"))))
    return texts(spark, sf_dir).select(
        F.col("doc_id").alias("id"), F.explode(tokens).alias("token")
    )


@query("lemma_lookup", f"""
WITH {TOKENS_SQL},
lemmas AS (SELECT word AS form, rtrim(word, 's') AS lemma FROM (
    SELECT DISTINCT unnest(string_split_regex(text, '[^a-zA-Z]+')) AS word FROM benchmark)
    WHERE word LIKE '%s')
SELECT id, coalesce(lemma, token) AS token FROM toks LEFT JOIN lemmas ON form = token""")
def lemma_lookup(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select(
        F.explode(F.split("text", "[^a-zA-Z]+")).alias("form")
    )
    lemmas = words.where("form like '%s'").distinct().select(
        "form", F.regexp_replace("form", "s+$", "").alias("lemma")
    )
    return substitute_lemmas(lexicon_tokens(spark, sf_dir), lemmas, "token")


@query("lemmatize", f"""
WITH RECURSIVE {TOKENS_SQL},
lexicon AS (SELECT DISTINCT token AS word FROM toks WHERE token NOT LIKE '%s'),
exceptions AS (SELECT DISTINCT word AS form, left(word, 3) AS given FROM (
    SELECT unnest(string_split_regex(text, '[^a-zA-Z]+')) AS word FROM benchmark) WHERE word LIKE '%ts'),
rules AS (FROM (VALUES {", ".join(str((i, old, new)) for i, (old, new) in enumerate(NOUN_SUFFIXES))}) r(r, old, new)),
cands AS (SELECT DISTINCT token AS form, token AS cand, []::INT[] AS path FROM toks
    WHERE token NOT IN (SELECT form FROM exceptions)
    UNION ALL SELECT form, left(cand, length(cand) - length(old)) || new, path || [r]
    FROM cands JOIN rules ON ends_with(cand, old)),
every AS (FROM cands UNION ALL SELECT form, form, []::INT[] FROM exceptions
    UNION ALL SELECT form, given, [0] FROM exceptions),
lemmas AS (SELECT form, cand FROM every WHERE cand IN (SELECT word FROM lexicon)
    QUALIFY row_number() OVER (PARTITION BY form ORDER BY len(path), path) = 1)
SELECT id, coalesce(cand, token) AS token FROM toks LEFT JOIN lemmas ON form = token""")
def lemmatize(spark, sf_dir):
    """The documents' tokens by their lemmas; the lexicon is their words that do not end in s, and some
    words of the benchmark are taken as irregular."""
    tokens = lexicon_tokens(spark, sf_dir)
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "[^a-zA-Z]+")).alias("form"))
    irregular = words.where("form like '%ts'").distinct().withColumn("lemma", F.substring("form", 1, 3))
    lexicon = tokens.where("token not like '%s'").select(F.col("token").alias("word")).distinct()
    lemmas = Lemmatizer(lexicon, irregular).lemmas(tokens, "token")
    return substitute_lemmas(tokens, lemmas, "token")


@query("wikidate", """
SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') AS text, date_trunc('second', ts) AS parsed,
    strftime(date_trunc('second', ts) - INTERVAL 10 SECOND, '%Y%m%d%H%M%S') AS earliest,
    strftime(date_trunc('second', ts) + INTERVAL 10 SECOND, '%Y%m%d%H%M%S') AS latest
FROM events""")
def wikidate(spark, sf_dir):
    parsed = parse_wikidate(F.col("text"))
    return table(spark, sf_dir, "events").select(
        "event_id", format_wikidate(F.col("ts")).alias("text")
    ).select(
        "event_id", "text", parsed.alias("parsed"),
        format_wikidate(shift_seconds(parsed, -10)).alias("earliest"),
        format_wikidate(shift_seconds(parsed, 10)).alias("latest"),
    )


@query("int_if_key", """
WITH k AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '00' || user_id
    WHEN 1 THEN ' ' || user_id WHEN 2 THEN user_id || 'x' ELSE user_id || '.5' END AS raw
    FROM events)
SELECT event_id, CASE WHEN event_id % 4 < 2 THEN trim(raw)::BIGINT::VARCHAR ELSE raw END AS key,
    event_id % 4 >= 2 AS is_text,
    CASE WHEN event_id % 4 < 2 THEN trim(raw)::BIGINT END AS number FROM k""")
def int_if_key(spark, sf_dir):
    user = F.col("user_id").cast("string")
    form = F.pmod("event_id", F.lit(4))
    raw = (
        F.when(form == 0, F.concat(F.lit("00"), user))
        .when(form == 1, F.concat(F.lit(" "), user))
        .when(form == 2, F.concat(user, F.lit("x")))
        .otherwise(F.concat(user, F.lit(".5")))
    )
    rows = table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    order = int_if_order(F.col("raw"))
    return rows.select(
        "event_id", int_if(F.col("raw")).alias("key"),
        order["is_text"].alias("is_text"), order["number"].alias("number"),
    )


@query("compose_message", """
SELECT doc_id AS id, source || chr(10) || text AS message FROM documents""")
def compose_message(spark, sf_dir):
    return texts(spark, sf_dir).select(
        F.col("doc_id").alias("id"),
        tx.compose_message(F.col("source"), F.col("text")).alias("message"),
    )


@query("snippet", """
SELECT doc_id AS id, CASE WHEN lang = 'de' THEN '(empty)'
    ELSE '"' || substr(text || ' ' || source, 1, 50) || '"' END AS snippet FROM documents""")
def snippet(spark, sf_dir):
    added = F.when(F.col("lang") != "de", F.array("text", "source"))
    return texts(spark, sf_dir).select(
        F.col("doc_id").alias("id"), tx.snippet(added).alias("snippet")
    )


@query("links", """
SELECT event_id, 'http://en.wikipedia.org/w/index.php?diff=prev&oldid=' || event_id AS revision,
    'http://enwp.org/?diff=prev&oldid=' ||
        CASE WHEN event_type = 'click' THEN event_id::VARCHAR ELSE 'None' END AS short_revision,
    'http://en.wikipedia.org/wiki/User:' || user_id AS user,
    'http://en.wikipedia.org/wiki/Special:Contributions/' || user_id || '?offset=' ||
        strftime(ts, '%Y%m%d%H%M%S') || '&dir=prev' AS contributions FROM events""")
def links(spark, sf_dir):
    name = F.col("user_id").cast("string")
    rev = F.when(F.col("event_type") == "click", F.col("event_id"))
    return table(spark, sf_dir, "events").select(
        "event_id",
        tx.revision_link(F.col("event_id")).alias("revision"),
        tx.short_revision_link(rev).alias("short_revision"),
        tx.user_link(name).alias("user"),
        tx.contributions_link(name, format_wikidate(F.col("ts"))).alias("contributions"),
    )
