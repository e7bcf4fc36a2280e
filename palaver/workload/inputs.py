"""The driver tables seen as entries, logs, revisions, lexicons and weights.

Each view has its SQL twin below it, to be put into the ``WITH`` list of an oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.functions.features import Pattern
from palaver.functions.text import CHANGES_WHEN_UPPERED, SAME_WHEN_UPPERED
from palaver.operators.features import NgramExtractor, add_vectors, default_extractors
from palaver.operators.scoring import score_linear
from palaver.sources.layout import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


# Documents as entries: the text was added, nothing removed, the source is the comment.


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select(
        F.col("doc_id").alias("id"),
        F.array("text").alias("added"),
        F.array().cast("array<string>").alias("removed"),
        F.col("source").alias("comment"),
    )


SPLIT = r"'[ {}\n()''>]'"

CHANNELS_SQL = """
ch AS (SELECT doc_id AS id, 'added' AS channel, text FROM documents
       UNION ALL SELECT doc_id, 'removed', '' FROM documents
       UNION ALL SELECT doc_id, 'comment', source FROM documents)"""


def calm_sql(source: str, target: str) -> str:
    """``target``: ``source`` with a column ``calm``, its de-shouted text."""
    return f"""
{target}_r AS (SELECT *, regexp_extract_all(text, '{CHANGES_WHEN_UPPERED}+|{SAME_WHEN_UPPERED}+')
               AS runs FROM {source}),
{target}_l AS (SELECT *, list_transform(runs, lambda r: CASE
               WHEN regexp_matches(r, '^{SAME_WHEN_UPPERED}') THEN length(r) ELSE 0 END) AS lens
               FROM {target}_r),
{target}_b AS (SELECT *, len(lens) - list_position(list_reverse(lens), list_max(lens)) + 1 AS best
               FROM {target}_l),
{target} AS (SELECT * EXCLUDE (runs, lens, best),
             CASE WHEN list_max(lens) > 50 THEN array_to_string(list_transform(runs,
                 lambda r, i: CASE WHEN i = best THEN lower(r) ELSE r END), '')
             ELSE text END AS calm FROM {target}_b)"""


def ngram_sql(source: str, text: str, n: int, fset: str) -> str:
    """Distinct n-grams of a channel view: ``(id, fset, feature, value)``."""
    pad = "[" + ", ".join(["'<>'"] * (n - 1)) + "]" if n > 1 else "[]::VARCHAR[]"
    gram = " || '_' || ".join(f"w[i + {k}]" for k in range(1, n + 1))
    return f"""
SELECT id, '{fset}' AS fset, unnest(list_distinct(list_transform(
    range(0, len(w) - {n - 1}), lambda i: channel || '_' || {gram}))) AS feature,
    1.0::DOUBLE AS value
FROM (SELECT id, channel, {pad} || string_split_regex({text}, {SPLIT}) || {pad} AS w
      FROM {source})"""


# A lexicon file made of the documents: each gives one line, its words being the terms. Some
# lines are comments, some have a part of speech of two characters.


def lexicon_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array_distinct(
        F.filter(F.split("text", r"[^\p{L}]+"), lambda w: w != "")
    )
    pos = F.when(F.col("lang").isin("en", "fr"), F.substring("lang", 1, 1)).otherwise(
        F.col("lang")
    )
    return texts(spark, sf_dir).select(
        F.concat_ws(
            "\t",
            F.when(F.col("source") == "src0", F.concat(F.lit("#"), pos)).otherwise(pos),
            F.col("doc_id").cast("string"),
            (F.pmod("doc_id", F.lit(5)) / 8.0).cast("string"),
            (F.pmod("n_chars", F.lit(3)) / 8.0).cast("string"),
            F.array_join(F.transform(words, lambda w: F.concat(w, F.lit("#1"))), " "),
        ).alias("value")
    ).where("not endswith(value, '\t')")


SENSES_SQL = r"""
lines AS (SELECT doc_id, lang, doc_id % 5 / 8.0::DOUBLE AS pos, n_chars % 3 / 8.0::DOUBLE AS neg,
    list_distinct(list_filter(string_split_regex(text, '[^\p{L}]+'), lambda w: w <> '')) AS words
    FROM documents WHERE lang IN ('en', 'fr') AND source <> 'src0'),
senses AS (SELECT unnest(words) AS word, pos, neg FROM lines WHERE pos <> 0 OR neg <> 0)"""

SCORES_SQL = SENSES_SQL + """,
scores AS (SELECT word, avg(pos - neg) AS score FROM senses GROUP BY word)"""

# The small lexicon and patterns of the full extractor list.

WORDS = [("the", 0.25), ("worthless", -0.75), ("und", 0.5), ("la", -0.25), ("of", 0.0625),
         ("sich", -0.5), ("thanks", 0.875), ("et", 0.375)]

WORD_VALUES = ", ".join(f"('{w}', CAST({s} AS DOUBLE))" for w, s in WORDS)

PATTERNS = [
    Pattern("number", "[0-9]+"),
    Pattern("capital", "[A-Z][a-z]+ed", binary=True, expand=False),
    Pattern("mail", "([a-z0-9]+)@([a-z0-9]+)", binary=True, expand=True),
    Pattern("pair", "(th[a-z])([a-z]r)", binary=False, expand=True),
]


def extractors(spark: SparkSession) -> list:
    return default_extractors(
        spark.sql(f"SELECT * FROM VALUES {WORD_VALUES} AS words(word, score)"), PATTERNS
    )


def _pattern_sql() -> str:
    parts = []
    for p in PATTERNS:
        if p.binary:
            parts.append(
                f"SELECT id, '{p.name}_' || channel AS feature FROM ch"
                f" WHERE regexp_matches(text, '{p.regex}')"
            )
        if p.expand:
            groups = " || '_' || ".join(
                f"regexp_extract(m, '{p.regex}', {g})" for g in range(1, p.groups + 1)
            )
            parts.append(
                f"SELECT DISTINCT id, '{p.name}_' || channel || '_' || {groups} AS feature FROM"
                f" (SELECT id, channel, unnest(regexp_extract_all(text, '{p.regex}')) AS m FROM ch)"
            )
    return " UNION ".join(parts)


PATTERN_SQL = _pattern_sql()


def lexicon_feature_sql(source: str, scores: str, threshold: float) -> str:
    return rf"""
SELECT DISTINCT id, 'lexicon' AS fset, channel || '_' || word AS feature, score AS value FROM (
    SELECT id, channel, regexp_replace(t, '[?!.,;:\-"'']$', '') AS token FROM (
        SELECT id, channel, unnest(string_split_regex(calm, {SPLIT})) AS t FROM {source})
    WHERE t <> '') JOIN {scores} ON token = word
WHERE abs(score) > {threshold}"""


WORDS_SQL = f"words(word, score) AS (VALUES {WORD_VALUES})"

FEATURES_SQL = f"""{CHANNELS_SQL}, {calm_sql("ch", "chc")}, {WORDS_SQL},
feats AS ({lexicon_feature_sql("chc", "words", 0.2)}
    UNION ALL SELECT id, 'pattern', feature, 1.0::DOUBLE FROM ({PATTERN_SQL})
    UNION ALL {ngram_sql("ch", "text", 2, "ngram2")}
    UNION ALL {ngram_sql("chc", "calm", 2, "ngram2_calm")}
    UNION ALL {ngram_sql("ch", "text", 1, "ngram1")}
    UNION ALL {ngram_sql("chc", "calm", 1, "ngram1_calm")})"""


def bucket_sql(key: str, bits: int = 15) -> str:
    return f"((('0x' || substr(md5({key}), 1, 8))::BIGINT & {(1 << bits) - 1}) + 1)::INTEGER"


# Model weights from the bucket number: multiples of 1/1024, so their sums are exact.

LABELS = ["praise", "critique", "other"]
FACTORS = [7919, 104729, 1299709]  # fixed values, any odd numbers do
BITS = 15


def weights(spark: SparkSession) -> DataFrame:
    items = F.array(
        *[
            F.struct(
                F.lit(lab).alias("label"),
                ((F.pmod(F.col("id") * f, F.lit(201)) - 100) / 1024.0).alias("weight"),
            )
            for lab, f in zip(LABELS, FACTORS)
        ]
    )
    return spark.range(1, (1 << BITS) + 1).select(
        F.inline(items), F.col("id").cast("int").alias("idx")
    )


WEIGHTS_SQL = "weights AS (" + " UNION ALL ".join(
    f"SELECT '{lab}' AS label, i::INTEGER AS idx, (i * {f} % 201 - 100)::DOUBLE / 1024 AS weight"
    f" FROM range(1, {(1 << BITS) + 1}) t(i)"
    for lab, f in zip(LABELS, FACTORS)
) + ")"


def bigram_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_vectors(entries(spark, sf_dir), [NgramExtractor(2)], bits=BITS)


def scores(spark: SparkSession, sf_dir: str, carry: list[str] | None = None,
           vectors: DataFrame | None = None) -> DataFrame:
    """Scores by the fixed weights, rounded so that engines agree to the last digit."""
    found = score_linear(
        bigram_vectors(spark, sf_dir) if vectors is None else vectors,
        weights(spark), LABELS, carry=carry, bits=BITS,
    )
    return found.select(
        "id", *(carry or []), *[F.round(f"p_{lab}", 6).alias(f"p_{lab}") for lab in LABELS]
    )


SCORES_WIDE_SQL = f"""{CHANNELS_SQL}, {WEIGHTS_SQL},
cells AS (SELECT DISTINCT id, {bucket_sql("fset || '_' || feature")} AS idx
          FROM ({ngram_sql("ch", "text", 2, "ngram2")})),
long AS (SELECT id, label, round(1 / (1 + exp(-sum(weight))), 6) AS p
         FROM cells JOIN weights USING (idx) GROUP BY id, label),
wide AS (SELECT id, """ + ", ".join(
    f"max(p) FILTER (WHERE label = '{lab}') AS p_{lab}" for lab in LABELS
) + " FROM long GROUP BY id)"


# Events as interaction logs and revisions: errors are log rows, clicks are revisions, the
# number in ``props`` is the receiver.

WINDOW = 3600


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .where("event_type = 'error'")
        .select(
            F.col("event_id").alias("id"),
            "ts",
            F.col("user_id").alias("sender_id"),
            F.get_json_object("props", "$.k").cast("bigint").alias("receiver_id"),
            F.col("event_type").alias("subject"),
        )
    )


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .where("event_type = 'click'")
        .select(F.col("user_id").alias("actor"), "ts", F.col("event_id").alias("rev_id"))
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("user_name")
    )


LOG_SQL = """
log AS (SELECT event_id AS id, ts, user_id AS sender_id,
        json_extract_string(props, '$.k')::BIGINT AS receiver_id, event_type AS subject
        FROM events WHERE event_type = 'error'),
rev AS (SELECT user_id AS actor, ts, event_id AS rev_id FROM events WHERE event_type = 'click'),
users AS (SELECT c_custkey AS user_id, c_name AS user_name FROM customer)"""
