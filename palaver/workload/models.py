"""Fold, training, scoring, evaluation and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.functions.features import bucket
from palaver.functions.text import snippet
from palaver.operators import metrics, ranking, scoring
from palaver.operators.features import NgramExtractor, add_vectors
from palaver.operators.folds import fold_split
from palaver.operators.training import optimality, train_models
from palaver.plans.evaluate import fold_models, held_out_quality, training_fit
from palaver.plans.report import report
from palaver.session import scratch_path, written
from palaver.operators.filters import filter_paths
from palaver.plans import stored
from palaver.schemas import MODEL_WEIGHTS
from palaver.sources.documents import scan_entries
from palaver.sources.registry import load_models, read_registry, save_models, write_registry
from palaver.workload import inputs as inp
from palaver.workload.registry import query

CODES = ["quality", "toxic"]


@query("fold_split", """
WITH o AS (SELECT doc_id AS id, row_number() OVER (ORDER BY md5('1_' || doc_id), doc_id) - 1 AS pos,
    count(*) OVER () AS n FROM documents)
SELECT id, CASE WHEN pos < n // 7 * 3 THEN 0 WHEN pos < n // 7 * 5 THEN 1 ELSE 2 END::INTEGER
    AS slice FROM o""")
def folds(spark, sf_dir):
    ids = inp.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return fold_split(ids, "id", [3, 2, 2], seed=1)


@query("score_linear", f"WITH {inp.SCORES_WIDE_SQL} SELECT id, label, p FROM long")
def score_linear(spark, sf_dir):
    return scoring.long_scores(inp.scores(spark, sf_dir), inp.LABELS, ["id"])


def _coded(spark, sf_dir, columns=("doc_id",)):
    coded = inp.table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("_id"),
        F.create_map(
            *[x for c in CODES for x in (F.lit(c), F.col(c) == 1)]
        ).alias("labels"),
    )
    docs = inp.texts(spark, sf_dir)
    return docs.join(coded, F.col("doc_id") == F.col("_id"), "left").drop("_id")


def _predictions(spark, sf_dir):
    """Predictions for ``praise`` and ``critique``, coded as quality and toxic."""
    vectors = add_vectors(
        _coded(spark, sf_dir).select(
            F.col("doc_id").alias("id"), F.array("text").alias("added"),
            F.array().cast("array<string>").alias("removed"), F.col("source").alias("comment"),
            F.col("labels")["quality"].alias("c0"), F.col("labels")["toxic"].alias("c1"),
        ),
        [NgramExtractor(2)], bits=inp.BITS,
    ).withColumn("snippet", snippet(F.col("added")))
    scored = inp.scores(spark, sf_dir, ["c0", "c1", "snippet"], vectors)
    coded = F.create_map(F.lit("praise"), F.col("c0"), F.lit("critique"), F.col("c1"))
    return scoring.prediction_rows(
        scored.withColumn("labels", coded), ["praise", "critique"]
    )


PREDICTIONS_SQL = f"""{inp.SCORES_WIDE_SQL},
pr AS (SELECT label, id, p > 0.5 AS predicted,
    CASE label WHEN 'praise' THEN quality = 1 ELSE toxic = 1 END AS coded,
    round(greatest(p, 1 - p), 3) AS confidence,
    'http://enwp.org/?diff=prev&oldid=' || id AS diff,
    '"' || substr(text, 1, 50) || '"' AS snippet
    FROM long JOIN documents d ON d.doc_id = id LEFT JOIN labels l ON l.doc_id = id
    WHERE label <> 'other'),
predictions AS (SELECT label, id, predicted, coded, confidence, CASE WHEN coded IS NULL
    THEN 'Unknown' WHEN coded = predicted THEN 'Yes' ELSE 'No' END AS correct, diff, snippet
    FROM pr)"""


@query("prediction_rows", f"WITH {PREDICTIONS_SQL} SELECT * FROM predictions")
def prediction_rows(spark, sf_dir):
    return _predictions(spark, sf_dir)


@query("pivot_predictions", f"""
WITH {PREDICTIONS_SQL}
SELECT id, bool_or(predicted) FILTER (WHERE label = 'praise') AS praise,
    bool_or(predicted) FILTER (WHERE label = 'critique') AS critique, diff, snippet
FROM predictions GROUP BY id, diff, snippet""")
def pivot_predictions(spark, sf_dir):
    return scoring.predictions_by_id(_predictions(spark, sf_dir), ["praise", "critique"])


CONFUSION_SQL = """
pn AS (SELECT 'quality' AS label, n_chars % 2 = 0 AS predicted, quality = 1 AS coded
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    UNION ALL SELECT 'toxic', n_chars % 3 = 0, toxic = 1
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    UNION ALL SELECT 'uncoded', true, NULL FROM documents),
counts AS (SELECT label,
    count(*) FILTER (WHERE coded IS NOT NULL AND predicted AND coded) AS tp,
    count(*) FILTER (WHERE coded IS NOT NULL AND predicted AND NOT coded) AS fp,
    count(*) FILTER (WHERE coded IS NOT NULL AND NOT predicted AND NOT coded) AS tn,
    count(*) FILTER (WHERE coded IS NOT NULL AND NOT predicted AND coded) AS fn
    FROM pn GROUP BY label)"""


def _coded_pairs(spark, sf_dir):
    items = F.array(
        F.struct(F.lit("quality").alias("label"), (F.col("n_chars") % 2 == 0).alias("predicted"),
                 F.col("labels")["quality"].alias("coded")),
        F.struct(F.lit("toxic").alias("label"), (F.col("n_chars") % 3 == 0).alias("predicted"),
                 F.col("labels")["toxic"].alias("coded")),
        F.struct(F.lit("uncoded").alias("label"), F.lit(True).alias("predicted"),
                 F.lit(None).cast("boolean").alias("coded")),
    )
    return _coded(spark, sf_dir).select(F.inline(items))


@query("confusion", f"WITH {CONFUSION_SQL} SELECT * FROM counts")
def confusion(spark, sf_dir):
    return metrics.confusion(_coded_pairs(spark, sf_dir))


@query("metrics", f"""
WITH {CONFUSION_SQL},
pr AS (SELECT *, (tp + tn) / nullif(tp + fp + tn + fn, 0) AS a, tp / nullif(tp + fp, 0) AS p,
    tp / nullif(tp + fn, 0) AS r FROM counts)
SELECT label, tp, fp, tn, fn, round(a, 6) AS accuracy, round(p, 6) AS precision,
    round(r, 6) AS recall, CASE WHEN p > 0 AND r > 0 THEN round(1 / (0.5 / p + 0.5 / r), 6) END
    AS fmeasure FROM pr ORDER BY label""")
def quality(spark, sf_dir):
    found = metrics.quality(confusion(spark, sf_dir), undefined_as_null=True)
    figures = ["accuracy", "precision", "recall", "fmeasure"]
    return found.select(
        "label", "tp", "fp", "tn", "fn", *[F.round(c, 6).alias(c) for c in figures]
    ).orderBy("label")


THRESHOLD = 0.75


@query("report_counts", f"""
WITH {inp.SCORES_WIDE_SQL}
SELECT label, count(*) FILTER (WHERE p > {THRESHOLD}) AS above, count(*) AS total
FROM long GROUP BY label
UNION ALL SELECT 'uncertain', count(*) FILTER (WHERE m < {THRESHOLD}), count(*)
FROM (SELECT id, max(p) AS m FROM long GROUP BY id)""")
def report_counts(spark, sf_dir):
    return ranking.bucket_counts(inp.scores(spark, sf_dir), inp.LABELS, THRESHOLD)


@query("uncertain_rows", f"""
WITH {inp.SCORES_WIDE_SQL}
SELECT * FROM wide WHERE greatest(p_praise, p_critique, p_other) < {THRESHOLD}""")
def uncertain_rows(spark, sf_dir):
    return ranking.uncertain(inp.scores(spark, sf_dir), inp.LABELS, THRESHOLD)


def listed_sql(source: str, threshold: float) -> str:
    return f"""
g AS (SELECT *, list_sort([p_praise, p_critique, p_other]) AS s FROM {source}),
m AS (SELECT *, unnest([{{'label': 'praise', 'score': p_praise}},
    {{'label': 'critique', 'score': p_critique}}, {{'label': 'other', 'score': p_other}}]) AS x
    FROM g),
k AS (SELECT * EXCLUDE (s, x), x.label AS label, x.score AS score,
    CASE WHEN x.score - s[2] > 0 THEN -(x.score - s[2]) ELSE s[3] - x.score END AS margin
    FROM m WHERE x.score >= {threshold}),
listed AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY margin, id) AS rank FROM k)"""


@query("margin_rank", f"""
WITH {inp.SCORES_WIDE_SQL}, {listed_sql("wide", THRESHOLD)}
SELECT label, rank, id, score, round(margin, 6) AS margin FROM listed""")
def margin_rank(spark, sf_dir):
    found = ranking.label_lists(inp.scores(spark, sf_dir), inp.LABELS, THRESHOLD, "id")
    return found.select("label", "rank", "id", "score", F.round("margin", 6).alias("margin"))


@query("model_registry", f"""
WITH w AS (SELECT {inp.bucket_sql("source")} AS idx, quality, toxic, lang
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
old AS (SELECT 'quality' AS label, idx, avg(quality) AS weight, 4 AS fold FROM w GROUP BY idx
    UNION ALL SELECT 'toxic', idx, avg(toxic), 4 FROM w GROUP BY idx
    UNION ALL SELECT 'quality', idx, avg(quality), 3 FROM w GROUP BY idx),
new AS (SELECT 'quality' AS label, idx, -avg(quality) AS weight, 4 AS fold FROM w
    WHERE lang = 'en' GROUP BY idx)
SELECT label, idx, round(weight, 6) AS weight FROM old WHERE fold = 4 AND label = 'toxic'
UNION ALL SELECT label, idx, round(weight, 6) FROM new""")
def model_registry(spark, sf_dir):
    rows = _coded(spark, sf_dir).where("labels is not null").select(
        bucket(F.col("source")).alias("idx"), "lang",
        *[F.col("labels")[c].cast("int").alias(c) for c in CODES],
    )

    def model(source, label, sign=1):
        return source.groupBy("idx").agg((F.avg(label) * sign).alias("weight")).select(
            F.lit(label).alias("label"), "idx", "weight",
            F.lit("2011-01-01 00:00:00").cast("timestamp").alias("trained_at"),
        )

    four, three = {"cross-validation": "4"}, {"cross-validation": "3"}
    empty = spark.createDataFrame(
        [], "label string, tags map<string, string>, idx int, weight double, trained_at timestamp"
    )
    kept = save_models(
        empty, model(rows, "quality").unionByName(model(rows, "toxic")), CODES, four
    )
    kept = save_models(kept, model(rows, "quality"), ["quality"], three)
    kept = save_models(kept, model(rows.where("lang = 'en'"), "quality", -1), ["quality"], four)
    kept = save_models(kept, model(rows.where("lang = 'de'"), "toxic"), ["toxic"], {})
    path = scratch_path(spark, "registry")
    write_registry(kept, path)
    found = load_models(read_registry(spark, path), four)
    return found.select("label", "idx", F.round("weight", 6).alias("weight"))


def _training_vectors(spark, sf_dir):
    """Vectors of the coded documents, written out once as they are read many times."""
    rows = _coded(spark, sf_dir).where("labels is not null").select(
        F.col("doc_id").alias("id"), F.array("text").alias("added"),
        F.array().cast("array<string>").alias("removed"), F.col("source").alias("comment"),
        "labels",
    )
    vectors = add_vectors(rows, inp.extractors(spark), bits=inp.BITS)
    return written(vectors.select("id", "labels", "vector"), "vectors")


@query("stored_predictions", f"""WITH {inp.SCORES_WIDE_SQL},
sets AS (SELECT id, count(DISTINCT feature) AS n_features FROM (
    {inp.ngram_sql("ch", "text", 2, "ngram2")}) GROUP BY id)
SELECT id, n_features, p_praise, p_critique, p_other FROM wide JOIN sets USING (id)
WHERE id % 5 IN (1, 2)""")
def stored_predictions(spark, sf_dir):
    """Entries are stored with features and vector, found again by slice and scored by a stored model."""
    shaped = F.struct(
        F.struct(F.col("id").alias("rev_id"), F.col("id").cast("string").alias("rev_text")).alias("id"),
        F.col("comment").alias("comment"),
        F.struct("added", "removed").alias("content"),
    )
    docs = inp.entries(spark, sf_dir).select(
        shaped.alias("entry"), F.struct(F.pmod("id", F.lit(5)).cast("int").alias("slice")).alias("internal")
    )
    path, models = scratch_path(spark, "entries"), scratch_path(spark, "registry")
    stored.with_features(docs, [NgramExtractor(2)], inp.BITS).write.parquet(path)
    tags = {"cross-validation": "2"}
    weights = inp.weights(spark).withColumn("trained_at", F.lit("2011-01-01 00:00:00").cast("timestamp"))
    empty = spark.createDataFrame([], MODEL_WEIGHTS)
    other = weights.withColumn("weight", -F.col("weight"))
    kept = save_models(save_models(empty, weights, inp.LABELS, tags), other, inp.LABELS, {})
    write_registry(kept, models)

    found = scan_entries(spark, path)
    found = filter_paths(found, {"internal.slice": F.col("internal.slice") == 0}, {
        "internal.slice": F.col("internal.slice").isin(1, 2)})
    scored = stored.stored_scores(found, read_registry(spark, models), inp.LABELS, tags, bits=inp.BITS)
    sizes = found.select(
        F.col("entry.id.rev_id").alias("id"), F.size(F.col("features")["ngram2"]).cast("bigint").alias("n_features")
    )
    return scored.join(sizes, "id").select(
        "id", "n_features", *[F.round(f"p_{lab}", 6).alias(f"p_{lab}") for lab in inp.LABELS]
    )


# SQL cannot fit a model, but can say what holds for a right one. Figures are tested against plain fits.

CODED_SQL = """
coded AS (SELECT 'quality' AS label, quality AS y FROM labels JOIN documents USING (doc_id)
    UNION ALL SELECT 'toxic', toxic FROM labels JOIN documents USING (doc_id))"""


@query("train_l1", f"WITH {CODED_SQL} SELECT label, count(y) AS n, true AS optimal FROM coded GROUP BY label")
def train_l1(spark, sf_dir):
    vectors = _training_vectors(spark, sf_dir)
    weights = train_models(vectors, CODES, inp.BITS)
    found = optimality(vectors, weights, CODES, inp.BITS)
    return found.select("label", "n", (F.col("gap") < 0.01).alias("optimal"))


def _figures(measured, gaps):
    """Figures rounded, checked by counts, and whether every model of the label is optimal."""
    names = ("accuracy", "precision", "recall", "fmeasure")
    optimal = gaps.groupBy("label").agg((F.max("gap") < 0.01).alias("optimal"))
    return measured.join(optimal, "label").select(
        "label", "tp", "fp", "tn", "fn", *[F.round(c, 4).alias(c) for c in names], "optimal"
    )


@query("train_fit_metrics")
def train_fit_metrics(spark, sf_dir):
    vectors = _training_vectors(spark, sf_dir)
    weights = train_models(vectors, CODES, inp.BITS)
    return _figures(
        training_fit(vectors, CODES, bits=inp.BITS, weights=weights), optimality(vectors, weights, CODES, inp.BITS)
    )


@query("cross_validate")
def cross_validation(spark, sf_dir):
    sliced, weights = fold_models(_training_vectors(spark, sf_dir), CODES, bits=inp.BITS)
    gaps = optimality(sliced, weights, CODES, inp.BITS, folds=("slice", list(range(5))))
    return _figures(held_out_quality(sliced, weights, CODES, bits=inp.BITS), gaps)


@query("class_sizes", f"""WITH {CODED_SQL}
SELECT label, count_if(y = 1)::BIGINT AS positives, count_if(y = 0)::BIGINT AS negatives, true AS optimal FROM coded GROUP BY label""")
def class_sizes(spark, sf_dir):
    """What SQL can say of cross-validation: every coded row is measured once, by models at their optimum."""
    found = cross_validation(spark, sf_dir)
    positives, negatives = F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn")
    return found.select("label", positives.alias("positives"), negatives.alias("negatives"), "optimal")


# The report over one day: each log row's message is the document numbered by sender plus
# receiver.

START, END = "2024-01-15 00:00:00", "2024-01-16 00:00:00"
REPORT_LIMIT, REPORT_THRESHOLD = 300, 0.6


@query("report", f"""
WITH {inp.LOG_SQL},
recent AS (SELECT log.*, d.text AS body FROM log LEFT JOIN documents d
    ON d.doc_id = sender_id + receiver_id WHERE sender_id <> 0 AND receiver_id IS DISTINCT FROM sender_id
    AND log.id IN (SELECT id FROM log WHERE ts BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'
        ORDER BY ts DESC, id LIMIT {REPORT_LIMIT})),
texted AS (SELECT id, ts, sender_id, receiver_id, subject, coalesce(body, '') AS body FROM recent),
hits AS (SELECT t.id, count(rev_id) AS n, min(rev_id) AS rev_id FROM texted t LEFT JOIN rev
    ON rev.actor = sender_id AND rev.ts BETWEEN t.ts - INTERVAL {inp.WINDOW} SECOND
    AND t.ts + INTERVAL {inp.WINDOW} SECOND GROUP BY t.id),
ch AS (SELECT id, 'added' AS channel, body AS text FROM texted
    UNION ALL SELECT id, 'removed', '' FROM texted
    UNION ALL SELECT id, 'comment', '' FROM texted), {inp.calm_sql("ch", "chc")}, {inp.WORDS_SQL},
feats AS ({inp.lexicon_feature_sql("chc", "words", 0.2)}
    UNION ALL SELECT id, 'pattern', feature, 1.0::DOUBLE FROM ({inp.PATTERN_SQL})
    UNION ALL {inp.ngram_sql("ch", "text", 2, "ngram2")}
    UNION ALL {inp.ngram_sql("chc", "calm", 2, "ngram2_calm")}
    UNION ALL {inp.ngram_sql("ch", "text", 1, "ngram1")}
    UNION ALL {inp.ngram_sql("chc", "calm", 1, "ngram1_calm")}),
{inp.WEIGHTS_SQL},
cells AS (SELECT id, idx, coalesce(max(value) FILTER (WHERE fset = 'lexicon'), 1.0) AS value FROM (
    SELECT id, fset, value, {inp.bucket_sql("fset || '_' || feature")} AS idx FROM feats)
    GROUP BY id, idx),
long AS (SELECT id, label, round(1 / (1 + exp(-sum(value * weight))), 6) AS p
    FROM cells JOIN weights USING (idx) GROUP BY id, label),
wide AS (SELECT id, max(p) FILTER (WHERE label = 'praise') AS p_praise,
    max(p) FILTER (WHERE label = 'critique') AS p_critique,
    max(p) FILTER (WHERE label = 'other') AS p_other FROM long GROUP BY id),
{listed_sql("wide", REPORT_THRESHOLD)},
every AS (SELECT id, label, rank FROM listed UNION ALL
    SELECT id, 'uncertain', row_number() OVER (ORDER BY ts DESC, id) FROM wide JOIN texted USING (id)
    WHERE greatest(p_praise, p_critique, p_other) < {REPORT_THRESHOLD})
SELECT label, rank, t.id, CASE WHEN n = 1 THEN h.rev_id END AS rev_id,
    s.user_name AS sender_name, r.user_name AS receiver_name, ts,
    subject || chr(10) || body AS message, p_praise, p_critique, p_other,
    'http://en.wikipedia.org/w/index.php?diff=prev&oldid=' ||
        CASE WHEN n = 1 THEN h.rev_id END AS revision_link,
    'http://en.wikipedia.org/wiki/User:' || r.user_name AS receiver_link,
    'http://en.wikipedia.org/wiki/Special:Contributions/' || s.user_name || '?offset=' ||
        strftime(ts, '%Y%m%d%H%M%S') || '&dir=prev' AS sender_link
FROM every JOIN texted t USING (id) JOIN wide USING (id) JOIN hits h USING (id)
LEFT JOIN users s ON s.user_id = sender_id LEFT JOIN users r ON r.user_id = receiver_id""")
def live_report(spark, sf_dir):
    docs = inp.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("message_id"), F.col("text").alias("message")
    )
    log = inp.log(spark, sf_dir).withColumn("message_id", F.col("sender_id") + F.col("receiver_id"))
    labels = inp.LABELS
    found = report(
        log, inp.users(spark, sf_dir), inp.revisions(spark, sf_dir), inp.weights(spark), labels,
        inp.extractors(spark), F.lit(START).cast("timestamp_ntz"),
        F.lit(END).cast("timestamp_ntz"), REPORT_LIMIT, inp.WINDOW, REPORT_THRESHOLD, inp.BITS,
        docs,
    )
    return found
