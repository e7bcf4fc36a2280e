"""Feature, dictionary and lexicon queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from palaver.functions.features import Pattern, bucket
from palaver.operators import features as fx
from palaver.sources.dictionaries import lexicon_scores, lexicon_senses, pattern_dictionary, plan_patterns
from palaver.workload import inputs as inp
from palaver.workload.registry import query


def _ngrams(name: str, n: int, calm: bool) -> None:
    source, text = ("chc", "calm") if calm else ("ch", "text")
    fset = f"ngram{n}" + ("_calm" if calm else "")
    extra = f", {inp.calm_sql('ch', 'chc')}" if calm else ""

    @query(name, f"""WITH {inp.CHANNELS_SQL}{extra}
    SELECT id, feature FROM ({inp.ngram_sql(source, text, n, fset)})""")
    def run(spark, sf_dir):
        found = fx.feature_table(inp.entries(spark, sf_dir), [fx.NgramExtractor(n, calm)])
        return found.select("id", "feature")


_ngrams("ngram_1", 1, False)
_ngrams("ngram_2", 2, False)
_ngrams("ngram_2_lower", 2, True)

BINARY = [Pattern("number", "[0-9]+"), Pattern("ending", "(ing|tion)[.,]"),
          Pattern("line", "(?m)^[A-Z][a-z]+ed")]
EXPANDED = [Pattern("pair", "(th[a-z])([a-z]r)", binary=False, expand=True),
            Pattern("digits", "([0-9]+)", binary=False, expand=True)]


@query("pattern_binary", f"WITH {inp.CHANNELS_SQL} " + " UNION ALL ".join(
    f"SELECT id, '{p.name}_' || channel AS feature FROM ch WHERE regexp_matches(text, '{p.regex}')"
    for p in BINARY))
def pattern_binary(spark, sf_dir):
    found = fx.feature_table(inp.entries(spark, sf_dir), [fx.PatternExtractor(BINARY)])
    return found.select("id", "feature")


@query("pattern_expand", rf"""WITH {inp.CHANNELS_SQL},
pairs AS (SELECT id, channel, unnest(regexp_extract_all(text, '(th[a-z])([a-z]r)')) AS m FROM ch)
SELECT DISTINCT id, 'pair_' || channel || '_' || substr(m, 1, 3) || '_' || substr(m, 4, 2)
    AS feature FROM pairs
UNION ALL SELECT DISTINCT id, 'digits_' || channel || '_' || m FROM (
    SELECT id, channel, unnest(regexp_extract_all(text, '[0-9]+')) AS m FROM ch)""")
def pattern_expand(spark, sf_dir):
    found = fx.feature_table(inp.entries(spark, sf_dir), [fx.PatternExtractor(EXPANDED)])
    return found.select("id", "feature")


@query("pattern_many", rf"""WITH {inp.CHANNELS_SQL},
w AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z]{{5,}}')) AS w FROM benchmark),
words AS (SELECT w FROM w GROUP BY w ORDER BY count(*) DESC, w LIMIT 500),
hits AS (SELECT id, channel, w, regexp_extract_all(text, w || '([a-z]*)[.,]', 1) AS tails FROM ch, words
    WHERE contains(text, w))
SELECT id, w || '_' || channel AS feature FROM hits WHERE len(tails) > 0
UNION SELECT id, w || '_' || channel || '_' || unnest(tails) FROM hits""")
def pattern_many(spark, sf_dir):
    """A dictionary of 500 patterns, of the words the benchmark uses most."""
    word = F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{5,}"), F.lit(0))).alias("w")
    counts = inp.table(spark, sf_dir, "benchmark").select(word).groupBy("w").count()
    line = F.concat("w", F.lit("\t"), "w", F.lit("([a-z]*)[.,]\texpand,binary")).alias("value")
    lines = counts.orderBy(F.desc("count"), "w").limit(500).select(line)
    patterns = plan_patterns(pattern_dictionary(lines))
    found = fx.feature_table(inp.entries(spark, sf_dir), [fx.PatternExtractor(patterns)])
    return found.select("id", "feature")


# Dictionary lines from the documents' own lines: commas become tabs, full stops comment signs.


@query("pattern_dict", r"""
WITH l AS (SELECT doc_id || chr(9) || 'x' || replace(replace(unnest(string_split(text, chr(10))),
        chr(9), ' '), '.', CASE WHEN n_chars % 2 = 0 THEN '#' ELSE '\#' END) ||
        CASE WHEN n_chars % 3 = 0 THEN chr(9) || 'expand,binary' ELSE '' END AS line
    FROM documents),
k AS (SELECT CASE WHEN instr(line, '#') = 0 OR (instr(line, '#') > 1 AND
        instr(line, '\#') + 1 = instr(line, '#')) THEN line
        ELSE substr(line, 1, instr(line, '#') - 1) END AS kept FROM l),
p AS (SELECT string_split(regexp_replace(kept, '^\s+|\s+$', '', 'g'), chr(9)) AS p FROM k)
SELECT p[1] AS name, p[2] AS regex,
    coalesce(p[3], '') = '' OR contains(p[3], 'binary') AS is_binary,
    coalesce(contains(p[3], 'expand'), false) AS is_expanded
FROM p WHERE len(p) IN (2, 3)""")
def pattern_dict(spark, sf_dir):
    line = F.explode(F.split("text", "\n")).alias("line")
    docs = inp.texts(spark, sf_dir).select("doc_id", "n_chars", line)
    sign = F.when(F.pmod("n_chars", F.lit(2)) == 0, "#").otherwise("\\#")
    body = F.replace(F.replace(F.col("line"), F.lit("\t"), F.lit(" ")), F.lit("."), sign)
    flags = F.when(F.pmod("n_chars", F.lit(3)) == 0, "\texpand,binary").otherwise("")
    value = F.concat(F.col("doc_id").cast("string"), F.lit("\tx"), body, flags)
    return pattern_dictionary(docs.select(value.alias("value")))


@query("lexicon_explode", f"WITH {inp.SENSES_SQL} SELECT word, pos, neg FROM senses")
def lexicon_explode(spark, sf_dir):
    return lexicon_senses(inp.lexicon_lines(spark, sf_dir))


@query("lexicon_avg", f"WITH {inp.SCORES_SQL} SELECT word, round(score, 6) AS score FROM scores")
def lexicon_avg(spark, sf_dir):
    scores = lexicon_scores(lexicon_senses(inp.lexicon_lines(spark, sf_dir)))
    return scores.select("word", F.round("score", 6).alias("score"))


@query("lexicon_features", f"""
WITH {inp.CHANNELS_SQL}, {inp.calm_sql("ch", "chc")}, {inp.SCORES_SQL}
SELECT id, feature, round(value, 6) AS value
FROM ({inp.lexicon_feature_sql("chc", "scores", 0.1)})""")
def lexicon_features(spark, sf_dir):
    scores = lexicon_scores(lexicon_senses(inp.lexicon_lines(spark, sf_dir)))
    extractor = fx.LexiconExtractor(scores)
    found = fx.feature_table(inp.entries(spark, sf_dir), [extractor])
    return found.select("id", "feature", F.round("value", 6).alias("value"))


@query("feature_hash", f"""
WITH {inp.CHANNELS_SQL}, {inp.calm_sql("ch", "chc")}
SELECT id, feature, {inp.bucket_sql("fset || '_' || feature")} AS idx
FROM ({inp.ngram_sql("chc", "calm", 1, "ngram1_calm")})""")
def feature_hash(spark, sf_dir):
    found = fx.feature_table(
        inp.entries(spark, sf_dir), [fx.NgramExtractor(1, lower_shouting=True)]
    )
    return found.select(
        "id", "feature", bucket(F.concat_ws("_", "fset", "feature")).alias("idx")
    )


@query("feature_union", f"""
WITH {inp.FEATURES_SQL}
SELECT id, fset, count(*) AS features, round(sum(value), 6) AS total,
    sum({inp.bucket_sql("feature", 30)})::BIGINT AS checksum
FROM feats GROUP BY id, fset""")
def feature_union(spark, sf_dir):
    found = fx.feature_table(inp.entries(spark, sf_dir), inp.extractors(spark), bits=30)
    return found.groupBy("id", "fset").agg(
        F.count("*").alias("features"),
        F.round(F.sum("value"), 6).alias("total"),
        F.sum(F.col("bucket").cast("bigint")).alias("checksum"),
    )


@query("sparse_vector", f"""
WITH {inp.FEATURES_SQL}
SELECT id, idx, coalesce(max(value) FILTER (WHERE fset = 'lexicon'), 1.0) AS value FROM (
    SELECT id, fset, value, {inp.bucket_sql("fset || '_' || feature")} AS idx FROM feats)
GROUP BY id, idx""")
def sparse_vector(spark, sf_dir):
    return fx.vector_rows(
        fx.add_vectors(inp.entries(spark, sf_dir), inp.extractors(spark), bits=inp.BITS)
    )


class CapitalShare:
    """A user's extractor: the share of capitals in a text, computed in pandas."""

    fields = ()

    def name(self):
        return "capital_share"

    def features(self, channels, key):
        @F.pandas_udf("double")
        def share(text: pd.Series) -> pd.Series:
            return text.str.count("[A-Z]") / text.str.len().clip(lower=1)

        return channels.select(key, F.concat(F.col("channel"), F.lit("_share")).alias("feature"),
                               share("text").alias("value"))


@query("custom_extractor", f"""
WITH {inp.CHANNELS_SQL}
SELECT id, channel || '_share' AS feature, round(length(regexp_replace(text, '[^A-Z]', '', 'g'))
    / greatest(length(text), 1), 6) AS value FROM ch""")
def custom_extractor(spark, sf_dir):
    found = fx.feature_table(inp.entries(spark, sf_dir), [CapitalShare()])
    return found.select("id", "feature", F.round("value", 6).alias("value"))
