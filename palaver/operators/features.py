"""Feature extraction and hashing.

An entry's features are built inside its row as arrays and only exploded on request, so
extraction and hashing shuffle nothing. An extractor that has to join a table (the lexicon)
works on entries partitioned by key; its few hits meet the entry again in that partitioning.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions.binding import bind
from palaver.functions.features import (
    Pattern,
    bucket,
    ngrams,
    pattern_matches,
    pattern_presence,
)
from palaver.functions.many_patterns import many_pattern_features
from palaver.functions.text import deshout, lexicon_tokens, text_channels, tokenize
from palaver.operators.lemmas import Lemmatizer

CHANNELS = "_channels"
KNOWN = "_known"
QUIET = "_quiet"
NAMES = "_names"

Wrap = Callable[[Column, Column], Column]


@runtime_checkable
class RowExtractor(Protocol):
    """Features as an expression over one channel: an array of ``wrap(feature, value)``.

    ``fields`` names what it reads of a channel besides ``channel`` and ``text``: ``tokens``
    and/or ``calm`` (tokens of the de-shouted text). Feature names begin with ``prefix``, and
    the caller's ``wrap`` makes the element it needs, so that each feature's string is put
    together once and no struct is built on the way. With ``binary`` all values are 1.
    """

    binary: bool

    fields: tuple[str, ...]

    def name(self) -> str: ...

    def in_row(self, channel: Column, prefix: str, wrap: Wrap) -> Column: ...


@runtime_checkable
class TableExtractor(Protocol):
    """Features as a table ``(key, feature, value)`` from ``(key, channel, text, …)`` rows."""

    fields: tuple[str, ...]

    def name(self) -> str: ...

    def features(self, channels: DataFrame, key: str) -> DataFrame: ...


def only_name(feature: Column, _: Column) -> Column:
    """The ``wrap`` that keeps a feature's name alone."""
    return feature


def present(features: Column, wrap: Wrap) -> Column:
    """Feature names as features of value 1."""
    if wrap is only_name:
        return features
    return F.transform(features, lambda f: wrap(f, F.lit(1.0)))


class NgramExtractor:
    binary = True

    def __init__(self, n: int = 2, lower_shouting: bool = False):
        self.n = n
        self.source = "calm" if lower_shouting else "tokens"
        self.fields = (self.source,)

    def name(self) -> str:
        return f"ngram{self.n}" + ("_calm" if self.source == "calm" else "")

    def in_row(self, channel: Column, prefix: str, wrap: Wrap) -> Column:
        head = F.concat(F.lit(prefix), channel["channel"])
        return present(ngrams(head, channel[self.source], self.n), wrap)


class PatternExtractor:
    """Features of a pattern dictionary. More than ``MANY`` patterns are found by their literals."""

    binary = True
    fields = ()
    MANY = 32

    def __init__(self, patterns: list[Pattern]):
        self.patterns = patterns

    def name(self) -> str:
        return "pattern"

    def in_row(self, channel: Column, prefix: str, wrap: Wrap) -> Column:
        where, text = channel["channel"], channel["text"]
        if len(self.patterns) > self.MANY:
            found = many_pattern_features(where, text, self.patterns, prefix)
        else:
            found = F.concat(
                pattern_presence(where, text, self.patterns, prefix),
                pattern_matches(where, text, self.patterns, prefix),
            )
        return present(F.array_distinct(found), wrap)


class LexiconExtractor:
    """Polarity of the lexicon words in the text, if above ``threshold`` in size.

    ``scores`` is ``(word, score)`` with unique words. ``lemmas`` is ``(form, lemma)`` with
    unique forms and replaces a token before it is looked up; a ``Lemmatizer`` finds the lemmas of
    the tokens itself. Spark picks the join; what it may shuffle is one row per entry, channel and word.
    """

    fields = ("calm",)

    def __init__(
        self,
        scores: DataFrame,
        threshold: float = 0.1,
        lemmas: DataFrame | Lemmatizer | None = None,
    ):
        self.scores = scores.where(F.abs("score") > threshold).select("word", "score")
        self.lemmas = lemmas

    def name(self) -> str:
        return "lexicon"

    def features(self, channels: DataFrame, key: str) -> DataFrame:
        words = channels.select(
            key, "channel", F.explode(F.array_distinct(lexicon_tokens(F.col("calm")))).alias("word")
        )
        if self.lemmas is not None:
            derived = isinstance(self.lemmas, Lemmatizer)
            lemmas = self.lemmas.lemmas(words, "word") if derived else self.lemmas
            words = substitute_lemmas(words, lemmas, "word").distinct()
        return words.join(self.scores, "word").select(
            key,
            F.concat_ws("_", "channel", "word").alias("feature"),
            F.col("score").alias("value"),
        )


def substitute_lemmas(words: DataFrame, lemmas: DataFrame, column: str) -> DataFrame:
    """Replace a word by its lemma where the table has one."""
    pairs = lemmas.select(F.col("form").alias("_form"), F.col("lemma").alias("_lemma"))
    return (
        words.join(pairs, F.col(column) == F.col("_form"), "left")
        .withColumn(column, F.coalesce("_lemma", column))
        .drop("_form", "_lemma")
    )


def default_extractors(scores: DataFrame, patterns: list[Pattern]) -> list:
    return [
        LexiconExtractor(scores, threshold=0.2),
        PatternExtractor(patterns),
        NgramExtractor(2),
        NgramExtractor(2, lower_shouting=True),
        NgramExtractor(1),
        NgramExtractor(1, lower_shouting=True),
    ]


def with_channels(entries: DataFrame, extractors: list, spaced_comment: bool = False) -> DataFrame:
    """Add the channel array, with each token list that some extractor needs, made once.

    ``entries`` has ``added``, ``removed`` (arrays) and ``comment``.
    """
    wanted = {f for x in extractors for f in x.fields}

    def widen(c: Column) -> Column:
        parts = [c["channel"].alias("channel"), c["text"].alias("text")]
        if wanted >= {"tokens", "calm"}:
            return bind(tokenize(c["text"]), lambda tokens: F.struct(
                *parts, tokens.alias("tokens"), bind(deshout(c["text"]), lambda calm: calmed(c, tokens, calm)).alias("calm")
            ))
        if "tokens" in wanted:
            parts.append(tokenize(c["text"]).alias("tokens"))
        if "calm" in wanted:
            parts.append(tokenize(deshout(c["text"])).alias("calm"))
        return F.struct(*parts)

    def calmed(c: Column, tokens: Column, calm: Column) -> Column:
        return F.when(calm == c["text"], tokens).otherwise(tokenize(calm))

    plain = text_channels(
        F.col("added"), F.col("removed"), F.col("comment"), spaced_comment=spaced_comment
    )
    return entries.withColumn(CHANNELS, F.transform(plain, widen))


def _channel_rows(prepared: DataFrame, key: str) -> DataFrame:
    # The outer form, as a plain one makes Catalyst filter on the array's size first and so
    # build the array twice. There is always a channel or the row has nothing to give.
    return prepared.select(key, F.inline_outer(CHANNELS)).where("channel is not null")


def _split(extractors: list) -> tuple[list, list]:
    rows = [x for x in extractors if isinstance(x, RowExtractor)]
    return rows, [x for x in extractors if not isinstance(x, RowExtractor)]


def _in_row(extractor: RowExtractor, prefix: str, wrap: Wrap) -> Column:
    return F.flatten(F.transform(CHANNELS, lambda c: extractor.in_row(c, prefix, wrap)))


def _named(fset: str) -> Wrap:
    return lambda f, v: F.struct(
        F.lit(fset).alias("fset"), f.alias("feature"), v.alias("value")
    )


def _plain_twins(extractors: list) -> dict[int, int]:
    """Per n-gram extractor of de-shouted texts the one, if any, that does the same with plain texts."""
    plain = {x.n: i for i, x in enumerate(extractors) if isinstance(x, NgramExtractor) and x.source == "tokens"}
    calm = {i: x.n for i, x in enumerate(extractors) if isinstance(x, NgramExtractor) and x.source == "calm"}
    return {i: plain[n] for i, n in calm.items() if n in plain}


def _with_names(prepared: DataFrame, extractors: list) -> DataFrame:
    """Add ``NAMES`` and a number for each binary extractor: its features' names.

    ``QUIET`` says that no channel shouts. Then the features of a plain twin are those of both; they are
    built once, and the other one has none.
    """
    twins = _plain_twins(extractors)
    quiet = F.forall(CHANNELS, lambda c: c["calm"].eqNullSafe(c["tokens"])) if twins else F.lit(False)
    none = F.array().cast("array<string>")
    names = {f"{NAMES}{i}": _in_row(x, "", only_name) for i, x in enumerate(extractors)}
    names |= {f"{NAMES}{i}": F.when(F.col(QUIET), none).otherwise(names[f"{NAMES}{i}"]) for i in twins}
    return prepared.withColumn(QUIET, quiet).withColumns(names)


def feature_table(
    entries: DataFrame,
    extractors: list,
    key: str = "id",
    spaced_comment: bool = False,
    bits: int | None = None,
) -> DataFrame:
    """All features in long form: ``(key, fset, feature, value)``.

    With ``bits`` there is also ``bucket``, that of the feature's name without its set.
    """
    in_row, joined = _split(extractors)
    prepared = with_channels(entries.select(key, "added", "removed", "comment"), extractors,
                             spaced_comment)

    def hashed(found: DataFrame) -> DataFrame:
        return found if bits is None else found.withColumn("bucket", bucket(F.col("feature"), bits))

    columns = [key, "fset", "feature", "value"] + ([] if bits is None else ["bucket"])
    parts = []
    binary = [x for x in in_row if x.binary]
    if binary:
        # Names are exploded, and hashed, once for all sets that share them.
        twins = _plain_twins(binary)

        def sets(i: int) -> Column:
            mine = F.array(F.lit(binary[i].name()))
            both = [F.lit(binary[j].name()) for j, t in twins.items() if t == i]
            return F.when(F.col(QUIET), F.array(F.lit(binary[i].name()), *both)).otherwise(mine) if both else mine

        of_sets = [
            F.struct(sets(i).alias("fsets"), F.col(f"{NAMES}{i}").alias("names")) for i in range(len(binary))
        ]
        found = _with_names(prepared, binary).select(key, F.inline(F.array(*of_sets)))
        found = hashed(found.select(key, "fsets", F.explode("names").alias("feature")))
        found = found.withColumn("fset", F.explode("fsets")).withColumn("value", F.lit(1.0))
        parts.append(found.select(*columns))
    valued = [_in_row(x, "", _named(x.name())) for x in in_row if not x.binary]
    if valued:
        parts.append(hashed(prepared.select(key, F.inline(F.concat(*valued)))).select(*columns))
    for x in joined:
        found = x.features(_channel_rows(prepared, key), key)
        parts.append(hashed(found.withColumn("fset", F.lit(x.name()))).select(*columns))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


VALUED = "array<struct<idx: int, value: double>>"


def one_per_bucket(present_in: Column, valued: Column | None) -> Column:
    """One value per bucket: 1 where features are present, unless a valued feature (of several
    the greatest) falls into the same bucket.

    ``present_in`` is an array of buckets, ``valued`` one of ``struct<idx, value>``. Sets of
    integers do the work; nothing is sorted but the few valued features.
    """

    def ones(buckets: Column) -> Column:
        return F.transform(buckets, lambda i: F.struct(i.alias("idx"), F.lit(1.0).alias("value")))

    if valued is None:
        return ones(F.array_distinct(present_in)).cast(VALUED)

    def greatest(items: Column) -> Column:
        return F.filter(items, lambda x, i: ~F.get(items, i + 1)["idx"].eqNullSafe(x["idx"]))

    def merged(kept: Column) -> Column:
        return F.concat(ones(F.array_except(present_in, kept["idx"])), kept)

    return bind(bind(F.sort_array(valued.cast(VALUED)), greatest), merged)


def add_vectors(
    entries: DataFrame,
    extractors: list,
    key: str = "id",
    bits: int = 15,
    method: str = "md5",
    spaced_comment: bool = False,
) -> DataFrame:
    """``entries`` with ``vector``: one value per bucket, in no order. Keys are unique, or absent.

    Entries without a key are known by their text when features have to be joined.
    """
    in_row, joined = _split(extractors)

    def only_bucket(key: Column, _: Column) -> Column:
        return bucket(key, bits, method)

    def bucket_and_value(key: Column, value: Column) -> Column:
        return F.struct(
            bucket(key, bits, method).alias("idx"), value.cast("double").alias("value")
        )

    out = entries
    hit_columns = []
    if joined:
        # One shuffle of the text; hits are grouped and joined in this partitioning. The number
        # is fixed as the work is in the texts' features, far larger than the bytes by which
        # AQE would merge partitions.
        parts = int(out.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        by_text = F.md5(F.to_json(F.struct("added", "removed", "comment")))
        known = F.concat(F.lit("key "), F.col(key).cast("string"))
        out = out.withColumn(KNOWN, F.coalesce(known, by_text)).repartition(parts, KNOWN)
        texts = out.select(KNOWN, "added", "removed", "comment")
        for i, x in enumerate(joined):
            rows = _channel_rows(with_channels(texts, [x], spaced_comment), KNOWN)
            found = x.features(rows, KNOWN)
            name = F.concat(F.lit(x.name() + "_"), F.col("feature"))
            item = bucket_and_value(name, F.col("value"))
            hits = found.groupBy(KNOWN).agg(F.collect_list(item).alias(f"_hits{i}"))
            out = out.join(hits, KNOWN, "left")
            hit_columns.append(f"_hits{i}")

    out = with_channels(out, in_row, spaced_comment)
    buckets = [_in_row(x, x.name() + "_", only_bucket) for x in in_row if x.binary]
    values = [_in_row(x, x.name() + "_", bucket_and_value).cast(VALUED) for x in in_row if not x.binary]
    values += [F.coalesce(F.col(c).cast(VALUED), F.array().cast(VALUED)) for c in hit_columns]
    vector = one_per_bucket(
        F.concat(*buckets) if buckets else F.array().cast("array<int>"),
        F.concat(*values) if values else None,
    )
    return out.withColumn("vector", vector).drop(CHANNELS, KNOWN, *hit_columns)


def vector_rows(vectors: DataFrame, key: str = "id") -> DataFrame:
    """Vectors in long form: ``(key, idx, value)``."""
    return vectors.select(key, F.inline_outer("vector")).where("idx is not null")


def vector_map(vector: Column) -> Column:
    """The ``map<bucket, value>`` view of a vector."""
    return F.map_from_entries(vector)


def feature_map(features: DataFrame, key: str = "id") -> DataFrame:
    """The nested view ``map<fset, map<feature, value>>`` of a feature table.

    One map holds one entry's features, so its size is that of one text.
    """
    inner = features.groupBy(key, "fset").agg(
        F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("values")
    )
    return inner.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("fset", "values"))).alias("features")
    )


def with_feature_map(entries: DataFrame, extractors: list, key: str) -> DataFrame:
    """``entries`` with ``features``, the nested view of their feature table; NULL where there are none.

    Features found inside the row stay there; only those of a table are grouped and joined by ``key``.
    """
    in_row, joined = _split(extractors)
    if joined or len({x.name() for x in in_row}) < len(in_row):
        texts = entries.select(key, "added", "removed", "comment")
        return entries.join(feature_map(feature_table(texts, extractors, key), key), key, "left")
    names = [f"_features{i}" for i in range(len(in_row))]
    pairs = [_in_row(x, "", lambda f, v: F.struct(f.alias("feature"), v.alias("value"))) for x in in_row]
    found = with_channels(entries, in_row).withColumns(dict(zip(names, pairs, strict=True)))
    sets = F.array(*[
        F.struct(F.lit(x.name()).alias("fset"), F.map_from_entries(n).alias("values")) for x, n in zip(in_row, names)
    ])
    some = F.filter(sets, lambda s: F.size(s["values"]) > 0)
    known, anything = F.lit(True), F.lit(False)
    for n in names:
        known = known & F.col(n).isNotNull()
        anything = anything | (F.size(n) > 0)
    features = F.when(known & anything & F.col(key).isNotNull(), F.map_from_entries(some))
    return found.withColumn("features", features).drop(CHANNELS, *names)
