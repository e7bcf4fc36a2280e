"""Pattern dictionaries, sentiment lexicons and lemma tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.functions.features import Pattern


def strip_comment(line: Column) -> Column:
    """Cut from the first ``#`` on, unless that one is written ``\\#``."""
    first = F.locate("#", line)
    escaped = F.locate("\\#", line)
    keep = (first == 0) | ((first > 1) & (escaped + 1 == first))
    return F.when(keep, line).otherwise(F.substring(line, F.lit(1), first - 1))


def pattern_dictionary(lines: DataFrame, column: str = "value") -> DataFrame:
    """``name⇥regex[⇥flags]`` lines to ``(name, regex, is_binary, is_expanded)``.

    A line of another number of fields stops the job.
    """
    text = F.regexp_replace(strip_comment(F.col(column)), r"^\s+|\s+\z", "")
    parts = lines.select(F.split(text, "\t", -1).alias("p"), text.alias("t")).where("t <> ''")
    flags = F.when(F.size("p") == 3, F.col("p")[2]).otherwise(F.lit(""))
    wrong = F.raise_error(F.concat(F.lit("no name, regex and flags: "), "t"))
    whole = F.when(F.size("p").isin(2, 3), F.col("p")).otherwise(wrong.cast("array<string>"))
    return parts.withColumn("p", whole).select(
        F.col("p")[0].alias("name"),
        F.col("p")[1].alias("regex"),
        (flags.contains("binary") | (flags == "")).alias("is_binary"),
        flags.contains("expand").alias("is_expanded"),
    )


def read_pattern_file(spark: SparkSession, path: str) -> DataFrame:
    return pattern_dictionary(spark.read.text(path))


def plan_patterns(dictionary: DataFrame, limit: int = 10_000) -> list[Pattern]:
    """The dictionary as plan-time patterns; they become literals of the feature expressions.

    A dictionary is hand-written and small. A larger one than ``limit`` is refused rather than
    cut.
    """
    rows = dictionary.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} patterns")
    return [Pattern(r["name"], r["regex"], r["is_binary"], r["is_expanded"]) for r in rows]


def lexicon_senses(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lexicon lines to one row per word sense with a score: ``(word, pos, neg)``.

    Lines whose first field is not one character are none of the lexicon's; one of these with fewer
    than five fields stops the job.
    """
    cells = F.split(F.col(column), "\t", -1)
    short = F.raise_error(F.concat(F.lit("fewer than five fields: "), F.array_join("c", "|")))
    return (
        lines.where(~F.col(column).startswith("#"))
        .select(cells.alias("c"))
        .where(F.length(F.get("c", F.lit(0))) == 1)
        .select(F.when(F.size("c") >= 5, F.col("c")).otherwise(short.cast("array<string>")).alias("c"))
        .select(
            F.col("c")[2].cast("double").alias("pos"),
            F.col("c")[3].cast("double").alias("neg"),
            F.explode(F.split(F.col("c")[4], " ", -1)).alias("term"),
        )
        .where("pos <> 0 or neg <> 0")
        .select(F.substring_index("term", "#", 1).alias("word"), "pos", "neg")
    )


def lexicon_scores(senses: DataFrame) -> DataFrame:
    """Mean polarity per word over all its senses and parts of speech."""
    return senses.groupBy("word").agg(F.avg(F.col("pos") - F.col("neg")).alias("score"))


def read_lexicon_file(spark: SparkSession, path: str) -> DataFrame:
    return lexicon_scores(lexicon_senses(spark.read.text(path)))
