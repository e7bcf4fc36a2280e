"""Many patterns at once give what each gives by itself."""

import re
import time

import pytest
from pyspark.sql import functions as F

from palaver.functions.features import Pattern, pattern_matches, pattern_presence
from palaver.functions.many_patterns import literal_tree, looked_for, many_pattern_features, mandatory_literal


@pytest.mark.parametrize(("regex", "literal"), [
    ("thanks", "thanks"), ("thank(s|you)", "thank"), ("colou?r", "colo"), ("go+gle", "gle"), ("ab*cde", "cde"),
    ("a|b", None), ("(?i)abc", None), (r"\bword\b", "word"), (r"\d+ years", " years"), ("ab{0,2}cde", "cde"),
    (r"\Qa.b\E", None), (r"\x41bc", None), ("[a-c]def[^]x]", None), ("[a-c]def", "def"), (r"\[\[user:", "[[user:"),
    ("x(?=abc)yz", "yz"), ("(?x: a b)cde", None), ("(a(b)c)?def", "def"), ("ab+?cd", "ab"), ("", None),
    ("((?i)abc)defg", None), ("abc)", None), ("(abc", None), (r"(\()abc", "abc"), ("[(]abc", "abc"),
])
def test_literals_every_match_contains(regex, literal):
    assert mandatory_literal(regex) == literal


def test_the_tree_finds_every_literal():
    patterns = [Pattern(str(i), x) for i, x in enumerate(["abc", "abcdef", "abd", "a.b", r"x\.yz", "\nab", "ü-ü"])]
    wanted = looked_for(patterns)
    assert wanted == ["abc", "abc", "abd", None, "x.yz", "\nab", "ü-ü"]
    found = {m for text in ["abcdef x.yz", "xabd", "x-yz \nab", "ü-ü"] for m in re.findall(
        f"(?=({literal_tree([w for w in dict.fromkeys(wanted) if w])}))", text)}
    assert found == {"abc", "x.yz", "abd", "\nab", "ü-ü"}


PATTERNS = [
    Pattern("plain", "thanks"), Pattern("either", "cat|dog"), Pattern("loud", "(?i)HELLO"),
    Pattern("pair", r"(\w+) loves (\w+)", binary=False, expand=True), Pattern("both", r"x(y?)z", True, True),
    Pattern("none", "tt+t", False, True), Pattern("opt", "ab(c)?d", False, True), Pattern("long", "abcdefghijkl"),
    Pattern("again", "thanks"), Pattern("quote", r'"\d+"'), Pattern("longer", "thanksgiving"),
]
TEXTS = ["", "thanks", "a cat", "Hello", "anna loves bob, bob loves anna, anna loves bob", "xz xyz", "ttt", "abd abcd",
         "abcdefghijkl", "abcdefgh", '"12" thanksgiving', "ab " * 5000 + "thanks", "xyz\nhello loves é"]


def features(df, column):
    return {r["t"]: r["f"] for r in df.select("t", column.alias("f")).collect()}


def test_equal_to_one_by_one(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    where, text = F.lit("added"), F.col("t")
    alone = F.concat(pattern_presence(where, text, PATTERNS, "p_"), pattern_matches(where, text, PATTERNS, "p_"))
    assert features(df, many_pattern_features(where, text, PATTERNS, "p_")) == features(df, alone)
    unlettered = [p for p in PATTERNS if mandatory_literal(p.regex) is None]
    assert features(df, many_pattern_features(where, text, unlettered)) == features(df, F.concat(
        pattern_presence(where, text, unlettered), pattern_matches(where, text, unlettered)))


def test_a_thousand_patterns_cost_little_more_than_ten(spark):
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(150)), lambda i: F.concat(
        F.lit("w"), ((F.col("id") * 31 + i * 17) % 5003).cast("string"), F.lit("q"))))
    df = spark.range(4000).select(text.alias("t")).cache()
    df.count()

    def seconds(n):
        patterns = [Pattern(f"p{i}", f"w{i * 5}q( w[0-9])?") for i in range(n)]
        column = F.size(many_pattern_features(F.lit("c"), F.col("t"), patterns))
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            total = df.select(F.sum(column)).first()[0]
            runs.append(time.perf_counter() - start)
        assert total > 0
        return min(runs)

    assert seconds(1000) < 5 * max(seconds(10), 0.5)
