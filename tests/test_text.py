import random

from pyspark.sql import functions as F

from palaver.functions import keys, text as tx
from palaver.functions.features import Pattern, bucket, ngrams, pattern_matches, pattern_presence


def values(spark, texts, expression):
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    return [r[0] for r in rows.select("n", expression.alias("x")).orderBy("n").select("x").collect()]


def shouting_by_hand(s):
    best, at, run = 0, 0, 0
    for i, c in enumerate(s):
        run = 0 if c != c.upper() else run + 1
        if run and run >= best:
            best, at = run, i - run + 1
    return s[:at] + s[at:at + best].lower() + s[at + best:] if best > 50 else s


def test_deshout_equals_a_scan_by_character(spark):
    rnd = random.Random(5)
    texts = ["", "x", "A" * 50, "A" * 51, "a" + "B" * 60 + "c" + "D" * 60 + "e", "É" * 51 + "é"]
    for _ in range(200):
        parts = [
            "".join(rnd.choice("ABÉ !?1" if up else "abé") for _ in range(rnd.randint(1, n)))
            for up, n in [(rnd.random() < 0.6, rnd.choice([3, 70])) for _ in range(6)]
        ]
        texts.append("".join(parts))
    assert values(spark, texts, tx.deshout(F.col("t"))) == [shouting_by_hand(t) for t in texts]


def test_sharp_s_does_not_end_a_shout(spark):
    text = "STRAßE " * 8
    assert values(spark, [text], tx.deshout(F.col("t"))) == [text.lower()]


def test_tokens_keep_empty_ones(spark):
    assert values(spark, ["", " a", "a{b}c", "it's>\n"], tx.tokenize(F.col("t"))) == [
        [""], ["", "a"], ["a", "b", "c"], ["it", "s", "", ""]]


def test_lexicon_tokens_drop_empty_and_cut_one_mark(spark):
    found = values(spark, ["wow!! (well, ok) ?"], tx.lexicon_tokens(tx.tokenize(F.col("t"))))
    assert found == [["wow!", "well", "ok", ""]]


def test_ngrams_are_padded_and_distinct(spark):
    def grams(n):
        return ngrams(F.lit("c"), tx.tokenize(F.col("t")), n)

    assert values(spark, ["", "a b a b"], grams(1)) == [["c_"], ["c_a", "c_b"]]
    assert values(spark, ["", "a b a b"], grams(2)) == [
        ["c_<>_", "c__<>"], ["c_<>_a", "c_a_b", "c_b_a", "c_b_<>"]]
    assert values(spark, ["a"], grams(3)) == [["c_<>_<>_a", "c_<>_a_<>", "c_a_<>_<>"]]


def test_patterns(spark):
    ps = [Pattern("hi", "hel+o"), Pattern("kv", "(a.)=(\\d)", False, True),
          Pattern("end", "z\\b", True, True)]
    assert values(spark, ["hello z", "ab=1 ac=2 ab=1", ""],
                  pattern_presence(F.lit("c"), F.col("t"), ps)) == [["hi_c", "end_c"], [], []]
    assert values(spark, ["hello z", "ab=1 ac=2 ab=1", ""],
                  pattern_matches(F.lit("c"), F.col("t"), ps)) == [
        ["end_c"], ["kv_c_ab_1", "kv_c_ac_2"], []]


def test_diff_takes_spans_or_the_whole_cell(spark):
    diff = ('<td class="diff-addedline">x <span class="diffchange">a\n</span> y '
            '<span class="diffchange">b</span></td><td class="diff-deletedline">gone</td>'
            '<td class="diff-addedline">whole &lt;</td>')
    (content,) = values(spark, [diff], tx.diff_content(F.col("t")))
    assert content["added"] == ["a\n", "b", "whole &lt;"]
    assert content["removed"] == ["gone"]


def test_channels_skip_what_is_absent(spark):
    none = F.lit(None).cast("array<string>")
    channels = tx.text_channels(F.array(F.col("t"), F.lit("y")), none, F.lit("ab"), True)
    assert [tuple(c) for c in values(spark, ["x"], channels)[0]] == [
        ("added", "x y"), ("comment", "a b")]


def test_snippet_and_links(spark):
    assert values(spark, ["abcdef"], tx.snippet(F.array("t"), 3)) == ['"abc"']
    assert values(spark, ["a"], tx.snippet(F.lit(None).cast("array<string>"))) == ["(empty)"]
    assert values(spark, [None], tx.short_revision_link(F.col("t")))[0].endswith("oldid=None")


def test_keys(spark):
    cells = ["7", "007", " 7", "7.5", "x", ""]
    assert values(spark, cells, keys.int_if(F.col("t"))) == ["7", "7", "7", "7.5", "x", ""]
    assert values(spark, ["1", "0", "", "2", None], keys.label_bool(F.col("t"))) == [
        True, False, None, None, None]
    assert values(spark, ["7a", "a7", ""], keys.starts_with_digit(F.col("t"))) == [
        True, False, False]
    rows = spark.createDataFrame([(c,) for c in ["b", "10", "9", "a"]], "t string")
    ordered = rows.orderBy(keys.int_if_order(F.col("t"))).collect()
    assert [r["t"] for r in ordered] == ["9", "10", "a", "b"]


def test_wikidate_round_trip(spark):
    ts = keys.parse_wikidate(F.col("t"))
    assert values(spark, ["20110101000005"], keys.format_wikidate(keys.shift_seconds(ts, -10))) == [
        "20101231235955"]


def test_buckets_stay_in_range(spark):
    for method in ("md5", "xxhash64"):
        found = values(spark, [str(i) for i in range(2000)], bucket(F.col("t"), 4, method))
        assert set(found) == set(range(1, 17))
