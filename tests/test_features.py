import pytest
from pyspark.sql import functions as F

from palaver.functions.features import Pattern
from palaver.operators import features as fx
from palaver.sources import dictionaries as dic

ENTRIES = ("id int, added array<string>, removed array<string>, comment string")


@pytest.fixture(scope="module")
def entries(spark):
    return spark.createDataFrame(
        [(1, ["{{welcome}}", "Thanks a lot!"], [], ""),
         (2, ["DO NOT POST THE FINAL AIRING OF THAT AGAIN, IT WILL STAY ON AS LONG... ok"], ["x"], "no"),
         (3, [], [], None)], ENTRIES)


def lines(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pattern_dictionary(spark):
    found = dic.pattern_dictionary(lines(
        spark, "# all comment", "a\tx+ # tail", "b\ty\\#z # kept\texpand", "", "  ",
        "c\t(q)\texpand,binary", "d\tr\tbinary"))
    assert {r["name"]: (r["regex"], r["is_binary"], r["is_expanded"]) for r in found.collect()} == {
        "a": ("x+", True, False), "b": ("y\\#z # kept", False, True),
        "c": ("(q)", True, True), "d": ("r", True, False)}
    assert len(dic.plan_patterns(found)) == 4
    with pytest.raises(ValueError):
        dic.plan_patterns(found, limit=3)
    for wrong in ("only", "a\tb\tc\td"):
        with pytest.raises(Exception, match="no name, regex"):
            dic.pattern_dictionary(lines(spark, wrong)).collect()
    with pytest.raises(Exception, match="fewer than five"):
        dic.lexicon_senses(lines(spark, "a\t1\t0.5\t0")).collect()


def test_lexicon(spark):
    senses = dic.lexicon_senses(lines(
        spark, "# c", "a\t1\t0.5\t0\tgood#1 fine#2\tgloss", "n\t2\t0\t0.25\tgood#2\tg",
        "a\t3\t0\t0\tnil#1\tg", "xx\t4\t1\t1\tbad#1\tg"))
    assert sorted(tuple(r) for r in senses.collect()) == [
        ("fine", 0.5, 0.0), ("good", 0.0, 0.25), ("good", 0.5, 0.0)]
    assert {r["word"]: r["score"] for r in dic.lexicon_scores(senses).collect()} == {
        "good": 0.125, "fine": 0.5}


def test_lexicon_features_use_the_threshold_and_lemmas(spark, entries):
    scores = spark.createDataFrame([("Thanks", 0.9), ("a", 0.1), ("lot", -0.5), ("thank", 0.4)],
                                   "word string, score double")
    found = fx.feature_table(entries, [fx.LexiconExtractor(scores, 0.1)])
    assert {(r["id"], r["feature"]): r["value"] for r in found.collect()} == {
        (1, "added_Thanks"): 0.9, (1, "added_lot"): -0.5}
    lemmas = spark.createDataFrame([("Thanks", "thank")], "form string, lemma string")
    found = fx.feature_table(entries, [fx.LexiconExtractor(scores, 0.1, lemmas)])
    assert {r["feature"]: r["value"] for r in found.collect()} == {
        "added_thank": 0.4, "added_lot": -0.5}


def test_empty_channels_give_features_absent_ones_do_not(spark, entries):
    found = fx.feature_table(entries, [fx.NgramExtractor(1)]).where("id <> 2")
    assert {r["feature"] for r in found.where("id = 3").collect()} == {"added_", "removed_"}
    assert {"comment_", "removed_", "added_welcome"} <= {
        r["feature"] for r in found.where("id = 1").collect()}


def test_deshouted_ngrams(spark, entries):
    found = fx.feature_table(entries, [fx.NgramExtractor(1), fx.NgramExtractor(1, True)])
    words = {(r["fset"], r["feature"]) for r in found.where("id = 2").collect()}
    assert ("ngram1", "added_FINAL") in words and ("ngram1_calm", "added_final") in words
    assert ("ngram1_calm", "added_FINAL") not in words


def test_vectors_agree_with_the_feature_table(spark, entries):
    scores = spark.createDataFrame([("Thanks", 0.75), ("lot", -0.5)], "word string, score double")
    extractors = fx.default_extractors(scores, [Pattern("open", "[{]"), Pattern("w", "(w.)", True, True)])
    bits = 4
    found = {}
    for r in fx.vector_rows(fx.add_vectors(entries, extractors, bits=bits)).collect():
        assert (r["id"], r["idx"]) not in found
        found[r["id"], r["idx"]] = r["value"]
    expected = {}
    keyed = fx.feature_table(entries, extractors).withColumn(
        "idx", fx.bucket(F.concat_ws("_", "fset", "feature"), bits))
    for r in keyed.collect():
        at = (r["id"], r["idx"])
        valued = r["fset"] == "lexicon"
        expected[at] = max(expected.get(at, (False, 1.0)), (valued, r["value"]))
    assert found == {k: v for k, (_, v) in expected.items()}


def test_sets_share_the_names_of_texts_that_do_not_shout(spark, entries):
    extractors = [fx.NgramExtractor(n, calm) for n in (2, 1) for calm in (False, True)]
    extractors.append(fx.PatternExtractor([Pattern("open", "[{]"), Pattern("tail", "(w.)come", True, True)]))
    found = fx.feature_table(entries, extractors, bits=7)
    assert found.where(F.col("bucket") != fx.bucket(F.col("feature"), 7)).count() == 0
    rows = sorted(tuple(r)[:4] for r in found.collect())
    apart = [r for x in extractors for r in fx.feature_table(entries, [x]).collect()]
    assert rows == sorted(map(tuple, apart)) and len(rows) > 100


def test_a_pattern_is_tried_only_where_its_literal_stands(spark):
    texts = spark.createDataFrame([("a@b x@y",), ("ab",), ("",), (None,)], "t string")
    mail = Pattern("mail", "([a-z]+)@([a-z]+)", True, True)
    columns = [f(F.lit("c"), F.col("t"), [mail]) for f in (fx.pattern_presence, fx.pattern_matches)]
    found = texts.select(*columns)
    assert [tuple(r) for r in found.collect()] == [
        (["mail_c"], ["mail_c_a_b", "mail_c_x_y"]), ([], []), ([], []), ([], None)]
    assert plan_of(found).count("Contains(") + plan_of(found).count("contains(") >= 2


def test_nested_views(spark, entries):
    maps = fx.feature_map(fx.feature_table(entries, [fx.NgramExtractor(1)])).where("id = 3")
    assert maps.first()["features"] == {"ngram1": {"added_": 1.0, "removed_": 1.0}}
    vectors = fx.add_vectors(entries, [fx.NgramExtractor(1)])
    assert len(vectors.select(fx.vector_map(F.col("vector"))).where("id = 3").first()[0]) == 2


def test_row_extractors_shuffle_nothing(spark, entries):
    extractors = [fx.NgramExtractor(2), fx.NgramExtractor(1, True), fx.PatternExtractor([])]
    assert "Exchange" not in plan_of(fx.feature_table(entries, extractors))
    assert "Exchange" not in plan_of(fx.add_vectors(entries, extractors))


def test_a_lexicon_costs_one_partitioning_by_key(spark, entries):
    scores = spark.createDataFrame([("a", 0.9)], "word string, score double")
    small = fx.LexiconExtractor(F.broadcast(scores))
    vectors = fx.add_vectors(entries, [fx.NgramExtractor(1), small])
    plan = plan_of(vectors)
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") == 2


class ValuedExtractor:
    binary, fields = False, ()

    def name(self):
        return "size"

    def in_row(self, channel, prefix, wrap):
        name = F.concat(F.lit(prefix), channel["channel"], F.lit("_size"))
        return F.array(wrap(name, F.length(channel["text"]) / 2.0))


def test_a_users_own_valued_extractor(spark, entries):
    vectors = fx.add_vectors(entries, [ValuedExtractor(), fx.NgramExtractor(1)])
    row = vectors.where("id = 2").first()
    assert 0.5 in {v["value"] for v in row["vector"]}
    table = fx.feature_table(entries, [ValuedExtractor()]).where("id = 2 and feature = 'removed_size'")
    assert table.first()["value"] == 0.5


@pytest.mark.parametrize("regex,groups", [
    ("(a)(b(c))", 3), (r"\(a\)(b)", 1), ("(?:a)(?=b)(?<=c)(?<!d)(?i)x", 0), ("(?<w>a+)(b)", 2),
    ("[(](a)[])(]", 1), (r"[\](](a)", 1), (r"\Q(x)\E(a)", 1), ("[a&&[(b)]](c)", 1), ("", 0),
])
def test_groups_are_counted_as_java_does(spark, regex, groups):
    assert Pattern("p", regex).groups == groups
    matcher = spark._jvm.java.util.regex.Pattern.compile(regex).matcher("")
    assert matcher.groupCount() == groups


def test_other_dialects_are_refused():
    with pytest.raises(ValueError, match="named group"):
        Pattern("p", "(?P<w>a)").groups


def test_features_of_a_row_are_stored_without_a_shuffle(spark):
    from palaver.plans.stored import with_features

    rows = [(1, ["a b a"], ["c"], "d"), (1, ["a b a"], ["c"], "d"), (None, ["e f"], [], "g"), (3, [], [], "")]
    texts = spark.createDataFrame(rows, "rev_id long, added array<string>, removed array<string>, comment string")
    docs = texts.select(F.struct(
        F.struct("rev_id").alias("id"), "comment", F.struct("added", "removed").alias("content")).alias("entry"))
    extractors = [fx.NgramExtractor(2), fx.NgramExtractor(1)]
    found = with_features(docs, extractors)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    single = texts.where("rev_id = 3").select(F.lit("x").alias("id"), "added", "removed", "comment")
    plain = fx.feature_map(fx.feature_table(single, extractors)).collect()[0]["features"]
    mine = {r["entry"]["id"]["rev_id"]: r["features"] for r in found.collect()}
    assert mine[3] == plain
    assert set(mine[1]["ngram1"]) == {"added_a", "added_b", "removed_c", "comment_d"}
    assert set(mine[None]["ngram1"]) >= {"added_e", "added_f", "comment_g"}
