import pytest
from pyspark.sql import functions as F

from palaver.operators.entries import attach_revisions, shape_entries
from palaver.plans.ingest import coded_entries, store, unfilled, with_revisions
from palaver.sources import delimited, documents, registry, revisions
from palaver.streaming.ingest import ingest_stream, still_pending, stored_entries


def test_delimited_cells_survive(spark, tmp_path):
    cells = [("1", 'a "quoted", cell', None), ("2", "two\nlines\\n", " spaced "), ("3", "tab\t", "é")]
    df = spark.createDataFrame(cells, "id string, text string, note string")
    comma, tab = str(tmp_path / "comma"), str(tmp_path / "tab")
    delimited.write_delimited(df, comma)
    delimited.transcode(spark, comma, tab, ",", "\t")
    back = delimited.read_delimited(spark, tab, "\t", header=True)
    assert back.columns == df.columns
    assert sorted(tuple(r) for r in back.collect()) == cells
    assert back.select(delimited.nth(back, 2)).columns == ["text"]


@pytest.mark.parametrize("line_end", ["\n", "\r\n", "\r"])
def test_line_ends_blank_lines_and_several_files(spark, tmp_path, line_end):
    for name, rows in (("a", ["id,t", "1,x", "", '2,"y z"']), ("b", ["id,t", "3,", "4"])):
        (tmp_path / f"{name}.csv").write_bytes(line_end.join(rows + [""]).encode())
    paths = [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]
    found = delimited.read_delimited(spark, paths, header=True)
    assert sorted(tuple(r) for r in found.collect()) == [
        ("1", "x"), ("2", "y z"), ("3", None), ("4", None)]


def test_a_written_registry_is_read_by_label(spark, tmp_path):
    weights = spark.createDataFrame(
        [("a", {"cv": "1"}, 3, 0.5), ("b", {"cv": "2"}, 4, 1.5)],
        "label string, tags map<string,string>, idx int, weight double",
    ).withColumn("trained_at", F.lit("2011-01-01").cast("timestamp"))
    registry.write_registry(weights, str(tmp_path / "r"))
    back = registry.read_registry(spark, str(tmp_path / "r")).where("label = 'b'")
    assert [(r["idx"], r["weight"]) for r in registry.load_models(back, {"cv": 2}).collect()] == [
        (4, 1.5)]
    assert "label" in back._jdf.queryExecution().executedPlan().toString().split(
        "PartitionFilters")[1]


def test_upsert_takes_the_last_of_each_key(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, n int")
    found = documents.upsert(old, new, ["k"], [F.col("n")])
    assert sorted(tuple(r) for r in found.collect()) == [(1, "a"), (2, "y"), (3, "z")]


def test_set_field_on_present_and_absent_paths(spark):
    docs = spark.createDataFrame([(1, (5, "p")), (2, (6, "q"))], "k int, s struct<a: int, b: string>")
    values = spark.createDataFrame([(1, 9)], "k int, value int")
    found = documents.set_field(docs, values, ["k"], "s.a").orderBy("k").collect()
    assert [tuple(r["s"]) for r in found] == [(9, "p"), (6, "q")]
    found = documents.set_field(docs, values, ["k"], "internal.slice").orderBy("k").collect()
    assert found[0]["internal"]["slice"] == 9 and found[1]["internal"] is None
    found = documents.set_field(docs, values, ["k"], "top").orderBy("k").collect()
    assert [r["top"] for r in found] == [9, None]


def test_scan_reads_only_the_fields_asked_for(spark, tmp_path):
    rows = spark.createDataFrame([("7", "hello", "1")], "id string, text string, good string")
    shaped = shape_entries(rows, {"rev_id": "id"}, {"good": "good"}, "text")
    shaped.write.parquet(str(tmp_path / "e"))
    found = documents.scan_entries(spark, str(tmp_path / "e"), F.col("labels").isNotNull(),
                                   ["entry.id.rev_id"])
    assert [tuple(r) for r in found.collect()] == [(7,)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "added" not in plan.split("ReadSchema")[1] and "IsNotNull(labels)" in plan


def test_models_are_replaced_by_label_and_tags(spark):
    empty = spark.createDataFrame([], "label string, tags map<string,string>, idx int, "
                                      "weight double, trained_at timestamp")

    def trained(label, w):
        return spark.createDataFrame([(label, 1, w)], "label string, idx int, weight double") \
            .withColumn("trained_at", F.lit("2011-01-01").cast("timestamp"))

    kept = registry.save_models(empty, trained("a", 1.0), ["a"], {"cv": 1})
    kept = registry.save_models(kept, trained("a", 2.0), ["a"], {"cv": 2})
    kept = registry.save_models(kept, trained("a", 3.0), ["a"], {"cv": 1})
    assert [r["weight"] for r in registry.load_models(kept, {"cv": 1}).collect()] == [3.0]
    plain = registry.save_models(kept, trained("a", 4.0), ["a"], {})
    assert sorted(r["weight"] for r in plain.collect()) == [2.0, 3.0, 4.0]
    later = trained("a", 5.0).withColumn("trained_at", F.lit("2012-01-01").cast("timestamp"))
    plain = registry.save_models(plain, later, ["a"], {"cv": 7})
    assert [r["weight"] for r in registry.load_models(plain).collect()] == [5.0]


def response(title, *revs):
    body = "".join(
        f'<rev revid="{i}" user="U{i}" comment="c" timestamp="2011-02-03T04:05:06Z" size="9">'
        + ('<diff notcached="" />' if diff is None else f"<diff>{diff}</diff>") + "</rev>"
        for i, diff in revs)
    return (f'<api><query><pages><page title="{title}"><revisions>{body}</revisions></page>'
            "</pages></query></api>",)


ADDED = '&lt;td class="diff-addedline"&gt;hi&lt;/td&gt;'


def coded(spark):
    rows = spark.createDataFrame([("1", "1"), ("2", "0"), ("3", "?"), ("x", "1")],
                                 "rev string, good string")
    return coded_entries(rows, "rev", {"good": "good"})


def test_revisions_fill_entries_and_pending_ones_wait(spark):
    xml = spark.createDataFrame([response("T", (1, ADDED), (2, None)), response("S", (3, ""))],
                                "xml string")
    twice = with_revisions(coded(spark), xml.union(xml))
    assert twice.count() == 3
    assert {r["rev_id"]: r["pending"] for r in revisions.revision_rows(xml).collect()} == {
        1: False, 2: True, 3: False}
    found = {r["entry"]["id"]["rev_id"]: r for r in with_revisions(coded(spark), xml).collect()}
    assert set(found) == {1, 2, 3}
    assert found[1]["entry"]["content"]["added"] == ["hi"] and found[1]["labels"] == {"good": True}
    assert found[2]["entry"]["title"] is None and found[2]["entry"]["comment"] == ""
    assert found[3]["entry"]["sender"] == "U3" and found[3]["entry"]["content"]["added"] == []
    assert found[3]["labels"] is None


def test_a_malformed_response_is_not_lost_silently(spark):
    bad = spark.createDataFrame([("<api><query>",)], "xml string")
    with pytest.raises(Exception, match="(?i)malformed"):
        revisions.revision_rows(bad).collect()
    assert revisions.revision_rows(bad, mode="PERMISSIVE").collect() == []


def test_stored_entries_are_skipped_or_replaced(spark):
    xml = spark.createDataFrame([response("T", (1, ADDED), (2, None))], "xml string")
    stored = store(coded(spark).limit(0), with_revisions(coded(spark).where("entry.id.rev_id < 3"), xml))
    rows = spark.createDataFrame([("1", "1"), ("2", "1"), ("3", "1")], "rev string, good string")
    left = coded_entries(rows, "rev", {"good": "good"}, stored=stored, skip=True)
    assert sorted(r["entry"]["id"]["rev_id"] for r in left.collect()) == [2, 3]
    assert sorted(r["rev_id"] for r in unfilled(left).collect()) == [2, 3]
    every = coded_entries(rows, "rev", {"good": "good"})
    kept = {r["entry"]["id"]["rev_id"]: r["entry"]["content"]["added"] for r in store(stored, every).collect()}
    assert kept == {1: ["hi"], 2: [], 3: []}


def test_ids_that_are_no_numbers_stay_apart(spark):
    rows = spark.createDataFrame([("12a", "1", "7"), ("13b", "0", "07"), ("12a", "1", "8")], "rev string, good string, part string")
    entries = coded_entries(rows, {"rev_id": "rev", "part": "part"}, {"good": "good"}, "good")
    stored = store(entries.limit(0), entries)
    assert stored.count() == 3
    assert coded_entries(rows, {"rev_id": "rev", "part": "part"}, {}, "good", stored, skip=True).count() == 0


def test_stream_asks_again_for_pending_revisions(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    entries = coded(spark).drop("rev_id")

    def arrive(*responses):
        spark.createDataFrame(list(responses), "xml string").write.mode("append").parquet(source)
        stream = spark.readStream.schema("xml string").parquet(source)
        ingest_stream(stream, entries, target, str(tmp_path / "ck")).start().awaitTermination()

    arrive(response("T", (1, ADDED), (2, None)))
    assert [r["rev_id"] for r in still_pending(spark, target).collect()] == [2]
    arrive(response("T", (2, ADDED)))
    assert still_pending(spark, target).count() == 0
    found = stored_entries(spark, target).collect()
    assert sorted(r["entry"]["id"]["rev_id"] for r in found) == [1, 2]
