"""URL list entries of any depth."""

import datetime as dt

from pyspark.sql import functions as F

from palaver.llm import url_lists


def test_entries_of_every_depth_are_met(spark):
    urls = ["http://example.com", "https://u@Example.com:81/a/b/c?q=/z", "http://example.com//a/b//c/d/e/f#g", "http://example.com/a/b", "http://a.example.com/a/b/c"]
    listed = ["example.com/a/b/c", "example.com/a/b/c/d/e", "example.com/a/b/c/d/e/f/g", "a.example.com/a"]
    day = dt.datetime(2024, 1, 1)
    captures = spark.createDataFrame([(k, u, day) for k, u in enumerate(urls)], "page_id long, url string, fetched_at timestamp_ntz")
    entries = spark.createDataFrame([(f"l{k}", p, day, "add") for k, p in enumerate(listed)], "list string, pattern string, dated timestamp_ntz, action string")

    def prefixes(url):
        host, *segments = [s for s in url.split("://")[1].split("?")[0].split("#")[0].split("/") if s]
        host = host.split("@")[-1].split(":")[0].lower()
        return {"/".join([host, *segments[:i]]) for i in range(len(segments) + 1)}

    want = {k: [f"l{i}" for i, p in enumerate(listed) if p in prefixes(u)] for k, u in enumerate(urls)}
    assert want == {0: [], 1: ["l0"], 2: ["l0", "l1"], 3: [], 4: ["l3"]}
    found = url_lists.evaluate(captures, entries, url_lists.ALL_DEPTHS).collect()
    assert {r.page_id: (r.n_active, r.lists) for r in found} == {k: (len(x), ",".join(x)) for k, x in want.items()}
    hosts = entries.withColumn("pattern", F.lit("example.com"))
    assert [r.blocked for r in url_lists.evaluate(captures, hosts, url_lists.ALL_DEPTHS).orderBy("page_id").collect()] == [True] * 5
