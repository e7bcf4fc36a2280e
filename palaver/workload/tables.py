"""Source, filter, label and table-join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.functions.text import ADDED_CELL, REMOVED_CELL
from palaver.operators import filters, joins, labels, metrics
from palaver.operators.entries import label_map, shape_entries
from palaver.plans import ingest
from palaver.plans.ingest import coded_entries, with_revisions
from palaver.functions.keys import label_bool
from palaver.session import scratch_path, written
from palaver.sources import delimited, documents, revisions, store
from palaver.streaming.retries import ASK, keyed_state, retry_events
from palaver.workload.inputs import table, texts
from palaver.workload.registry import query

CODED = "doc_id string, text string, lang string"


@query("csv_scan", "SELECT doc_id::VARCHAR AS doc_id, text, lang FROM documents")
def csv_scan(spark, sf_dir):
    path = scratch_path(spark, "csv")
    delimited.write_delimited(texts(spark, sf_dir).select("doc_id", "text", "lang"), path)
    return delimited.read_delimited(spark, path, header=True, schema=CODED)


@query("csv_multi_scan", """
SELECT doc_id::VARCHAR AS doc_id, quality::VARCHAR AS quality, toxic::VARCHAR AS toxic
FROM labels UNION ALL SELECT item_id::VARCHAR, 'item', NULL FROM benchmark""")
def csv_multi_scan(spark, sf_dir):
    first, second = scratch_path(spark, "fold"), scratch_path(spark, "fold")
    delimited.write_delimited(table(spark, sf_dir, "labels"), first, "\t")
    items = table(spark, sf_dir, "benchmark").select(
        "item_id", F.lit("item"), F.lit(None).cast("string")
    )
    delimited.write_delimited(items, second, "\t")
    return delimited.read_delimited(
        spark, [first, second], "\t", header=True,
        schema="doc_id string, quality string, toxic string",
    )


@query("csv_roundtrip", "SELECT doc_id::VARCHAR AS doc_id, text, lang FROM documents")
def csv_roundtrip(spark, sf_dir):
    comma, tab = scratch_path(spark, "comma"), scratch_path(spark, "tab")
    delimited.write_delimited(
        texts(spark, sf_dir).select("doc_id", "text", "lang"), comma, header=False
    )
    delimited.transcode(spark, comma, tab, ",", "\t", header=False)
    rows = delimited.read_delimited(spark, tab, "\t", schema=CODED)
    return rows.select(
        *[delimited.nth(rows, i).alias(c) for i, c in enumerate(rows.columns, 1)]
    )


@query("csv_ragged", """
SELECT concat_ws(chr(9), doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN source END,
    CASE WHEN doc_id % 3 = 0 THEN replace('~a ' || chr(9) || ' ~~b~~~', '~', chr(34)) END,
    CASE WHEN doc_id % 6 = 0 THEN 'x,y' END) AS line FROM documents WHERE doc_id % 7 <> 1""")
def csv_ragged(spark, sf_dir):
    """Rows of two, four and five cells and blank lines, from commas to tabs."""
    comma, tab = scratch_path(spark, "comma"), scratch_path(spark, "tab")
    third = F.pmod("doc_id", F.lit(3)) == 0
    line = F.concat_ws(
        ",", F.col("doc_id").cast("string"), "lang", F.when(third, F.col("source")),
        F.when(third, F.lit('"a \t ""b"""')), F.when(F.pmod("doc_id", F.lit(6)) == 0, F.lit('"x,y"')),
    )
    lines = table(spark, sf_dir, "documents").select(
        F.when(F.pmod("doc_id", F.lit(7)) == 1, F.lit("")).otherwise(line).alias("value")
    )
    lines.write.text(comma)
    delimited.transcode(spark, comma, tab, ",", "\t")
    return spark.read.text(tab).withColumnRenamed("value", "line")


@query("csv_line_breaks", """
SELECT doc_id::VARCHAR AS doc_id, replace(text, ' ', chr(10)) || chr(10) || '"' || lang || '",' AS text,
    CASE WHEN doc_id % 3 <> 0 THEN chr(13) || chr(10) || source END AS note FROM documents""")
def csv_line_breaks(spark, sf_dir):
    """Every word on a line of its own, quotes and delimiters at the ends of lines."""
    path = scratch_path(spark, "breaks")
    text = F.concat(F.replace("text", F.lit(" "), F.lit("\n")), F.lit('\n"'), "lang", F.lit('",'))
    note = F.when(F.pmod("doc_id", F.lit(3)) != 0, F.concat(F.lit("\r\n"), "source"))
    rows = texts(spark, sf_dir).select("doc_id", text.alias("text"), note.alias("note"))
    delimited.write_delimited(rows, path)
    return delimited.read_delimited(spark, path, header=True, schema="doc_id string, text string, note string",
                                    split_above=0)


@query("csv_one_column", """
SELECT CASE WHEN doc_id % 3 = 2 THEN lang END AS cell FROM documents""")
def csv_one_column(spark, sf_dir):
    path = scratch_path(spark, "one")
    kind = F.pmod("doc_id", F.lit(3))
    cell = F.when(kind == 1, F.lit("")).when(kind == 2, F.col("lang"))
    delimited.write_delimited(table(spark, sf_dir, "documents").select(cell.alias("cell")), path)
    return delimited.read_delimited(spark, path, header=True, schema="cell string")


def _documents(spark, sf_dir):
    """Documents under the entry schema, with coded labels where there are any."""
    coded = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("_id"),
        *[F.col(c).cast("string").alias(c) for c in ("quality", "toxic")],
    )
    rows = texts(spark, sf_dir).join(coded, F.col("doc_id") == F.col("_id"), "left")
    shaped = F.struct(
        F.struct(F.col("doc_id").alias("rev_id")).alias("id"),
        F.col("source").alias("title"),
        F.col("lang").alias("sender"),
        F.lit("").alias("comment"),
        F.lit(None).cast("timestamp").alias("timestamp"),
        F.col("n_chars").cast("int").alias("size"),
        F.struct(
            F.array("text").alias("added"), F.array().cast("array<string>").alias("removed")
        ).alias("content"),
    )
    return rows.select(
        shaped.alias("entry"),
        label_map({c: F.col(c) for c in ("quality", "toxic")}).alias("labels"),
        F.struct(F.pmod("doc_id", F.lit(5)).cast("int").alias("slice")).alias("internal"),
    )


@query("entry_scan", """
SELECT d.doc_id AS entry_id_rev_id, source AS entry_title, n_chars::INTEGER AS entry_size
FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE n_chars > 500""")
def entry_scan(spark, sf_dir):
    path = scratch_path(spark, "entries")
    _documents(spark, sf_dir).write.parquet(path)
    return documents.scan_entries(
        spark, path, F.col("labels").isNotNull() & (F.col("entry.size") > 500),
        ["entry.id.rev_id", "entry.title", "entry.size"],
    )


@query("upsert_by_key", """
WITH n AS (SELECT o_custkey AS id, o_orderstatus AS origin, o_totalprice AS amount FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey
        ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
SELECT c_custkey AS id, c_mktsegment AS origin, c_acctbal AS amount FROM customer
WHERE c_custkey NOT IN (SELECT id FROM n) UNION ALL SELECT * FROM n""")
def upsert_by_key(spark, sf_dir):
    stored = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("origin"),
        F.col("c_acctbal").alias("amount"),
    )
    incoming = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("origin"),
        F.col("o_totalprice").alias("amount"), "o_orderdate", "o_orderkey",
    )
    return documents.upsert(
        stored, incoming, ["id"], [F.col("o_orderdate"), F.col("o_orderkey")]
    )


@query("set_field", """
SELECT d.doc_id AS id, coalesce(l.quality + 10, d.doc_id % 5)::INTEGER AS slice,
    d.source AS title FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def set_field(spark, sf_dir):
    docs = _documents(spark, sf_dir).withColumn("rev_id", F.col("entry.id.rev_id"))
    values = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("rev_id"), (F.col("quality") + 10).alias("value")
    )
    return documents.set_field(docs, values, ["rev_id"], "internal.slice").select(
        F.col("rev_id").alias("id"), "internal.slice", F.col("entry.title").alias("title")
    )


STORE_BUCKETS = 256

STORED_SQL = f"""
WITH d AS (SELECT *, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % {STORE_BUCKETS} AS b FROM documents),
t AS (SELECT DISTINCT b FROM d WHERE {{touched}})
SELECT doc_id, {{value}}, b IN (SELECT b FROM t) AS rewritten FROM d"""


def _stored(spark, sf_dir):
    path = scratch_path(spark, "collection")
    docs = texts(spark, sf_dir).select("doc_id", "lang", F.struct("source", "n_chars").alias("entry"))
    return path, store.create(docs, path, ["doc_id"], STORE_BUCKETS)


def _with_rewritten(spark, first, last, *columns):
    """The documents of ``last``, each with whether its file is another one than in ``first``."""
    file = F.col("_metadata.file_path").alias("_file")
    old = first.read(spark).select(file).distinct().withColumn("_old", F.lit(True))
    now = last.read(spark).select("doc_id", *columns, file)
    return now.join(old, "_file", "left").select("doc_id", *columns, F.col("_old").isNull().alias("rewritten"))


@query("stored_upsert", STORED_SQL.format(
    touched="doc_id % 100 = 7", value="CASE WHEN doc_id % 100 = 7 THEN upper(lang) ELSE lang END AS lang"))
def stored_upsert(spark, sf_dir):
    """One document in a hundred comes anew, some twice; the files of untouched buckets stay."""
    path, first = _stored(spark, sf_dir)
    new = first.read(spark).where("doc_id % 100 = 7")
    stale = new.where("doc_id % 200 = 7").withColumn("lang", F.lit("stale")).withColumn("_at", F.lit(1))
    fresh = new.withColumn("lang", F.upper("lang")).withColumn("_at", F.lit(2))
    last = store.upsert_stored(spark, path, fresh.unionByName(stale), [F.col("_at")])
    return _with_rewritten(spark, first, last, "lang")


@query("stored_set_field", STORED_SQL.format(
    touched="doc_id % 100 = 11",
    value="CASE WHEN doc_id % 100 = 11 THEN -n_chars ELSE n_chars END::BIGINT AS size"))
def stored_set_field(spark, sf_dir):
    """A nested field of one document in a hundred is set where it lies."""
    path, first = _stored(spark, sf_dir)
    values = table(spark, sf_dir, "documents").where("doc_id % 100 = 11").select(
        "doc_id", (-F.col("n_chars")).alias("value"))
    last = store.set_stored_field(spark, path, values, "entry.n_chars")
    found = _with_rewritten(spark, first, last, "entry")
    return found.select("doc_id", F.col("entry.n_chars").cast("long").alias("size"), "rewritten")


def _responses(spark, sf_dir):
    """One API response per document: a revision with a diff and one not cached yet."""
    text = F.col("text")
    diff = F.concat(
        F.lit('<tr><td class="diff-addedline">'), text,
        F.lit('</td><td class="diff-deletedline"><span class="diffchange">'), F.col("source"),
        F.lit('</span> kept</td></tr>'),
    )

    def attr(name, value):
        return [F.lit(f' {name}="'), revisions.xml_escape(value), F.lit('"')]

    xml = F.concat(
        F.lit("<api><query><pages><page"), *attr("title", F.col("source")),
        F.lit("><revisions><rev"), *attr("revid", F.col("doc_id").cast("string")),
        *attr("user", F.col("lang")), *attr("comment", F.concat(F.lit("re: "), "source")),
        F.lit(' timestamp="2011-02-03T04:05:06Z"'), *attr("size", F.col("n_chars").cast("string")),
        F.lit("><diff>"), revisions.xml_escape(diff), F.lit("</diff></rev><rev"),
        *attr("revid", (-F.col("doc_id") - 1).cast("string")), *attr("user", F.col("lang")),
        F.lit(' comment="" timestamp="2011-02-03T04:05:07Z" size="0"><diff notcached=""/></rev>'),
        F.lit("</revisions></page></pages></query></api>"),
    )
    return texts(spark, sf_dir).select(xml.alias("xml"))


@query("revision_xml", """
SELECT doc_id AS rev_id, source AS title, lang AS sender, 're: ' || source AS comment,
    n_chars::INTEGER AS size, length(text) AS text_length, false AS pending FROM documents
UNION ALL SELECT -doc_id - 1, source, lang, NULL, 0, NULL, true FROM documents""")
def revision_xml(spark, sf_dir):
    revs = revisions.revision_rows(_responses(spark, sf_dir))
    text = F.regexp_extract("diff", ADDED_CELL, 1)
    return revs.select(
        "rev_id", "title", "sender", F.nullif("comment", F.lit("")).alias("comment"), "size",
        F.length(text).cast("bigint").alias("text_length"), "pending",
    )


@query("ready_pending", """
SELECT doc_id AS rev_id, 'ready' AS state FROM documents
UNION ALL SELECT -doc_id - 1, 'pending' FROM documents""")
def ready_pending(spark, sf_dir):
    ready, pending = revisions.split_pending(
        revisions.revision_rows(_responses(spark, sf_dir))
    )
    return ready.select("rev_id", F.lit("ready").alias("state")).unionByName(
        pending.select("rev_id", F.lit("pending").alias("state"))
    )


def _coded_rows(spark, sf_dir):
    """A coded table: every cell text, label cells other than 0/1 where not coded."""
    coded = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("_id"), "quality", "toxic"
    )
    docs = texts(spark, sf_dir).join(coded, F.col("doc_id") == F.col("_id"), "left")
    return docs.select(
        F.when(F.col("lang") == "es", F.concat(F.lit("x"), F.col("doc_id").cast("string")))
        .otherwise(F.concat(F.lit("0"), F.col("doc_id").cast("string"))).alias("rev"),
        F.coalesce(F.col("quality").cast("string"), F.lit("?")).alias("quality"),
        F.coalesce(F.col("toxic").cast("string"), F.lit("")).alias("toxic"),
        "text",
    )


LABELS = {"quality": "quality", "toxic": "toxic"}


@query("shape_entry", """
SELECT CASE WHEN lang <> 'es' THEN d.doc_id END AS rev_id,
    CASE WHEN lang = 'es' THEN 'x' || d.doc_id ELSE d.doc_id::VARCHAR END AS row,
    quality = 1 AS quality, toxic = 1 AS toxic, text AS added, 0 AS removed, '' AS comment
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def shape_entry(spark, sf_dir):
    rows = _coded_rows(spark, sf_dir)
    shaped = shape_entries(rows, {"rev_id": "rev", "row": "rev"}, LABELS, "text")
    return shaped.select(
        "entry.id.rev_id", "entry.id.row", *[F.col("labels")[c].alias(c) for c in LABELS],
        F.array_join("entry.content.added", " ").alias("added"),
        F.size("entry.content.removed").alias("removed"), "entry.comment",
    )


@query("label_bool", """
SELECT doc_id, CASE quality + toxic WHEN 0 THEN false WHEN 1 THEN true END AS label
FROM labels""")
def label_bool_query(spark, sf_dir):
    cell = (F.col("quality") + F.col("toxic")).cast("string")
    return table(spark, sf_dir, "labels").select("doc_id", label_bool(cell).alias("label"))


@query("filter_exists", """
SELECT d.doc_id AS id FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def filter_exists(spark, sf_dir):
    found = filters.field_exists(_documents(spark, sf_dir), "labels", "entry.content.added")
    return found.select(F.col("entry.id.rev_id").alias("id"))


@query("filter_in", "SELECT doc_id AS id, (doc_id % 5)::INTEGER AS slice FROM documents"
       " WHERE doc_id % 5 IN (0, 1, 3)")
def filter_in(spark, sf_dir):
    found = filters.field_in(_documents(spark, sf_dir), "internal.slice", [0, 1, 3])
    return found.select(F.col("entry.id.rev_id").alias("id"), "internal.slice")


@query("filter_override", """
SELECT d.doc_id AS id, lang FROM documents d JOIN labels l ON d.doc_id = l.doc_id
WHERE lang = 'fr' AND n_chars < 2000""")
def filter_override(spark, sf_dir):
    defaults = {"labels": F.col("labels").isNotNull(), "entry.sender": F.col("entry.sender") == "en"}
    given = {"entry.sender": F.col("entry.sender") == "fr", "entry.size": F.col("entry.size") < 2000}
    found = filters.filter_paths(_documents(spark, sf_dir), defaults, given)
    return found.select(F.col("entry.id.rev_id").alias("id"), F.col("entry.sender").alias("lang"))


@query("filter_numeric_id", """
SELECT doc_id, sub FROM (SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN n_chars || '-' || source
    ELSE source || n_chars END AS sub FROM documents) WHERE regexp_matches(sub, '^[0-9]')""")
def filter_numeric_id(spark, sf_dir):
    n = F.col("n_chars").cast("string")
    sub = F.when(F.col("n_chars") % 2 == 0, F.concat(n, F.lit("-"), "source")).otherwise(
        F.concat("source", n)
    )
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("doc_id").cast("string").alias("main"), sub.alias("sub")
    )
    return filters.numeric_ids(rows, "main", "sub").select("doc_id", "sub")


@query("coverage_count", """
SELECT count(l.doc_id) AS matched, count(*) AS total
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def coverage_count(spark, sf_dir):
    return metrics.coverage(_documents(spark, sf_dir), F.col("labels").isNotNull())


@query("label_completeness", """
SELECT 'quality' AS label, count(quality) AS coded, count(*) AS total,
    count(quality) = count(*) AS complete FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
UNION ALL SELECT 'toxic', count(toxic), count(*), count(toxic) = count(*)
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def label_completeness(spark, sf_dir):
    return metrics.label_completeness(_documents(spark, sf_dir), ["quality", "toxic"])


@query("anti_join_existing", """
SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def anti_join_existing(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source")
    return joins.skip_existing(rows, table(spark, sf_dir, "labels"), ["doc_id"])


def _sides(spark, sf_dir):
    left = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("0"), F.col("c_custkey").cast("string")).alias("key_1"),
        F.col("c_name").alias("name"),
    )
    right = table(spark, sf_dir, "events").select(
        (F.col("user_id") * 12).cast("string").alias("key_2"), "event_id"
    )
    return left, right


SIDES_SQL = """
l AS (SELECT '0' || c_custkey AS key_1, c_name AS name, c_custkey AS k FROM customer),
r AS (SELECT (user_id * 12)::VARCHAR AS key_2, event_id, user_id * 12 AS j FROM events)"""


@query("outer_join", f"""WITH {SIDES_SQL}
SELECT key_1, name, key_2, event_id FROM l FULL OUTER JOIN r ON k = j""")
def outer_join(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return joins.outer_join(left, right, "key_1", "key_2", int_keys=True)


@query("outer_join_literal", f"""WITH {SIDES_SQL}
SELECT key_1, name, key_2, event_id FROM r LEFT JOIN l ON k = j
UNION ALL SELECT key_1, name, NULL, NULL FROM l""")
def outer_join_literal(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return joins.outer_join(
        left, right, "key_1", "key_2", int_keys=True, emit_matched_left=True
    )


@query("one_hot", """
SELECT doc_id AS id, CASE WHEN lang IN ('en', 'fr') THEN (lang = 'en')::INTEGER END AS en,
    CASE WHEN lang IN ('en', 'fr') THEN (lang = 'fr')::INTEGER END AS fr, source
FROM documents""")
def one_hot(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    return labels.one_hot(rows, "lang", ["en", "fr"])


@query("pivot_last", """
SELECT user_id AS id, arg_max(value, event_id) FILTER (WHERE event_type = 'click') AS click,
    arg_max(value, event_id) FILTER (WHERE event_type = 'view') AS view,
    max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type,
    arg_max(value, event_id) AS value FROM events GROUP BY user_id""")
def pivot_last(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("id"), "event_id", "event_type", "value"
    )
    return labels.pivot_last(
        rows, "id", "event_type", "value", F.col("event_id"), ["click", "view"]
    )


REVISIONS_SQL = f"""
rev AS (SELECT doc_id AS rev_id, source AS title, lang AS sender, 're: ' || source AS comment,
    n_chars::INTEGER AS size, regexp_extract_all('<td class="diff-addedline">' || text || '</td>',
    '{ADDED_CELL}', 1) AS cells, source AS gone FROM documents WHERE lang <> 'de')"""


@query("attach_revisions", f"""
WITH {REVISIONS_SQL}
SELECT d.doc_id AS rev_id, rev.title, rev.sender, coalesce(rev.comment, '') AS comment, rev.size,
    coalesce(length(array_to_string(cells, ' ')), 0) AS added_length,
    coalesce(gone, '') AS removed, l.quality = 1 AS quality
FROM documents d LEFT JOIN rev ON d.doc_id = rev.rev_id
LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE d.lang <> 'es'""")
def attach_revisions(spark, sf_dir):
    known = _responses(spark, sf_dir).where("xml not like '%user=\"de\"%'")
    entries = coded_entries(_coded_rows(spark, sf_dir), "rev", LABELS)
    return _flat(with_revisions(entries, known))


def _flat(entries):
    return entries.select(
        "entry.id.rev_id", "entry.title", "entry.sender", "entry.comment", "entry.size",
        F.length(F.array_join("entry.content.added", " ")).cast("bigint").alias("added_length"),
        F.array_join("entry.content.removed", " ").alias("removed"),
        F.col("labels")["quality"].alias("quality"),
    )


@query("ingest_entries", """
SELECT d.doc_id AS rev_id, CASE WHEN s.doc_id IS NULL THEN source END AS title,
    CASE WHEN s.doc_id IS NULL THEN lang END AS sender,
    CASE WHEN s.doc_id IS NULL THEN 're: ' || source ELSE '' END AS comment,
    CASE WHEN s.doc_id IS NULL THEN n_chars::INTEGER END AS size,
    CASE WHEN s.doc_id IS NULL THEN length(text) ELSE 6 END AS added_length,
    CASE WHEN s.doc_id IS NULL THEN source ELSE '' END AS removed, l.quality = 1 AS quality
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
LEFT JOIN labels s ON d.doc_id = s.doc_id
WHERE lang <> 'es' OR s.doc_id IS NOT NULL""")
def ingest_entries(spark, sf_dir):
    already = shape_entries(
        table(spark, sf_dir, "labels").select(
            F.col("doc_id").cast("string").alias("rev"),
            *[F.col(c).cast("string").alias(c) for c in LABELS], F.lit("stored").alias("text"),
        ),
        {"rev_id": "rev"}, LABELS, "text",
    )
    fresh = coded_entries(
        _coded_rows(spark, sf_dir), "rev", LABELS, stored=already, skip=True
    )
    return _flat(ingest.store(already, with_revisions(fresh, _responses(spark, sf_dir))))


@query("ingest_pending", """
SELECT d.doc_id AS rev_id, source AS title, lang AS sender, 're: ' || source AS comment,
    n_chars::INTEGER AS size, length(text) AS added_length, source AS removed,
    l.quality = 1 AS quality, lang = 'fr' AS asked_again
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE lang <> 'es'""")
def ingest_pending(spark, sf_dir):
    """Revisions of French documents are not there for the first batch; the second asks for them."""
    rows, responses = _coded_rows(spark, sf_dir), _responses(spark, sf_dir)
    early = responses.where("xml not like '%user=\"fr\"%'")
    first = coded_entries(rows, "rev", LABELS)
    stored = written(ingest.store(first.limit(0), with_revisions(first, early)), "entries")
    second = written(coded_entries(rows, "rev", LABELS, stored=stored, skip=True), "asked")
    asked = second.select(F.col("entry.id.rev_id").alias("rev_id"), F.lit(True).alias("again"))
    whole = _flat(ingest.store(stored, with_revisions(second, responses))).join(asked, "rev_id", "left")
    return whole.withColumn("asked_again", F.coalesce("again", F.lit(False))).drop("again")


@query("pending_events", """
SELECT doc_id AS rev_id, CASE WHEN doc_id % 3 <> 0 THEN 'stored' ELSE 'given up' END AS event,
    CASE WHEN doc_id % 3 <> 0 THEN 0 ELSE 3 END::INTEGER AS tries,
    CASE WHEN doc_id % 3 <> 0 THEN source END AS title,
    CASE WHEN doc_id % 3 <> 0 THEN n_chars::INTEGER END AS size
FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 4 = 3""")
def pending_events(spark, sf_dir):
    """Up to three pending answers to a document, for two in three the revision too; more than two are too many."""
    ready, _ = revisions.split_pending(revisions.revision_rows(_responses(spark, sf_dir)))
    again = F.sequence(F.lit(0).cast("bigint"), F.pmod("rev_id", F.lit(4)))
    late = ready.select("*", F.explode(again).alias("n")).where("n > 0").drop("n")
    answers = ready.where("rev_id % 3 <> 0").unionByName(late.withColumn("pending", F.lit(True)))
    with keyed_state(spark):
        found = written(retry_events(answers, most=2), "events")
    return found.where(F.col("event") != ASK).select("rev_id", "event", "tries", "title", "size")
