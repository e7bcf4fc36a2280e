"""The operators as queries over the driver tables, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from palaver.llm import (
    alignment,
    embedding_dedup,
    fingerprints,
    language_model,
    licenses,
    manifest,
    mixing,
    packing,
    pii,
    quality,
    simhash_dedup,
    token_packing,
    url_lists,
)
from palaver.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


@query("op1_simhash_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "fingerprint", "component_id", "kept")


@query("op2_licenses")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


@query("op3_language_model")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.language_scores(table(spark, sf_dir, "documents"))


@query("op4_fingerprints")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.document_prints(table(spark, sf_dir, "documents"))


@query("op5_personal_data")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def list_entries(captures: DataFrame) -> DataFrame:
    """Dated entries for one in five of the patterns that the captures ask for, made from its hash."""
    found = captures.select(F.explode(url_lists.patterns(F.col("url"))).alias("pattern")).distinct()
    found = found.withColumn("k", F.conv(F.substring(F.md5("pattern"), 1, 4), 16, 10).cast("int"))
    found = found.where("k % 5 = 0").withColumn("list", F.element_at(F.array(*map(F.lit, LISTS)), F.col("k") % 3 + 1))
    dated = [("add", "k % 200", "true"), ("remove", "k % 200 + 30 + k % 60", "k % 2 = 0"), ("add", "k % 200 + 150", "k % 4 = 0")]
    parts = [
        found.where(where).select(
            "list",
            "pattern",
            F.expr(f"timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval({day})").alias("dated"),
            F.lit(action).alias("action"),
        )
        for action, day, where in dated
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


LISTS = ("adult", "malware", "spam")

URL_SQL = r"""
with captures as (
  select page_id, url,
    timestamp '2024-01-01 00:00:00' + to_minutes((page_id * 7919) % 525600) as fetched_at,
    regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1) as host,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') as segments
  from pages),
asked as (
  select page_id, url, fetched_at, unnest(
    list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1),
      lambda i: array_to_string(string_split(host, '.')[i:], '.')) ||
    list_transform(range(1, least(len(segments), 2) + 1),
      lambda i: host || '/' || array_to_string(segments[1:i], '/'))) as pattern
  from captures where host <> ''),
keyed as (
  select pattern, ('0x' || substr(md5(pattern), 1, 4))::int as k from (select distinct pattern from asked)),
chosen as (
  select pattern, k, case k % 3 when 0 then 'adult' when 1 then 'malware' else 'spam' end as list
  from keyed where k % 5 = 0),
entries as (
  select list, pattern, timestamp '2024-01-01 00:00:00' + to_days(k % 200) as dated, 'add' as action from chosen
  union all
  select list, pattern, timestamp '2024-01-01 00:00:00' + to_days(k % 200 + 30 + k % 60), 'remove' from chosen where k % 2 = 0
  union all
  select list, pattern, timestamp '2024-01-01 00:00:00' + to_days(k % 200 + 150), 'add' from chosen where k % 4 = 0),
intervals as (
  select list, pattern, dated as since, until from (
    select *, lead(dated) over (partition by list, pattern order by dated, action) as until from entries)
  where action = 'add' and (until is null or until > dated)),
met as (
  select a.page_id, a.url, a.fetched_at, i.list
  from (select distinct * from asked) a join intervals i
    on a.pattern = i.pattern and a.fetched_at >= i.since and (i.until is null or a.fetched_at < i.until))
select c.page_id, c.url, c.fetched_at, coalesce(m.n, 0) as n_active, coalesce(m.lists, '') as lists,
  coalesce(m.n, 0) > 0 as blocked
from captures c left join (
  select page_id, url, fetched_at, count(*) as n, string_agg(distinct list, ',' order by list) as lists
  from met group by all) m
on c.page_id is not distinct from m.page_id and c.url = m.url and c.fetched_at = m.fetched_at
"""


@query("op6_url_lists", URL_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    fetched = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast((page_id * 7919) % 525600 as int))")
    captures = table(spark, sf_dir, "pages").select("page_id", "url", fetched.alias("fetched_at"))
    return url_lists.evaluate(captures, list_entries(captures), url_lists.ALL_DEPTHS)


@query("op7_quality")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


MIX_SQL = r"""
with sizes as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
    ('0x' || substr(md5(concat_ws(':', '5', doc_id::varchar)), 1, 15))::bigint as hashed
  from documents),
sources as (
  select source, sum(size)::bigint as words,
    row_number() over (order by source is null, encode(source)) - 1 as sid
  from sizes group by source),
weighed as (
  select *, case sid % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight, 3 * words as most
  from sources),
levels as (
  select *, (sum(words) over () - coalesce(sum(most) over (order by most / weight, sid rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by most / weight, sid rows between current row and unbounded following) as level
  from weighed),
targets as (
  select source, sid, words, least(most::double, weight * max(level) over ()) as target from levels),
placed as (
  select s.doc_id, s.size, t.sid, t.words, t.target,
    coalesce(sum(size) over (partition by t.sid order by hashed, doc_id nulls first, size rows between unbounded preceding and 1 preceding), 0)::bigint as start,
    case when t.words > 0 then floor(t.target / t.words)::bigint else 0 end as passes
  from sizes s join targets t on s.source is not distinct from t.source),
taken as (
  select *, case when size > 0 then passes * size +
    greatest(0, least(round(target - passes * words)::bigint - start, size)) else 0 end as taken
  from placed),
asked as (
  select *, start / target as share from taken)
select doc_id, size::bigint as size, words as source_size, round(target, 6) as target, taken::bigint as taken,
  round(case when taken = 0 then null
    when sid % 3 = 0 then 2 * share / (sqrt(2.25 - 2 * share) + 1.5)
    when sid % 3 = 1 then share
    when share * 0.875 < 0.25 then share * 0.875 / 0.5
    else 0.5 + 2 * (share * 0.875 - 0.25) / (sqrt(0.25 + 6 * (share * 0.875 - 0.25)) + 0.5) end, 6) as position
from asked
"""


@query("op8_mixing", MIX_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mixing_plan(table(spark, sf_dir, "documents"))
    rounded = [F.round(c, 6).alias(c) for c in ("target", "position")]
    return plan.select("doc_id", "size", "source_size", rounded[0], "taken", rounded[1])


@query("op9_embedding_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op10_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def field_sql(value: str) -> str:
    return f"coalesce(strlen({value}::varchar)::varchar || ':' || {value}::varchar, '-')"


def level_sql(name: str, level: int) -> str:
    """One level up from ``{name}_nodes_k`` and ``{name}_way_k``; a tree of one node stays as it is."""
    k, up = level, level + 1
    others = "array_to_string(children[1:pos % 16] || children[pos % 16 + 2:], '')"
    folded = "sha256(array_to_string(children[1:pos % 16] || [folded] || children[pos % 16 + 2:], ''))"
    return f"""
{name}_runs_{k} as (
  select tree, pos // 16 as run, list(digest order by pos) as children, any_value(n) as n
  from {name}_nodes_{k} group by tree, pos // 16),
{name}_nodes_{up} as (
  select tree, run as pos, case when n = 1 then children[1] else sha256(array_to_string(children, '')) end as digest,
    (n + 15) // 16 as n from {name}_runs_{k}),
{name}_way_{up} as (
  select key, tree, case when n = 1 then pos else pos // 16 end as pos,
    case when n = 1 then siblings else siblings || {others} end as siblings,
    case when n = 1 then folded else {folded} end as folded
  from {name}_way_{k} join {name}_runs_{k} using (tree) where run = pos // 16),"""


LEAF_SQL = " || ".join(map(field_sql, ("doc_id", "source", "lang", "n_chars")))
LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: CRC-32 by bits; 3988292384 is its reversed polynomial.
CRC_SQL = """xor(list_reduce([4294967295::bigint] || list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint),
    lambda crc, c: list_reduce([xor(crc, c), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda d, bit: xor(d >> 1, 3988292384 * (d & 1)))), 4294967295)"""
#: Six levels hold 16 million documents a source, and as many sources.
MANIFEST_SQL = f"""
with leaves as (
  select doc_id, source, sha256({LEAF_SQL} || {field_sql("text")}) as leaf,
    case when {CRC_SQL} % 5 = 0 then sha256({LEAF_SQL} || {field_sql(LOWER_SQL)}) end as tampered
  from documents),
places as (
  select *, row_number() over () as key, dense_rank() over (order by source nulls first) - 1 as tree,
    row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos,
    count(*) over (partition by source) as n
  from leaves),
own_nodes_0 as (select tree, pos, leaf as digest, n from places),
own_way_0 as (select key, tree, pos, '' as siblings, coalesce(tampered, leaf) as folded from places),
{"".join(level_sql("own", k) for k in range(6))}
all_nodes_0 as (select 0 as tree, tree as pos, digest, count(*) over () as n from own_nodes_6),
all_way_0 as (select key, 0 as tree, tree as pos, siblings, folded from own_way_6),
{"".join(level_sql("all", k) for k in range(6))}
ends as (select any_value(digest) as root from all_nodes_6)
select doc_id, leaf, s.digest as subroot, root, sha256(siblings) as proof_sha256, folded as folded_root, folded = root as verified
from places p join own_nodes_6 s using (tree) join all_way_6 w using (key) cross join ends
"""


@query("op11_manifest", MANIFEST_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"))


@query("op12_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


@query("op13_token_packing")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_packing.pack_tokens(table(spark, sf_dir, "documents"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
