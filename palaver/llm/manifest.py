"""A Merkle manifest of a table of documents: a leaf per row, a tree per source, one root over all.

The upper tree is small: only nodes of ``SPAN`` leaves and more are reduced level by level, natively. What a
superblock of ``SPAN`` leaves needs of it, the siblings on its way to the root, is cogrouped with its
leaves; the group then finishes everything at once: it reduces its own lower levels, joins the inner and
outer siblings to proofs, and folds each (possibly tampered) leaf up to a root.
"""

from __future__ import annotations

import string
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palaver.llm.common import shuffle_partitions
from palaver.session import written

FAN = 16
#: Leaves of a superblock: two levels of runs.
LEVELS = 2
SPAN = FAN**LEVELS
#: Where this divides a document's checksum, the manifest is checked against a tampered text.
TAMPER = 5

LAYOUT = (
    "doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
    "folded_root string, verified boolean"
)


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """A value with its byte count, so that no two rows read alike; null is a dash."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaves(documents: DataFrame) -> DataFrame:
    """Rows ``(doc_id, source, leaf, tampered)``; ``tampered`` is null where nothing is tampered with."""
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    own = [field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    checksum = F.crc32(F.col("doc_id").cast("long").cast("string"))
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.sha2(F.concat(*own, field(F.col("text"))), 256).alias("leaf"),
        F.when(checksum % TAMPER == 0, F.sha2(F.concat(*own, field(lowered)), 256)).alias("tampered"),
    )


def numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """``rows`` with ``number``, their place from 0 in ascending order (nulls first).

    Ranges are sorted each by its own task and written; a range's start is the sum of the counts before
    it. Rows equal in ``order`` are interchangeable; they are dealt to several ranges.
    """
    spread = rows.withColumn("spread", F.monotonically_increasing_id())
    spread = spread.repartitionByRange(shuffle_partitions(rows.sparkSession), *order, "spread")
    spread = spread.sortWithinPartitions(*order, "spread").drop("spread")
    spread = written(spread.withColumn("at", F.monotonically_increasing_id()), name)
    # An id is a range's number followed by 33 bits of the row's place in it.
    range_of = F.shiftright("at", 33)
    counts = spread.groupBy(range_of.alias("range")).agg(F.count("*").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = spread.withColumn("range", range_of).join(F.broadcast(counts), "range")  # a row per range
    place = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.select(*rows.columns, place.alias("number"))


def runs_above(nodes: DataFrame) -> DataFrame:
    """The next level of trees: every 16 consecutive nodes ``(tree, at, digest)`` and the digest of them.

    Rows ``(tree, at, children, digest)``.
    """
    own = F.array_sort(F.collect_list(F.struct("at", "digest")))["digest"]
    runs = nodes.groupBy("tree", F.floor(F.col("at") / FAN).alias("run")).agg(own.alias("children"))
    runs = runs.withColumnRenamed("run", "at")
    return runs.withColumn("digest", F.sha2(F.array_join("children", ""), 256))


def height(count: int) -> int:
    """Levels above ``count`` nodes until one is left."""
    levels = 0
    while count > 1:
        count, levels = -(-count // FAN), levels + 1
    return levels


def reduced(nodes: DataFrame, sizes: DataFrame, most: int, name: str) -> tuple[DataFrame, list[DataFrame]]:
    """Reduce trees of nodes ``(tree, at, digest)``; ``sizes (tree, n)`` has how many nodes each has.

    Gives roots ``(tree, top)`` and the runs of each level from below. ``most`` bounds ``n``. A level has a
    sixteenth of the nodes below; each is written before the next.
    """
    levels, live = [], sizes.where("n > 1")
    roots = nodes.join(sizes.where("n = 1"), "tree").select("tree", F.col("digest").alias("top"))
    for level in range(height(most)):
        runs = written(runs_above(nodes.join(live.select("tree"), "tree", "left_semi")), f"{name}-{level}")
        levels.append(runs)
        live = live.select("tree", F.ceil(F.col("n") / FAN).alias("n"))
        done = runs.join(live.where("n = 1"), "tree").select("tree", F.col("digest").alias("top"))
        roots, live, nodes = roots.unionByName(done), live.where("n > 1"), runs.select("tree", "at", "digest")
    return roots, levels


def ways_up(spark: SparkSession, levels: list[DataFrame], name: str) -> DataFrame:
    """Rows ``(tree, at, way)``: for each lowest node the runs on its way up, as text of its place and all digests."""
    ways = spark.createDataFrame([], "tree long, at long, way array<string>")
    for level, runs in reversed(list(enumerate(levels))):
        above = ways.withColumnRenamed("way", "above")  # a root has nothing above
        down = runs.join(above, ["tree", "at"], "left").select(
            "tree", "at", "above", F.array_join("children", "").alias("run"), F.posexplode("children").alias("place", "own")
        )
        own = F.array(F.concat(F.lpad(F.col("place").cast("string"), 2, "0"), "run"))
        way = F.concat(own, F.coalesce("above", no_way())).alias("way")
        ways = written(down.select("tree", (F.col("at") * FAN + F.col("place")).alias("at"), way), f"{name}-{level}")
    return ways


def no_way() -> Column:
    return F.array().cast("array<string>")


def local_levels(row: list[str], whole: int) -> list[list[str]]:
    """The levels of a superblock from its leaves up, below its last node.

    One of several superblocks of a source has them all, even over a lone last leaf.
    """
    levels: list[list[str]] = []
    while len(levels) < LEVELS and (len(row) > 1 or whole > SPAN):
        levels.append(row)
        row = [digest("".join(row[i : i + FAN])) for i in range(0, len(row), FAN)]
    return levels


def around(run: str) -> tuple[str, str]:
    """The digests before and after one's own in a run as text."""
    place = int(run[:2])
    return run[2 : 2 + 64 * place], run[2 + 64 * (place + 1) :]


def finish(blocks: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """Proofs and folded roots of the leaves of one group of superblocks, with what they need from above."""
    need = {(o.tree, o.block): o for o in outer.itertuples(index=False)}
    out = []
    for key, rows in blocks.sort_values(["tree", "place"]).groupby(["tree", "block"], sort=False):
        above, own = need[key], rows["leaf"].tolist()
        levels, outside = local_levels(own, above.n), [around(run) for run in above.way]
        upper = "".join(before + after for before, after in outside)
        for at, (doc_id, leaf, tampered) in enumerate(zip(rows["doc_id"], own, rows["tampered"], strict=True)):
            siblings, folded = "", tampered or leaf
            for level in levels:
                first = at // FAN * FAN
                before, after = "".join(level[first:at]), "".join(level[at + 1 : first + FAN])
                siblings += before + after
                folded, at = digest(before + folded + after), at // FAN
            for before, after in outside:
                folded = digest(before + folded + after)
            out.append((doc_id, leaf, above.subroot, above.root, digest(siblings + upper), folded, folded == above.root))
    return pd.DataFrame(out, columns=[f.split()[0] for f in LAYOUT.split(", ")])


def manifest(documents: DataFrame) -> DataFrame:
    """Rows of ``LAYOUT``, one per document: its leaf, its source's subroot, the root, its proof's digest,
    the root folded from its (tampered or own) leaf and the proof, and whether that is the root.

    Leaves of a source ascend by ``doc_id``, then by digest, rows without an id first. Repeated rows are
    leaves like others; alike, they are interchangeable. A null source is a source, first of all. Null
    values are dashes in a leaf, an empty text is not null. Rows without an id are not tampered with. A table
    of one row has its leaf for a root and the digest of nothing for a proof. An empty table gives none.
    Texts are read once and not moved. Further columns are ignored.
    """
    spark = documents.sparkSession
    rows = numbered(written(leaves(documents), "leaves"), "ordered", "source", "doc_id", "leaf")
    trees = rows.groupBy("source").agg(F.count("*").alias("n"), F.min("number").alias("first"))
    trees = written(numbered(trees, "sources", "first").withColumnRenamed("number", "tree"), "trees")
    most, count = trees.agg(F.coalesce(F.max("n"), F.lit(0)), F.count("*")).first()
    owners = trees.withColumnRenamed("source", "owner")
    rows = rows.join(owners, F.col("source").eqNullSafe(F.col("owner")))
    rows = rows.withColumn("place", F.col("number") - F.col("first"))
    rows = rows.withColumn("block", F.floor(F.col("place") / SPAN))

    # Small sources share a group with their neighbours, a large one has a group per superblock.
    def group(large: Column, block: Column) -> list[Column]:
        shared = -1 - F.floor(F.col("first") / SPAN)
        return [
            F.when(large, F.col("tree")).otherwise(shared).alias("group"),
            F.when(large, block).otherwise(0).alias("part"),
        ]

    large = F.col("n") > SPAN
    small, big = trees.where(~large), trees.where(large)
    nodes = rows.select("n", "tree", F.col("place").alias("at"), F.col("leaf").alias("digest"))
    low, _ = reduced(nodes.where(~large).drop("n"), small.select("tree", "n"), min(most, SPAN), "small")
    below = nodes.where(large).drop("n")
    for _ in range(LEVELS):
        below = runs_above(below).select("tree", "at", "digest")
    blocks = big.select("tree", F.ceil(F.col("n") / SPAN).alias("n"))
    high, levels = reduced(written(below, "blocks"), blocks, -(-most // SPAN), "large")
    inner = ways_up(spark, levels, "ways")
    tops = written(low.unionByName(high), "subroots")

    ends = tops.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), F.col("top").alias("digest"))
    single = spark.createDataFrame([(0, count)], "tree long, n long")
    root, levels = reduced(ends, single, count, "root")
    last = ways_up(spark, levels, "root-ways").select(F.col("at").alias("tree"), F.col("way").alias("upper"))
    found = root.first()  # the one root
    tops = tops.join(last, "tree", "left").join(trees.select("tree", "n", "first"), "tree")
    needed = inner.withColumnRenamed("at", "block").join(tops.where(large), "tree")
    lone = tops.where(~large).withColumns({"block": F.lit(0).cast("long"), "way": no_way()})
    needed = needed.unionByName(lone).select(
        *group(large, F.col("block")),
        "tree",
        "block",
        "n",
        F.col("top").alias("subroot"),
        F.lit(found.top if found else None).cast("string").alias("root"),
        F.concat("way", F.coalesce("upper", no_way())).alias("way"),
    )
    # A long column with nulls would pass through pandas as floats.
    rows = rows.select(
        *group(large, F.col("block")), F.col("doc_id").cast("string").alias("doc_id"), "leaf", "tampered", "tree", "place", "block"
    )
    found = rows.groupBy("group", "part").cogroup(needed.groupBy("group", "part"))
    done = found.applyInPandas(finish, LAYOUT.replace("doc_id long", "doc_id string"))
    return done.withColumn("doc_id", F.col("doc_id").cast("long"))
