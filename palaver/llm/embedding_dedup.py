"""Near duplicates of vectors: small-world graphs per shard, searched by every vector of the label.

Vectors of a label that are equal count once. Each label is dealt to shards of bounded size; a graph
is built for each, and how wide a beam its searches need is set by audits: the links of some vectors
are compared with those a full scan gives, and the beam is widened until enough are found. Then every
shard's vectors query every shard of their label. Cosines are verified in double precision; groups
are the components of the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.components import connected_components
from palaver.llm.hnsw import Graph
from palaver.llm.simhash_dedup import Forest
from palaver.session import written

COSINE = 0.93
#: Vectors of a shard, about; bounds what a task holds.
SHARD_ROWS = 20_000
BEAM = 24
#: Vectors per shard whose links are audited, and the share of them a beam has to find.
AUDITED = 128
RECALL = 0.98
#: What float32 products may lack of the cosine before it is verified.
SLACK = 1e-4

GRAPH = "label int, dims int, shard int, node int, id long, often long, vector array<float>, links array<array<int>>, entry int, beam int"


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision."""
    vectors = vectors.astype(np.float64)
    vectors /= np.abs(vectors).max(1, keepdims=True)  # no overflow or underflow of squares
    return vectors / np.sqrt((vectors**2).sum(1, keepdims=True))


def _stack(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def _nested(values: list[np.ndarray]) -> pa.Array:
    """Per node its links in each layer."""
    count, layers = len(values[0]), len(values)
    flat = np.concatenate([v.ravel() if layers == 1 else v for v in values], axis=None if layers == 1 else 1).ravel()
    widths = np.tile([v.shape[1] for v in values], count)
    inner = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(widths)), pa.int32()), pa.array(flat, pa.int32()))
    return pa.ListArray.from_arrays(pa.array(np.arange(0, count * layers + 1, layers), pa.int32()), inner)


def build(key: tuple, table: pa.Table) -> pa.Table:
    """The graph of a shard, one row per node."""
    table = table.sort_by("id")
    exact = unit(_stack(table["vector"]))
    vectors = exact.astype(np.float32)
    graph = Graph(vectors)
    some = np.unique(np.linspace(0, len(vectors) - 1, AUDITED).astype(int))
    linked = exact[some] @ exact.T >= COSINE
    wanted, beam = linked.sum(), BEAM
    while beam < len(vectors):
        found = graph.within(vectors[some], COSINE - SLACK, beam)
        got = sum(int(row[hits].sum()) for row, hits in zip(linked, found, strict=True))
        if got >= RECALL * wanted:
            break
        beam *= 2
    count = len(vectors)
    columns = {name: table[name] for name in ("label", "dims", "shard")}
    columns |= {"node": pa.array(range(count), pa.int32()), "id": table["id"], "often": table["often"], "vector": table["vector"]}
    columns |= {"links": _nested(graph.layers), "entry": pa.array([graph.entry] * count, pa.int32()), "beam": pa.array([beam] * count, pa.int32())}
    return pa.table(columns)


def search(key: tuple, nodes: pa.Table, queries: pa.Table) -> pa.Table:
    """Rows ``(id, links, root)``: vectors linked to a query in this shard, a name for its group here."""
    none = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())]).empty_table()
    if not len(nodes) or not len(queries):
        return none
    nodes = nodes.sort_by("node")
    exact, ids, often = unit(_stack(nodes["vector"])), nodes["id"].to_numpy(), nodes["often"].to_numpy()
    levels = nodes["links"].combine_chunks()
    height = len(levels[0])
    flat = levels.flatten()
    layers = [_stack(pa.chunked_array([flat.take(pa.array(range(k, len(flat), height)))])) for k in range(height)]
    graph = Graph(exact.astype(np.float32), layers, nodes["entry"][0].as_py())
    asked, asked_ids = unit(_stack(queries["vector"])), queries["id"].to_numpy()
    found = graph.within(asked.astype(np.float32), COSINE - SLACK, nodes["beam"][0].as_py())
    links = np.zeros(len(asked), np.int64)
    forest = Forest(len(ids) + len(asked))
    for row, hits in enumerate(found):
        hits = hits[(exact[hits] @ asked[row] >= COSINE) & (ids[hits] != asked_ids[row])]
        links[row] = often[hits].sum()
        if len(hits):
            forest.join(hits, np.full(len(hits), len(ids) + row))
    everyone = np.concatenate([ids, asked_ids])
    counted = np.concatenate([np.zeros(len(ids), np.int64), links])
    some = (counted > 0) | (forest.root != np.arange(len(everyone)))
    columns = (everyone[some], counted[some], everyone[forest.root[some]])
    return pa.Table.from_arrays([pa.array(c) for c in columns], schema=none.schema)


def near_vectors(embeddings: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Rows ``(vec_id, n_links, component_id, kept)``, one per row of ``embeddings``.

    Linked are vectors of one label and length with a cosine of ``COSINE`` or more, as found by the
    graphs. Rows with a null label or id, and vectors that are null, empty, zero or hold a null or
    non-finite number, link with nothing and are their own component. Rows that repeat an id count
    as vectors of their own.
    """
    vector = F.col("embedding").cast("array<float>")
    finite = F.forall(vector, lambda v: v.isNotNull() & (F.abs(v) < float("inf")) & ~F.isnan(v))
    usable = finite & F.exists(vector, lambda v: v != 0) & F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    # Zeros of either sign are one value.
    same = F.transform(vector, lambda v: F.when(v == 0, F.lit(0.0).cast("float")).otherwise(v))
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("int").alias("label"),
        F.when(F.coalesce(usable, F.lit(False)), same).alias("vector"),
    )
    able = rows.where("vector is not null").groupBy("label", "vector")
    distinct = written(able.agg(F.min("vec_id").alias("id"), F.count("*").alias("often")), "vectors")
    distinct = distinct.withColumn("dims", F.size("vector"))
    shards = distinct.groupBy("label", "dims").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    distinct = distinct.join(written(shards, "shards"), ["label", "dims"])
    distinct = distinct.withColumn("shard", F.pmod(F.xxhash64("id"), "shards").cast("int"))

    keys = ["label", "dims", "shard"]
    graphs = written(distinct.select(*keys, "id", "often", "vector").groupBy(*keys).applyInArrow(build, GRAPH), "graphs")
    each = F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("asking")
    owned = distinct.select("label", "dims", "shards").distinct()
    nodes = graphs.join(owned, ["label", "dims"]).select(*graphs.columns, each)
    asking = distinct.withColumnRenamed("shard", "asking").select(
        "label", "dims", "asking", "id", "vector", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard")
    )
    pairs = ["label", "dims", "shard", "asking"]
    found = nodes.groupBy(*pairs).cogroup(asking.groupBy(*pairs)).applyInArrow(search, "id long, links long, root long")
    found = written(found, "found")
    component = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    whole = distinct.join(links, "id", "left").join(component, F.col("id") == component.node, "left")
    whole = whole.select(
        F.col("label").alias("l"),
        F.col("vector").alias("v"),
        (F.coalesce("links", F.lit(0)) + F.col("often") - 1).alias("n_links"),
        F.coalesce("component", "id").alias("component"),
    )
    rows = rows.join(whole, (rows.label == whole.l) & (rows.vector == whole.v), "left")
    component_id = F.coalesce("component", "vec_id")
    kept = F.coalesce(component_id == F.col("vec_id"), F.lit(False))
    return rows.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component_id.alias("component_id"), kept.alias("kept")
    )
