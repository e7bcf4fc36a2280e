"""Mixing, packing, vectors, URL lists and the pipeline."""

import datetime as dt
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palaver.llm import embedding_dedup, hnsw, mixing, packing, url_lists


def water_fill(words, weights, most=3):
    """Shares cut at the limit, the excess shared again by weight until none is above."""
    target, left, free = {}, float(sum(words.values())), dict(weights)
    while True:
        unit = left / sum(free.values()) if free else 0
        over = [s for s in free if free[s] * unit > most * words[s]]
        if not over:
            return target | {s: w * unit for s, w in free.items()}
        for s in over:
            target[s] = float(most * words[s])
            left -= target[s]
            del free[s]


def test_targets_against_resharing(spark):
    rng = random.Random(8)
    for _ in range(4):
        words = {f"s{k}": rng.choice([1, 5, 30, 1000, 90_000]) for k in range(rng.randint(1, 9))} | {None: 7}
        order = sorted(words, key=lambda s: (s is None, s or ""))
        weights = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}
        sizes = spark.createDataFrame([(s, n) for s, n in words.items()], "source string, size long")
        found = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
        assert found == pytest.approx(water_fill(words, weights))


@pytest.mark.parametrize("schedule", mixing.SCHEDULES)
def test_due_inverts_the_integral(spark, schedule):
    times = np.linspace(0, 1, 101)
    fine = np.linspace(0, 1, 200_001)
    rate = np.interp(fine, *zip(*schedule, strict=True))
    area = np.append(0, np.cumsum((rate[1:] + rate[:-1]) / 2 * np.diff(fine)))
    shares = np.interp(times, fine, area / area[-1])
    table = spark.createDataFrame([(float(s),) for s in shares], "share double")
    found = [r[0] for r in table.select(mixing.due(table.share, schedule)).collect()]
    assert found == pytest.approx(times, abs=1e-6)


def test_mix_takes_what_targets_ask(documents):
    rng = random.Random(1)
    rows = [(k, " ".join("w" * rng.randint(0, 30))) for k in range(300)]
    rows = [(k, t, rng.choice(["a", "a", "a", "a", "b", "c", None])) for k, t in rows]
    found = mixing.mixing_plan(documents(rows)).collect()
    assert len(found) == 300
    source = {k: s for k, _, s in rows}
    taken, target = Counter(), {}
    for r in found:
        assert 0 <= r.taken <= 3 * r.size
        assert len(r.positions or []) == -(-r.taken // r.size if r.size else 0)
        assert r.positions is None or r.positions == sorted(r.positions) and 0 <= r.positions[0] <= r.positions[-1] <= 1
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    places = [r.position for r in found if r.position is not None]
    assert places == sorted(places)
    again = mixing.mixing_plan(documents(rows[::-1])).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_mixed_documents_are_cut_to_what_is_taken(documents, edge, nothing):
    rows = [(k, f" one\ttwo  three {k} five", "ab"[k % 2]) for k in range(40)]
    table = documents(rows)
    plan = {r.doc_id: r for r in mixing.mix(table).collect()}
    words = Counter()
    for r in mixing.mixed_documents(table).collect():
        assert f" one\ttwo  three {r.doc_id} five".startswith(r.text) and r.n_chars == len(r.text)
        words[r.doc_id] += len(r.text.split())
    assert words == Counter({k: r.taken for k, r in plan.items() if r.taken})
    mixed = mixing.mixed_documents(edge)
    assert mixed.columns == edge.columns
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in edge.collect()}
    found = mixing.mix(edge).collect()
    assert len(found) == edge.count() and all(r.taken == 0 for r in found if r.doc_id in (3, 4, 5))
    assert mixing.mixing_plan(nothing).count() == mixing.mixed_documents(nothing).count() == 0


def plain_best_fit(sizes, sources, clusters, capacity, per_source):
    bins, out = [], []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        fits = [
            (capacity - sum(sizes[i] for i in held), number)
            for number, held in enumerate(bins)
            if capacity - sum(sizes[i] for i in held) >= size
            and all(clusters[i] != cluster for i in held)
            and sum(sources[i] == source for i in held) < per_source
        ]
        number = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([])
        bins[number].append(len(out))
        out.append(number)
    return out


def test_best_fit_takes_the_tightest_compatible_bin():
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(1, 60)
        sizes = sorted((rng.randint(1, 50) for _ in range(n)), reverse=True)
        sources = [rng.choice([0, 0, 0, 1, 2]) for _ in range(n)]
        clusters = [rng.choice([0, 0, *range(1, n + 1)]) for _ in range(n)]
        args = (sizes, sources, clusters, 50, rng.randint(1, 4))
        assert packing.best_fit(*args) == plain_best_fit(*args)


def test_packing_covers_every_word_once(documents, edge, nothing):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randint(0, 9)}" for _ in range(rng.randint(0, 300))) for _ in range(120)] + ["a copy of it"] * 60
    rows = [(k, t, rng.choice(["a", "a", "b", None])) for k, t in enumerate(texts)]
    found = packing.pack(documents(rows), capacity=128, per_source=3, shard_rows=50).collect()
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r.doc_id].append((r.start_word, r.n_words))
        if r.bin_id is not None:
            bins[r.bin_id].append(r)
    for k, t in enumerate(texts):
        at = 0
        for start, size in sorted(pieces[k]):
            assert start == at
            at += size
        assert at == len(t.split())
    for held in bins.values():
        total = sum(r.n_words for r in held)
        assert total <= 128 and {r.bin_words for r in held} == {total}
        assert sorted(r.slot for r in held) == list(range(len(held)))
        assert len({texts[r.doc_id] for r in held}) == len(held)
        assert max(Counter(r.source for r in held).values()) <= 3
    whole = packing.pack(edge).collect()
    assert {r.doc_id for r in whole} == {r.doc_id for r in edge.collect()}
    assert all(r.bin_id is None for r in whole if r.doc_id in (3, 4, 5))
    assert sum(r.n_words for r in whole if r.doc_id == 6) == 60_000
    assert packing.pack(nothing).count() == 0


def test_repeated_rows_spread_over_shards(documents):
    found = packing.pack(documents([(1, "the same words")] * 900), shard_rows=100).collect()
    assert len(found) == 900 and len({r.bin_id for r in found}) == 900  # copies never share a bin
    shards = Counter(r.bin_id >> packing.BIN_BITS for r in found)
    assert len(shards) >= 7 and max(shards.values()) < 200


def test_packing_follows_the_order_of_files(spark, documents, edge, nothing, tmp_path):
    rng = random.Random(8)
    order = list(range(400))
    rng.shuffle(order)
    rows = documents([(k, " ".join(["w"] * (1 + k % 30)) + f" {k}") for k in order]).orderBy("doc_id")
    rows.repartitionByRange(7, "doc_id").sortWithinPartitions("doc_id").write.parquet(f"{tmp_path}/ordered")
    found = packing.pack(spark.read.parquet(f"{tmp_path}/ordered"), shard_rows=50, in_order=True).collect()
    assert Counter(r.doc_id for r in found) == Counter(range(400))
    assert all(r.bin_id >> packing.BIN_BITS == r.doc_id // 50 for r in found)
    # No files, and a column of that name: dealt by hash.
    for other in (edge, nothing, rows.withColumn("_metadata", F.lit(1))):
        assert packing.pack(other, in_order=True).count() >= other.count()


def test_mix_spreads_rows_without_id(documents, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 32)
    texts = [f"text number {k} of many" for k in range(300)]
    found = mixing.mix(documents([(None, t) for t in texts] + [(None, None)] * 5)).collect()
    # One source: all its words are due, each at a time of its own.
    assert len(found) == 305 and sum(r.taken for r in found) == 300 * 5
    starts = sorted(r.positions[0] for r in found if r.taken)
    assert len(set(starts)) == 300 and starts[0] == 0


def clustered(rng, groups, per, dims=16, noise=0.04):
    centres = rng.normal(size=(groups, dims))
    return np.repeat(centres, per, 0) + noise * rng.normal(size=(groups * per, dims))


def test_graph_finds_links_of_dense_and_lone_vectors():
    rng = np.random.default_rng(0)
    x = np.vstack([clustered(rng, 150, 4), clustered(rng, 1, 300), rng.normal(size=(400, 16))])
    x = embedding_dedup.unit(x[rng.permutation(len(x))])
    near = x @ x.T >= 0.93
    found = hnsw.Graph(x.astype(np.float32)).within(x.astype(np.float32), 0.93, 24)
    got = sum(near[i, hits].sum() for i, hits in enumerate(found))
    assert got >= 0.98 * near.sum()
    assert all(near[i, hits].all() for i, hits in enumerate(found))


@pytest.mark.parametrize("shard_rows", [60, 20_000])
def test_vectors_against_all_pairs(spark, shard_rows):
    rng = np.random.default_rng(1)
    x = np.vstack([clustered(rng, 40, 3), rng.normal(size=(60, 16))]).astype(np.float32)
    labels = rng.integers(0, 2, len(x))
    x, labels = np.vstack([x, x[:5], x[:5]]), np.append(labels, [*labels[:5], *labels[:5]])
    rows = [(k, v.tolist(), int(lab)) for k, (v, lab) in enumerate(zip(x, labels, strict=True))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = {r.vec_id: r for r in embedding_dedup.near_vectors(table, shard_rows).collect()}
    unit = embedding_dedup.unit(x)
    near = (unit @ unit.T >= 0.93) & (labels[:, None] == labels)
    np.fill_diagonal(near, False)
    assert sum(found[k].n_links for k in found) >= 0.98 * near.sum()
    assert all(found[k].n_links <= near[k].sum() for k in found)
    reach = near | np.eye(len(x), dtype=bool)
    for _ in range(8):
        reach = reach @ reach
    want = reach.argmax(1)
    assert np.mean([found[k].component_id == want[k] for k in found]) > 0.97
    assert all(r.kept == (r.vec_id == r.component_id) for r in found.values())


def test_vectors_edge_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, [1.0, 0.0], 0, "x"),
        (2, [2.0, 0.0], 0, "x"),
        (3, [1.0, -0.0], 0, "x"),
        (3, [1.0, 0.0], 0, None),
        (4, [1.0, 0.0], None, "x"),
        (5, None, 0, "x"),
        (6, [], 0, "x"),
        (7, [0.0, 0.0], 0, "x"),
        (8, [1.0, None], 0, "x"),
        (9, [1.0, inf], 0, "x"),
        (10, [nan, 1.0], 0, "x"),
        (11, [1.0, 0.0, 0.0], 0, "x"),
        (12, [3e38, 1e30], 0, "x"),
        (None, [1.0, 0.0], 0, "x"),
        (13, [1e-40, 0.0], 1, "x"),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id string")
    found = embedding_dedup.near_vectors(table).collect()
    assert len(found) == len(rows)
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in found)
    linked = {1: 4, 2: 4, 3: 4, 12: 4}
    want = Counter((r[0], linked.get(r[0], 0), 1 if r[0] in linked else r[0], r[0] == 1 or r[0] not in (*linked, None)) for r in rows)
    assert got == want
    assert embedding_dedup.near_vectors(table.where("vec_id > 99")).count() == 0


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def test_url_lists_against_brute_force(spark):
    rng = random.Random(6)
    hosts = ["example.com", "a.example.com", "b.a.example.com", "other.org", "HOST.net:8080", "user@x.org", "1.2.3.4"]
    paths = ["", "/", "/a", "/a/b", "/a/b/c?q=/z", "//a", "#f", "?a/b"]
    captures = [(k, f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(hosts)}{rng.choice(paths)}", day(rng.randint(0, 20))) for k in range(200)]
    captures += [captures[0], (900, None, day(3)), (901, "no url", day(3)), (902, captures[1][1], None), (None, captures[2][1], day(9))]
    asked = ["example.com", "a.example.com", "com", "other.org", "other.org/a", "example.com/a/b", "host.net", "x.org", "1.2.3.4", "2.3.4", "example.com/a/b/c"]
    entries = [(rng.choice(["l1", "l2"]), p, day(rng.randint(0, 20)), rng.choice(["add", "add", "remove"])) for p in asked for _ in range(4)]
    entries += [entries[0], (None, "x.org", day(1), "add"), ("l1", None, day(1), "add"), ("l1", "x.org", None, "add"), ("l1", "x.org", day(1), "odd")]
    schema = "page_id long, url string, fetched_at timestamp_ntz, list string"
    table = spark.createDataFrame([(*c, "z") for c in captures], schema)
    listed = spark.createDataFrame([(*e, 1) for e in entries], "list string, pattern string, dated timestamp_ntz, action string, since int")
    found = url_lists.evaluate(table, listed).collect()

    def active(name, pattern, at):
        own = sorted((d, a) for n, p, d, a in entries if (n, p) == (name, pattern) and d is not None and d <= at and a in ("add", "remove"))
        return bool(own) and own[-1][1] == "add"

    def wanted(url):
        if url is None or "://" not in url:
            return []
        rest = url.split("://", 1)[1]
        cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
        host = rest[:cut].split("@")[-1].split(":")[0].lower()
        path = rest[cut:].split("?")[0].split("#")[0]
        labels, segments = host.split("."), [s for s in path.split("/") if s]
        ups = {".".join(labels[i:]) for i in range(len(labels) - 1)}
        return ups | {host + "/" + "/".join(segments[:i]) for i in range(1, len(segments) + 1)}

    want = []
    for page, url, at in captures:
        met = [(n, p) for p in wanted(url) for n in ("l1", "l2") if at is not None and active(n, p, at)]
        want.append((page, url, at, len(met), ",".join(sorted({n for n, _ in met})), bool(met)))
    assert Counter(map(tuple, found)) == Counter(want)
    assert url_lists.evaluate(table.where("page_id < 0"), listed).count() == 0
    assert url_lists.evaluate(table, listed.where("list = 'none'")).where("blocked").count() == 0


def test_pipeline_stages(spark, edge, nothing, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(1, 1, 0), (6, 1, 0), (8, 1, 0), (3, 0, 0), (4, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    for docs in (edge, nothing):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            if name != "packing":
                assert out.columns == docs.columns
            out.write.parquet(f"{folder}/{name}-{docs is nothing}-{random.random()}")
    edge.write.parquet(f"{folder}/documents.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} <= {r.doc_id for r in edge.collect()}
