import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from palaver.llm import simhash_dedup as dedup
from palaver.llm.components import connected_components


def components(values, budget):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, v in enumerate(values):
        for j in range(i):
            if (v ^ values[j]).bit_count() <= budget:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(values))]


def test_fingerprint_counts_votes_of_all_shingles():
    text = "A b C d e f a B c d"
    words = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert dedup.simhash(text.encode()) == want
    assert dedup.simhash(b"") == dedup.simhash(b" \n") == 0
    assert dedup.simhash(b"Two words") == xxhash.xxh64_intdigest("two words", 42)
    assert dedup.simhash(" É".encode()) == xxhash.xxh64_intdigest(" É", 42)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=2, max_size=12, unique=True), st.data())
def test_follow_finds_exactly_the_pairs_within_budget(seeds, data):
    rng = random.Random(data.draw(st.integers(0, 999)))
    values = set(seeds)
    for v in seeds:
        for _ in range(4):
            for b in rng.sample(range(64), rng.randint(1, 7)):
                v ^= 1 << b
            values.add(v)
    values = np.array(sorted(values), np.uint64)
    found = set()
    whole = (np.array([0]), np.array([len(values)]))
    dedup.follow(values, (*whole, *whole), 4, lambda i, j: found.update(map(tuple, np.sort(np.stack([i, j], 1), 1).tolist())))
    want = {(i, j) for j in range(len(values)) for i in range(j) if int(values[i] ^ values[j]).bit_count() <= 4}
    assert found == want


@pytest.mark.parametrize("trie_rows", [3, 2048])
def test_links_reach_the_same_components_as_all_pairs(spark, trie_rows):
    rng = random.Random(4)
    values = {rng.getrandbits(64) for _ in range(60)} | {0}
    for v in sorted(values):
        for _ in range(rng.choice([0, 1, 30])):
            for b in rng.sample(range(64), rng.randint(1, 4)):
                v ^= 1 << b
            values.add(v)
    values = sorted(values)
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    links = dedup.trie_links(fps, trie_rows=trie_rows)
    assert all((r.a ^ r.b) != 0 for r in links.collect())
    names = {r.node: r.component for r in connected_components(links).collect()}
    got = [names.get(v, v) for v in signed]
    want = components(values, 4)
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_components_of_chains_stars_and_noise(spark):
    chain = [(i, i + 1) for i in range(1, 40)]
    star = [(100, 100 + i) for i in range(1, 50)]
    rows = [*chain, *star, (7, 7), (None, 3), (200, 201), (201, 200), (-5, 202)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(rows, "a long, b long")).collect()}
    want = {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 150)} | {200: 200, 201: 200, -5: -5, 202: -5}
    assert found == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edge_rows(edge, nothing):
    found = dedup.near_duplicates(edge).collect()
    assert len(found) == edge.count()
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, []).append(r)
    assert {r.component_id for r in by_id[2]} == {1} and len(by_id[2]) == 2
    zero = [r for r in found if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in zero} == {3, 4, 5, None} and {r.component_id for r in zero} == {3}
    alone = [r for r in by_id[None] if r.fingerprint != "0" * 16]
    assert [r.component_id for r in alone] == [None] and alone[0].kept
    assert by_id[9][0].component_id == 6
    assert dedup.near_duplicates(nothing).count() == 0


def test_one_row_of_each_group_stays(edge, nothing, documents):
    kept = dedup.drop_near_duplicates(edge)
    assert kept.columns == edge.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 6, 7, 8]
    assert dedup.drop_near_duplicates(nothing).count() == 0
    twice = documents([(1, "same id, another text entirely, said the one"), (1, "and nothing like it was ever written by us")])
    assert dedup.drop_near_duplicates(twice).count() == 2
    words = " ".join(f"w{i * i % 97}" for i in range(400))
    shared = documents([(3, words), (5, words + " w"), (5, "yet another text of its own, kept by itself"), (5, words + " w")])
    found = {(r.doc_id, r.text[:3]) for r in dedup.drop_near_duplicates(shared).collect()}
    assert found == {(3, words[:3]), (5, "yet")}


def test_kept_rows_against_plain_components(documents):
    rng = random.Random(6)
    rows = []
    for k in range(60):
        words = [f"w{rng.randint(0, 300)}" for _ in range(rng.choice([5, 80, 300]))]
        for copy in range(rng.choice([1, 1, 4])):
            changed = [rng.choice(words) if copy and rng.random() < 0.01 else w for w in words]
            rows.append((1000 - len(rows) if rng.random() < 0.9 else 7, " ".join(changed)))
    prints = [dedup.simhash(t.encode()) for _, t in rows]
    names = dict(zip(sorted(set(prints)), components(sorted(set(prints)), 4), strict=True))
    first = {}
    for (doc_id, text), fp in zip(rows, prints, strict=True):
        first.setdefault(names[fp], []).append((doc_id, text))
    found = dedup.drop_near_duplicates(documents(rows)).collect()
    assert len(found) == len(first)
    lowest = sorted(min(i for i, _ in group) for group in first.values())
    assert sorted(r.doc_id for r in found) == lowest
    assert all(any((r.doc_id, r.text) in group for group in first.values()) for r in found)
