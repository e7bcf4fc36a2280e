"""Packing by lengths: enumeration, least squares and a round trip of every id."""

import random
from collections import defaultdict
from itertools import combinations_with_replacement
from zlib import crc32

import numpy as np
import pytest
from tokenizers import Tokenizer

from palaver.llm import token_packing as tp
from palaver.llm import tokens


def test_fillings_against_enumeration():
    rng = random.Random(1)
    for _ in range(20):
        lengths = rng.sample(range(1, 64), rng.randint(1, 40))
        want = {c for c in combinations_with_replacement(sorted([0, *lengths]), 3) if sum(c) == 64 and c[1]}
        found = [tuple(map(int, w)) for w in tp.fillings(np.array(lengths), 64)]
        assert len(found) == len(set(found)) and set(found) == want


def plain_nnls(a, y):
    """Active sets: the least squares solution with the fewest free variables that no other improves."""
    free, x = [], np.zeros(a.shape[1])
    for _ in range(500):
        slope = a.T @ (y - a @ x)
        slope[free] = -1
        if slope.max() < 1e-9:
            break
        free.append(int(slope.argmax()))
        while True:
            s = np.linalg.lstsq(a[:, free], y, rcond=None)[0]
            if s.min() > 0:
                break
            old = x[free]
            step = min(o / (o - n) for o, n in zip(old, s, strict=True) if n <= 0)
            x[free] = old + step * (s - old)
            gone = [f for f in free if x[f] <= 1e-12]
            free = [f for f in free if f not in gone]
            x[gone] = 0
        x[:] = 0
        x[free] = s
    return x


def test_repeats_against_active_sets():
    rng = np.random.default_rng(2)
    for _ in range(10):
        histogram = rng.integers(0, 30, 33)
        histogram[[0, 32]] = 0
        ways = tp.fillings(np.flatnonzero(histogram), 32)
        a = np.zeros((33, len(ways)))
        for k, way in enumerate(ways):
            for n in way:
                a[n, k] += n > 0
        best = np.square(a @ plain_nnls(a, histogram) - histogram).sum()
        own = np.square(a @ tp.repeats(ways, histogram, 2000) - histogram).sum()
        assert own <= best + 0.002 * np.square(histogram).sum()
        used = np.zeros(33, int)
        for way, times in tp.rounded(ways, tp.repeats(ways, histogram), histogram):
            np.add.at(used, ways[way], times)
        assert (used[1:] <= histogram[1:]).all()


def test_lay_covers_every_position_once():
    rng = random.Random(3)
    for _ in range(30):
        sizes = [rng.choice([1, 7, rng.randint(1, 40), rng.randint(1, 400)]) for _ in range(rng.randint(0, 200))]
        windows, rest = tp.lay(sizes, 32)
        assert all(sum(n for _, _, n in w) == 32 for w in windows) and sum(n for _, _, n in rest) < 32
        ends = tp.powers(rest)
        assert [bin(sum(n for _, _, n in w)).count("1") for w in ends] == [1] * len(ends)
        at = defaultdict(int)
        for item, start, n in sorted(p for w in windows + ends for p in w):
            assert start == at[item] and n > 0
            at[item] += n
        assert [at[k] for k in range(len(sizes))] == sizes


@pytest.mark.parametrize("chunk_rows", [5, 16_384])
def test_every_id_lies_in_one_piece(documents, edge, nothing, chunk_rows):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(["some", "Words", "ünï", "9", "<|endoftext|>"]) for _ in range(rng.choice([0, 3, 300, 1500])))) for k in range(60)]
    rows += [(100 + k, "the same") for k in range(40)]
    plain = Tokenizer.from_file(tokens.path(tokens.BYTES_FILE))
    want = {k: [*plain.encode(t, add_special_tokens=False).ids, 0] for k, t in rows}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in tp.pack_tokens(documents(rows), chunk_rows=chunk_rows).collect():
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(want[r.doc_id]) and len(ids) == r.length > 0
        assert r.ids_crc32 == crc32(np.array(ids, "<u4").tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for k, ids in want.items():
        at = 0
        for start, length in sorted(pieces[k]):
            assert start == at
            at += length
        assert at == len(ids)
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024 and at.bit_count() == 1
    found = tp.pack_tokens(edge, chunk_rows=chunk_rows).collect()
    total = sum(len(plain.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in edge.collect())
    assert sum(r.length for r in found) == total
    assert {r.doc_id for r in found} == {r.doc_id for r in edge.collect()}
    assert tp.pack_tokens(nothing).count() == 0
