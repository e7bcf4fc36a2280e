"""The manifest against a plain tree in memory."""

from collections import Counter
from hashlib import sha256
from zlib import crc32

import pytest

from palaver.llm import manifest


def plain(rows):
    """Rows ``(doc_id, source, lang, n_chars, text)`` to result rows, one tree at a time."""

    def h(*parts):
        return sha256("".join(parts).encode()).hexdigest()

    def part(value):
        return "-" if value is None else f"{len(str(value).encode())}:{value}"

    def climb(row):
        """The root of a list of digests and each one's runs on its way up as (place, run)."""
        ways, at = [[] for _ in row], list(range(len(row)))
        while len(row) > 1:
            runs = [row[i : i + 16] for i in range(0, len(row), 16)]
            for k, way in enumerate(ways):
                way.append((at[k] % 16, runs[at[k] // 16]))
                at[k] //= 16
            row = [h(*run) for run in runs]
        return row[0], ways

    sources = {}
    for row in rows:
        leaf = h(*map(part, row))
        sources.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf, row))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    subroots, inner = {}, {}
    for name in names:
        sources[name].sort(key=lambda x: x[:3])
        subroots[name], inner[name] = climb([x[2] for x in sources[name]])
    root, upper = climb([subroots[name] for name in names])
    out = []
    for k, name in enumerate(names):
        for (_, _, leaf, row), way in zip(sources[name], inner[name], strict=True):
            way = way + upper[k]
            proof = h(*(d for place, run in way for d in run[:place] + run[place + 1 :]))
            folded = leaf
            if row[0] is not None and crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])
                folded = h(*map(part, (*row[:4], lowered)))
            for place, run in way:
                folded = h(*run[:place], folded, *run[place + 1 :])
            out.append((row[0], leaf, subroots[name], root, proof, folded, folded == root))
    return Counter(out)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree int, place string, leaf string, n int, `first` long"


def found(spark, rows):
    table = spark.createDataFrame([(*r, 1, "p", "l", 2, 3) for r in rows], SCHEMA).repartition(3)
    return Counter(map(tuple, manifest.manifest(table).collect()))


@pytest.mark.parametrize("sizes", [(1,), (2,), (16, 1), (17, 256, 257), (700, *[1] * 40, 300)])
def test_against_a_plain_tree(spark, sizes):
    rows = [
        (k * 1000 + i, f"s{k % 23}ä", "en", i, f"Text {i} OF {k}")
        for k, n in enumerate(sizes)
        for i in range(n)
    ]
    assert found(spark, rows) == plain(rows)


def test_edge_rows(spark):
    rows = [
        (1, None, "en", 3, "ABC"), (1, None, "en", 3, "ABC"), (2, None, None, None, None), (None, None, "en", 0, ""),
        (None, None, None, None, "X"), (3, "", "en", 1, "É Ü A"), (-7, "𝒳", "e", 2, "a:b"), (5, "￿", "e", 2, "LONG " * 50_000),
        (10**18 + 1, "t", "e", 2, "Q"), (12, "t", "e", 5, "Shout"), (28, "t", "e", 5, "quiet"),
    ] + [(8, "t", "e", 1, "Same")] * 600
    result = found(spark, rows)
    assert result == plain(rows)
    assert any(not r[-1] for r in result) and any(r[-1] for r in result)


def test_no_rows(spark):
    assert found(spark, [(1, "a", "b", 1, "c")][:0]) == Counter()


def test_a_changed_leaf_changes_the_root(spark):
    rows = [(i, f"s{i % 3}", "en", 1, f"t{i}") for i in range(60)]
    other = [*rows[:-1], (59, "s2", "en", 1, "t59 ")]
    first, second = found(spark, rows), found(spark, other)
    assert {r[3] for r in first}.isdisjoint(r[3] for r in second)
