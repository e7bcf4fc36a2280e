"""Alignment against sets of ends and plain counting."""

import random
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from palaver.llm import alignment, tokens


def plain_groups(a, b):
    """Groups of tokens from ends, by the set of shared ends."""
    one, two = ({end: k for k, end in enumerate(ends, 1)} for ends in (a, b))
    return [(one[end], two[end]) for end in sorted(one.keys() & two.keys())]


@pytest.mark.parametrize("probes", [1, 8])
def test_cuts_against_the_set_of_shared_ends(monkeypatch, probes):
    monkeypatch.setattr(alignment, "PROBES", probes)
    rng = random.Random(1)
    for _ in range(100):
        texts = []
        for _ in range(rng.randint(1, 6)):
            total = rng.randint(1, 90)
            texts.append([sorted({total, *rng.sample(range(1, total + 1), rng.randint(0, total - 1))}) for _ in "ab"])
        firsts = np.cumsum([(0, 0), *((len(a), len(b)) for a, b in texts)], axis=0)
        before = np.cumsum([0, *(a[-1] for a, _ in texts)])
        ends = [np.concatenate([np.array(t[k]) + at for t, at in zip(texts, before, strict=False)]) for k in (0, 1)]
        partner = alignment.shared_cuts(*ends, firsts)
        for (a, b), (i, j), (i1, _) in zip(texts, firsts, firsts[1:], strict=False):
            own = partner[i:i1]
            assert [(k + 1, p + 1 - j) for k, p in enumerate(own) if p >= 0] == plain_groups(a, b)


def test_linked_against_plain_pairs(monkeypatch):
    rng = np.random.default_rng(2)
    for wide in (65_536, 4):
        monkeypatch.setattr(alignment, "WIDE", wide)
        for _ in range(50):
            sizes = rng.integers(1, 5, (rng.integers(1, 9), 2))
            cuts = np.cumsum(sizes, 0)
            a, b = (rng.integers(0, 4, n).astype("<u4") for n in cuts[-1])
            want = Counter()
            for (i, j), (x, y) in zip(cuts, cuts - sizes, strict=True):
                want.update(int(p) << 16 | int(q) for p in a[x:i] for q in b[y:j])
            pairs, times = alignment.linked(a, b, cuts)
            assert pairs.tolist() == sorted(want) and times.tolist() == [want[p] for p in sorted(want)]


def plain(rows):
    """Result rows of ``(doc_id, text)``, everything held at once."""
    one = Tokenizer.from_file(tokens.path(tokens.BYTES_FILE))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=tokens.path(tokens.PIECES_FILE))
    names = tokens.byte_level(tokens.path(tokens.BYTES_FILE), tokens.path(tokens.RANKS_FILE), True).bytes

    def spelled(i):
        name = two.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if two.is_byte(i) else name.replace("▁", " ").encode()

    documents, counts = [], Counter()
    for doc_id, text in rows:
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        parts = [names[i] for i in a], [spelled(i) for i in b]
        if any(b"".join(p) != (" " + (text or "")).encode() for p in parts):
            a, b, parts = [], [], ([], [])
        ends = [np.cumsum(list(map(len, p))).tolist() for p in parts]
        groups, x, y = [], 0, 0
        for i, j in plain_groups(*ends):
            groups.append((a[x:i], b[y:j]))
            x, y = i, j
        links = Counter((p, q) for g in groups for p in g[0] for q in g[1])
        counts.update(links.keys())
        documents.append((doc_id, a, b, groups, links))
    best = defaultdict(int)
    for (p, _), n in counts.items():
        best[p] = max(best[p], n)
    out = []
    for doc_id, a, b, groups, links in documents:
        shown = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((
            doc_id, len(a), len(b), len(groups), sum(links.values()),
            sum(n for link, n in links.items() if counts[link] == best[link[0]]),
            sum(n * counts[link] for link, n in links.items()), sha256(shown.encode()).hexdigest() if a else "",
        ))
    return Counter(out)


@pytest.mark.parametrize("hot", [0, 40, 1_000_000])
def test_against_plain_counting(documents, edge, nothing, hot, monkeypatch):
    rng = random.Random(4)
    words = ["the", "cat", "Ünï", "𝒳", "antidisestablishment", "12345", "日本語", "\n", "<s>", "<|endoftext|>", "a ▁ b", "x  y", "🙂🙃"]
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for k in range(80)] + [(7, "the cat"), (None, "the cat")] * 3
    assert Counter(map(tuple, alignment.align(documents(rows), hot=hot).collect())) == plain(rows)
    monkeypatch.setattr(alignment, "HELD", 3000)
    own = [(r.doc_id, r.text) for r in edge.collect()]
    assert Counter(map(tuple, alignment.align(edge, hot=hot).collect())) == plain(own)
    assert alignment.align(nothing, hot=hot).count() == 0
