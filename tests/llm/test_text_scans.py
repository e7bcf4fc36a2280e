"""Personal data, licenses, quality, language model and fingerprints."""

import collections
import hashlib
import re
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palaver.llm import fingerprints, language_model, licenses, pii, quality, tagger


def brute_spans(text):
    patterns = (
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"[0-9]([\x20-]?[0-9])+",
        r"\+[0-9][\x20().0-9-]+[0-9]",
    )
    found = []
    for kind, pattern in enumerate(patterns):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fits = (
                True,
                kind != 1 or all(int(p) <= 255 for p in m[0].split(".")),
                14 <= len(digits) <= 19 and pii.passes_luhn(digits),
                10 <= len(digits) <= 15,
            )[kind]
            if fits:
                found.append((m.start(), kind, m.end()))
    return sorted(found)


@settings(max_examples=400, deadline=None)
@given(st.text("ab1234567890@.-+ ()é", max_size=60))
def test_pattern_spans_are_those_of_the_plain_patterns(text):
    assert pii.pattern_spans(text) == brute_spans(text)


def test_patterns_take_linear_time():
    for unit in ("a", "1", "1.", "@", "a@", "+1", "+", "1 ", "a.", "-"):
        pii.pattern_spans(unit * 200_000)


def test_windows_cover_every_anchor_with_margin():
    text = "x" * 500 + "1" * 300 + "y" * 40 + "@" + "z" * 1000 + "7"
    starts = pii.window_starts(text)
    seen = np.zeros(len(text), bool)
    for at in starts:
        seen[at : at + pii.WIDTH] = True
    for k, c in enumerate(text):
        if c in "17@":
            assert seen[max(0, k - pii.MARGIN) : k + pii.MARGIN].all()
    assert starts == sorted(set(starts)) and pii.window_starts("no anchors") == []


def test_tagger_on_unseen_windows():
    model = tagger.trained()
    x, gold = tagger.labelled_windows(300, np.random.default_rng(123))
    path, _ = tagger.decode(model, x)
    assert (path == gold)[gold > 0].mean() > 0.9 and (path == gold)[path > 0].mean() > 0.9


def test_gradients_of_the_tagger_agree_with_differences():
    rng = np.random.default_rng(1)
    model = tagger.fresh(5)
    x, gold = tagger.labelled_windows(3, rng)
    x, gold = x[:, :12], np.minimum(gold[:, :12], 1)

    def loss():
        score = tagger.emissions(model, x)
        move, alpha = model.move + tagger.FORBIDDEN, score[:, 0] + tagger.START
        best = score[np.arange(3), 0, gold[:, 0]] + tagger.START[gold[:, 0]]
        for t in range(1, 12):
            alpha = np.log(np.exp(alpha[:, :, None] + move).sum(1)) + score[:, t]
            best = best + move[gold[:, t - 1], gold[:, t]] + score[np.arange(3), t, gold[:, t]]
        return float((np.log(np.exp(alpha).sum(1)) - best).mean())

    grads = tagger._gradients(model, x, gold)
    for array, grad in zip(model.arrays(), grads, strict=True):
        for _ in range(4):
            at = tuple(int(rng.integers(0, n)) for n in array.shape)
            kept = array[at]
            array[at] = kept + 1e-5
            more = loss()
            array[at] = kept - 1e-5
            less = loss()
            array[at] = kept
            assert (more - less) / 2e-5 == pytest.approx(grad[at], abs=1e-6, rel=1e-3)


def test_model_adds_spans_and_base_ones_stay(documents):
    text = "please call (555) 123-4567 or 555-987-6543 or write to a.b@mail.example.com today"
    found = {r.doc_id: r for r in pii.personal_data(documents([(1, text), (2, "nothing 123 here v1.2.3")])).collect()}
    assert "email" in found[1].spans and "phone" in found[1].spans and found[1].n_phone == 0
    assert found[2].spans == ""
    (base, spans), *_ = pii.find_spans([text], tagger.trained())
    assert set(base) <= set(spans)
    assert pii.redacted("ab cd", [(0, 0, 2), (1, 1, 4)]) == "[EMAIL]d"


def test_personal_data_edge_rows(edge, nothing):
    found = pii.personal_data(edge).collect()
    assert len(found) == edge.count()
    empty = hashlib.sha256(b"").hexdigest()
    for r in found:
        if r.doc_id in (3, 4, 5):
            assert (r.base_sha256, r.spans) == (empty, "")
    assert [(r.n_phone, r.n_ip) for r in found if r.doc_id == 8] == [(1, 1)]
    new = pii.redact(edge)
    assert new.columns == edge.columns and new.schema == edge.schema
    rows = {r.doc_id: r for r in new.where("doc_id is not null").collect()}
    assert rows[4].text is None and rows[4].n_chars is None and rows[3].text == ""
    assert rows[8].text == "Ünï¢ödé 𝒳 text with call [PHONE] and [IP] in it"
    assert rows[8].n_chars == len(rows[8].text)
    assert pii.redact(nothing).count() == pii.personal_data(nothing).count() == 0


def test_template_regions():
    match = licenses.compiled("x", "one two [three [four]] five {2} six")
    for text, ends in {
        "one two five six": 4,
        "one two three five six": 5,
        "one two three four five a b six": 8,
        "one two four five six": None,
        "one two five a b c six": None,
        "one two three five": None,
        "one two five six six": 5,
    }.items():
        assert match.match([w.encode() for w in text.split()], 0) == ends, text
    with pytest.raises(ValueError):
        licenses.compiled("x", "[one] two")


def brute_license(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)
    found = []
    for phrase, label in licenses.PHRASES.items():
        own = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(own)] == own]
    return len(words), sorted(found)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["CC", "by", "General", "public", "LICENSE", "all", "rights", "reserved", "é", "x1"]), max_size=30), st.sampled_from([" ", "-", "\n", " \x7f_"]))
def test_phrases_as_brute_force(words, glue):
    text = glue.join(words)
    count, base, _ = licenses.scan(text.encode(), [])
    assert (count, base) == brute_license(text)


def test_licenses_edge_rows(edge, nothing, documents):
    found = licenses.license_scan(edge).collect()
    assert len(found) == edge.count() and all(0 <= r.score <= 1 for r in found)
    assert licenses.license_scan(nothing).count() == 0
    text = "Copyright (c) 2020 Some One. All rights reserved. Licensed under the Apache License, Version 2.0 (the License)"
    r = licenses.license_scan(documents([(1, text)])).collect()[0]
    assert (r.base_labels, r.labels, r.n_base, r.first_word) == ("reserved", "apache-2.0,reserved", 1, 5)
    assert r.score > 0.7 and "reserved:0:8" in r.matches


def test_quality_separates_and_calibrates(spark, documents):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for k in range(400):
        good = bool(rng.random() < 0.7)
        words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(40)]
        rows.append((k, " ".join(words) if good else "!! ".join(w.upper() for w in words)))
        labels.append((k, int(good), 0))
    scored = quality.score_quality(documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = {r.doc_id: r for r in scored.collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found.values())
    assert np.mean([found[k].predicted == good for k, good, _ in labels if found[k].held_out]) > 0.97


def test_isotonic_pools():
    raw, score = quality.isotonic(np.array([0.0, 1, 2, 3]), np.array([1.0, 0, 2, 1]), np.array([1.0, 1, 2, 1]))
    assert raw.tolist() == [0.5, pytest.approx(7 / 3)] and score.tolist() == [0.5, 1.0]


@pytest.mark.parametrize("some", [True, False])
def test_quality_edge_rows(spark, edge, nothing, some):
    rows = [(1, 1, 0), (8, 0, 0), (6, None, 0), (None, 1, 0), (2, 1, 0), (2, 0, 0), (77, 1, 0)] if some else []
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    found = quality.score_quality(edge, labels).collect()
    assert len(found) == edge.count() and all(r.score is not None for r in found)
    if not some:
        assert {r.score for r in found} == {0.5}
    kept = quality.keep_quality(edge, labels)
    assert kept.columns == edge.columns and kept.count() == sum(r.predicted for r in found)
    assert quality.score_quality(nothing, labels).count() == quality.keep_quality(nothing, labels).count() == 0


def test_language_model_prefers_what_it_has_seen(documents):
    rng = np.random.default_rng(0)
    base = "the old ship left the small harbour at night and the crew sang".split()
    rows = [(k, " ".join(base * 30)) for k in range(40)]
    rows += [(100, " ".join(base * 3)), (101, " ".join(rng.permutation(base * 3)))]
    found = {r.doc_id: r for r in language_model.language_scores(documents(rows), rounds=3).collect()}
    assert found[100].mean_log_prob > found[101].mean_log_prob
    assert found[100].n_tokens == 39 and found[100].log_prob == pytest.approx(39 * found[100].mean_log_prob)


def plain_shares(texts, head):
    """Per word its class and its share among the words of that class, counted anew."""
    counts = collections.Counter(language_model.hashes(" ".join(texts).encode()).tolist())
    ranked = sorted(counts, key=lambda w: (-counts[w], w))
    kinds, _ = language_model.classes_of(np.array([counts[w] for w in ranked[:head]]))
    kind = dict(zip(ranked[:head], map(int, kinds), strict=False))
    for word in ranked[head:]:
        kind[word] = language_model.HEAD_CLASSES + word % language_model.TAIL_CLASSES
    sizes = collections.Counter()
    for word, n in counts.items():
        sizes[kind[word]] += n
    return kind, {w: counts[w] / sizes[kind[w]] for w in counts}


def plain_score(weights, kinds):
    """Log-probability of a text's classes, one position after the other."""
    embed, enter, bias, out, out_bias = (w.astype(np.float64) for w in weights)
    edge = [language_model.EDGE] * language_model.SIDE
    line, total = edge + kinds + edge, 0.0
    for at in range(len(kinds)):
        seen = [line[at + k] for k in language_model.OFFSETS]
        h = np.tanh(sum(embed[c] @ w for c, w in zip(seen, enter, strict=True)) + bias)
        z = np.exp(h @ out + out_bias)
        total += np.log(z[line[at + language_model.SIDE]] / z.sum())
    return total


@pytest.mark.parametrize("head", [1, 70, 150, 1 << 18])
def test_language_scores_against_brute_force(documents, monkeypatch, head):
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(200)]
    texts = [" ".join(rng.choice(words, int(n), p=np.arange(200, 0, -1) / 20100)) for n in rng.integers(1, 120, 30)]
    weights = language_model.initial(9)
    monkeypatch.setattr(language_model, "train", lambda rows, rounds: weights)
    kind, share = plain_shares(texts, head)
    for own in set(kind.values()):
        assert sum(share[w] for w in share if kind[w] == own) == pytest.approx(1.0)
    # One id for all: scores are kept apart by row.
    found = language_model.language_scores(documents([(7, t) for t in texts]), head=head).collect()
    expected = []
    for text in texts:
        own = language_model.hashes(text.encode()).tolist()
        expected.append(plain_score(weights, [kind[w] for w in own]) + sum(np.log(share[w]) for w in own))
    assert sorted(r.log_prob for r in found) == pytest.approx(sorted(expected), rel=1e-4)


def test_language_model_slopes_against_differences():
    rng = np.random.default_rng(2)
    line = rng.integers(0, language_model.CLASSES, 60).astype(np.uint8)
    at, weights = np.arange(2, 58), language_model.initial()

    def loss(own):
        embed, enter, bias, out, out_bias = (w.astype(np.float64) for w in own)
        seen = [line[at + k - language_model.SIDE] for k in language_model.OFFSETS]
        h = np.tanh(sum(embed[c] @ w for c, w in zip(seen, enter, strict=True)) + bias)
        return -language_model.log_softmax(h @ out + out_bias)[np.arange(len(at)), line[at]].mean()

    trainer = language_model.Trainer(weights)
    trainer.step(line, at, 0.0)
    for k, first in enumerate(language_model.views(trainer.first)):
        for flat in rng.integers(0, first.size, 5):
            moved = []
            for way in (1e-4, -1e-4):
                own = [w.astype(np.float64) for w in weights]
                own[k].flat[flat] += way
                moved.append(loss(own))
            assert 10 * first.flat[flat] == pytest.approx((moved[0] - moved[1]) / 2e-4, abs=1e-4)


def test_a_training_step_makes_no_new_table_of_class_scores():
    rng = np.random.default_rng(5)
    line = rng.integers(0, language_model.CLASSES, language_model.BATCH + 4).astype(np.uint8)
    at, trainer = np.arange(2, language_model.BATCH + 2), language_model.Trainer(language_model.initial())
    trainer.step(line, at, 0.01)
    tracemalloc.start()
    trainer.step(line, at, 0.01)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * language_model.CLASSES * language_model.BATCH


def test_large_class_scores_are_shifted_before_their_exponentials():
    weights = language_model.initial()
    weights[3] = weights[3] * 200
    kinds = list(np.random.default_rng(6).integers(0, language_model.CLASSES, 50).tolist())
    found = language_model.scores(weights, [bytes(kinds)])
    assert found == pytest.approx([plain_score(weights, kinds)], rel=1e-4)


def test_training_on_all_tokens_lowers_the_loss(documents):
    rng = np.random.default_rng(1)
    pairs = [("red", "apple"), ("blue", "whale"), ("old", "house"), ("tall", "tree")]
    texts = [" ".join(" ".join(pairs[k]) for k in rng.integers(0, 4, 60)) for _ in range(2000)]
    head, _ = language_model.split_vocabulary(language_model.vocabulary(documents(list(enumerate(texts)))))
    rows = language_model.encoded(documents(list(enumerate(texts))), head)
    kinds = [bytes(r.classes) for r in rows.collect()]
    plain, fitted = language_model.initial(), language_model.train(rows)
    before, after = (language_model.scores(w, kinds).sum() / 240_000 for w in (plain, fitted))
    # Counts alone give log(1/8); a word's partner, on one side or the other, tells it for sure.
    assert before < -4 and after > np.log(1 / 8) / 2


def test_language_model_edge_rows(edge, nothing):
    found = language_model.language_scores(edge).collect()
    assert len(found) == edge.count()
    assert all(r.log_prob == 0 and r.mean_log_prob is None for r in found if r.doc_id in (3, 4, 5))
    assert language_model.language_scores(nothing).count() == 0


def test_edits_against_brute_force(documents, edge, nothing):
    rng = np.random.default_rng(7)
    rows = [(int(k), "".join(rng.choice(list("abé 𝒳"), int(rng.integers(0, 60))))) for k in rng.permutation(50)]
    found = {r.doc_id: r for r in fingerprints.document_prints(documents(rows)).collect()}
    order = sorted(rows, reverse=True)
    for (k, text), (after, following) in zip(order, order[1:] + order[:1], strict=True):
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]
        assert found[k].n_chars == len(text)
        assert found[k].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert found[k].edited_fingerprint == fingerprints.fingerprint(new.encode()).hex()
        assert found[k].next_fingerprint == found[after].fingerprint
        assert 0 <= found[k].near_edited <= 1 and 0 <= found[k].near_next <= 1
    assert fingerprints.document_prints(edge).count() == edge.count()
    assert fingerprints.document_prints(nothing).count() == 0
    one = fingerprints.document_prints(documents([(1, "ab cd")])).collect()
    assert [r.near_next for r in one] == [1.0]


@pytest.mark.parametrize("block_rows", [2, 4096])
def test_block_tables_find_all_within_the_radius(spark, block_rows):
    rng = np.random.default_rng(3)
    values = {int.from_bytes(rng.bytes(16), "big") for _ in range(20)}
    for v in sorted(values):
        for _ in range(6):
            values.add(v ^ sum(1 << int(b) for b in rng.choice(128, int(rng.integers(1, 5)), replace=False)))
    texts = [f"{v:032x}" for v in values]
    found = fingerprints.near_counts(spark.createDataFrame([(t,) for t in texts] * 2, "fingerprint string"), block_rows=block_rows)
    got = {r.fingerprint: r.n_near for r in found.collect()}
    want = {f"{v:032x}": sum(0 < (v ^ w).bit_count() <= 3 for w in values) for v in values}
    assert got == {k: n for k, n in want.items() if n}


def test_names_tell_words_apart_and_keep_their_endings():
    text = " Éa THE the  ab b x1-x1 é ".encode() + bytes(range(256)) + b" the"
    words, names = licenses.words_of(text), language_model.hashes(text).tolist()
    assert len(words) == len(names)
    assert len(set(words)) == len(set(zip(words, names, strict=True))) == len(set(names))
    for word, name in zip(words, names, strict=True):
        ending = [b & 31 for b in reversed(word[-3:])] + [0, 0]
        assert name >> language_model.HASHED == ending[0] << 10 | ending[1] << 5 | ending[2]


@pytest.fixture(scope="module")
def leaves():
    rng = np.random.default_rng(2)
    sizes = [1] * language_model.OWN_CLASSES + [37, 1, 0, 64] + [3] * (language_model.CLASSES - language_model.OWN_CLASSES - 4)
    starts = np.cumsum([0, *sizes])
    return language_model.Leaves(starts, rng.integers(0, 5, starts[-1]))


def test_leaves_of_a_class_share_it_as_the_hidden_layer_says(leaves):
    rng = np.random.default_rng(3)
    h = np.vstack([np.tanh(rng.normal(size=(language_model.HIDDEN, 1))), [[1.0]]]).astype(np.float32)
    for spread in (0.0, 2.0):
        within = rng.normal(size=language_model.WITHIN).astype(np.float32) * np.float32(spread)
        for kind in (64, 67, 70):
            own = np.arange(leaves.starts[kind], leaves.starts[kind + 1])
            own, n = own[leaves.counts[own] > 0], leaves.counts[own][leaves.counts[own] > 0]
            turns = language_model.Turns(within, leaves, np.full(len(own), kind), own, np.repeat(h, len(own), axis=1))
            assert np.sort(turns.at).tolist() == list(range(len(own)))
            share = np.exp(turns.log_probabilities())[np.argsort(turns.at)]
            assert share.sum() == pytest.approx(1.0, rel=1e-5)
            assert (share == pytest.approx(n / n.sum(), rel=1e-4)) == (spread == 0 or len(own) < 2)


def test_slopes_of_turns_against_differences(leaves):
    rng = np.random.default_rng(4)
    own = rng.choice(np.flatnonzero(leaves.counts), 300)
    kinds = np.searchsorted(leaves.starts, own, "right") - 1
    line = np.concatenate([[language_model.EDGE] * 2, kinds, [language_model.EDGE] * 2]).astype(np.uint8)
    at, whole = np.arange(2, 302), [*language_model.initial(), rng.normal(size=language_model.WITHIN).astype(np.float32)]

    def loss(weights):
        return -language_model.scores(weights, [line[2:-2].tobytes()], own, leaves)[0] / 300

    trainer = language_model.Trainer(whole)
    trainer.step(line, at, 0.0, own, leaves)
    for k, first in enumerate(language_model.views(trainer.first)):
        for flat in np.argsort(-np.abs(first).ravel())[:5]:
            moved = []
            for way in (1e-2, -1e-2):
                weights = [w.copy() for w in whole]
                weights[k].flat[flat] += np.float32(way)
                moved.append(loss(weights))
            assert 10 * first.flat[flat] == pytest.approx((moved[0] - moved[1]) / 2e-2, rel=0.05, abs=1e-4)


def test_words_of_one_class_are_told_apart_by_what_stands_around(documents):
    rng = np.random.default_rng(8)
    often = [f"w{k}x" for k in range(62)]
    pairs = [(f"a{k}ung", f"b{k}tion") for k in range(60)]
    odds = np.arange(100, 40, -1) / np.arange(100, 40, -1).sum()

    def piece():
        k, side = rng.choice(60, p=odds), int(rng.random() < 0.49)
        return [often[rng.integers(62)], ("der", "the")[side], pairs[k][side]]

    texts = [" ".join(sum((piece() for _ in range(100)), [])) for _ in range(1000)]
    (names, classes, *_), _ = language_model.split_vocabulary(language_model.vocabulary(documents(list(enumerate(texts)))))
    kind = dict(zip(names.tolist(), classes.tolist(), strict=True))
    own = [[kind[language_model.hashes(w.encode())[0]] for w in pair] for pair in pairs]
    same = [pair for pair, (a, b) in zip(pairs, own, strict=True) if a == b >= language_model.OWN_CLASSES]
    assert len(same) > 10
    right = " ".join(f"der {a} the {b}" for a, b in same)
    wrong = " ".join(f"der {b} the {a}" for a, b in same)
    rows = [*enumerate(texts), (-1, right), (-2, wrong)]
    found = {r.doc_id: r for r in language_model.language_scores(documents(rows)).collect()}
    assert found[-1].log_prob > found[-2].log_prob + len(same)
