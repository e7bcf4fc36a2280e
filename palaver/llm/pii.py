"""Personal data in texts: fixed patterns, and spans a trained character tagger adds to them.

The tagger reads overlapping windows around every digit and at sign of a text, as each span it knows
holds one. What it proposes is reconciled over the whole text: spans cut by a window's inner edge are
left to the neighbour window, those that clash are chosen for the greatest total margin, and those
that touch a pattern's span, or fail the check of their kind, go.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm import tagger
from palaver.llm.tagger import KINDS, passes_luhn

Span = tuple[int, int, int]  # start, kind, end

# The patterns as the contract states them, cut so that each is found in linear time.
MAIL_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
MAIL_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

ANCHOR = re.compile(r"[0-9@]+")
WIDTH = 96
STRIDE = 48
MARGIN = 36
#: Windows decoded at once.
BATCH = 1024


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def small_parts(text: str) -> bool:
    return all(len(p) <= 3 and int(p) <= 255 for p in (p.lstrip("0") or "0" for p in text.split(".")))


def pattern_spans(text: str) -> list[Span]:
    """Spans of the patterns by start and kind, leftmost and apart within a kind."""
    found: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in MAIL_NAME:
            start -= 1
        host = MAIL_HOST.match(text, at + 1) if start < at else None
        if host:
            done = host.end()
            found.append((start, 0, done))
        at = text.find("@", max(at + 1, done))
    for match in DOTTED.finditer(text):
        parts, at = match[0].split("."), match.start()
        for k in range(0, len(parts), 4):
            four = ".".join(parts[k : k + 4])
            if k + 4 <= len(parts) and small_parts(four):
                found.append((at, 1, at + len(four)))
            at += len(four) + 1
    for match in CARD.finditer(text):
        if len(match[0]) >= 14 and 14 <= len(number := digits(match[0])) <= 19 and passes_luhn(number):
            found.append((match.start(), 2, match.end()))
    if "+" in text:
        for match in PHONE.finditer(text):
            if 10 <= len(digits(match[0])) <= 15:
                found.append((match.start(), 3, match.end()))
    return sorted(found)


def window_starts(text: str) -> list[int]:
    """Where windows begin: they cover every digit and at sign with ``MARGIN`` characters around."""
    starts: list[int] = []
    last = -1  # the end of what is covered
    for anchor in ANCHOR.finditer(text):
        low, high = max(0, anchor.start() - MARGIN), anchor.end() + MARGIN
        if high <= last:
            continue
        at = starts[-1] + STRIDE if low < last else low
        while True:
            starts.append(at)
            last = at + WIDTH
            if last >= min(high, len(text)):
                break
            at += STRIDE
    return starts


def plausible(kind: int, text: str) -> bool:
    number = digits(text)
    if kind == 0:
        name, _, host = text.partition("@")
        return bool(name) and "." in host.strip(".") and not re.search(r"\s", text)
    if kind == 1:
        return text.count(".") == 3 and re.fullmatch(r"[0-9.]+", text) is not None and ".." not in text and text[0] != "." != text[-1] and small_parts(text)
    if kind == 2:
        return 14 <= len(number) <= 19 and passes_luhn(number) and re.fullmatch(r"[0-9]+(?:[^0-9A-Za-z][0-9]+)*", text) is not None
    return 10 <= len(number) <= 15 and re.fullmatch(r"[+(]?[0-9][ ().0-9-]*[0-9]", text) is not None


def proposals(starts: list[int], length: int, path: np.ndarray, margin: np.ndarray) -> dict[Span, float]:
    """Spans tagged in a text's windows with their greatest mean margin."""
    best: dict[Span, float] = {}
    for at, tags, gain in zip(starts, path, margin, strict=True):
        for first in np.flatnonzero(tags % 2 == 1).tolist():
            end = first + 1
            while end < WIDTH and tags[end] == tags[first] + 1:
                end += 1
            if end == WIDTH and at + WIDTH < length or first == 0 and at > 0 or at + end > length:
                continue
            span = (at + first, int(tags[first]) // 2, at + end)
            best[span] = max(best.get(span, 0.0), float(gain[first:end].mean()))
    return best


def reconcile(text: str, base: list[Span], proposed: dict[Span, float]) -> list[Span]:
    """Of the plausible proposals apart from ``base``, a set without clashes of greatest margin."""
    taken = sorted((s, e) for s, _, e in base)
    longest = max((e - s for s, e in taken), default=0)
    heads = [s for s, _ in taken]

    def free(start: int, end: int) -> bool:
        near = range(bisect_right(heads, start - longest - 1), bisect_right(heads, end - 1))
        return all(taken[i][1] <= start or taken[i][0] >= end for i in near)

    spans = sorted((e, s, k, g) for (s, k, e), g in proposed.items() if free(s, e) and plausible(k, text[s:e]))
    ends, total, choice = [0], [0.0], [None]
    for end, start, kind, gain in spans:
        before = bisect_right(ends, start) - 1
        better = total[before] + gain > total[-1]
        choice.append((before, (start, kind, end)) if better else None)
        ends.append(end)
        total.append(max(total[-1], total[before] + gain))
    chosen, at = [], len(ends) - 1
    while at > 0:
        if choice[at]:
            at, span = choice[at]
            chosen.append(span)
        else:
            at -= 1
    return chosen


def find_spans(texts: list[str], model: tagger.Tagger) -> list[tuple[list[Span], list[Span]]]:
    """For each text the spans of the patterns, and all spans."""
    base = [pattern_spans(t) for t in texts]
    starts = [window_starts(t) for t in texts]
    owner = [(k, at) for k, own in enumerate(starts) for at in own]
    proposed: list[dict[Span, float]] = [{} for _ in texts]
    for low in range(0, len(owner), BATCH):
        part = owner[low : low + BATCH]
        pieces = [texts[k][at : at + WIDTH] for k, at in part]
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        x = np.full((len(part), WIDTH), tagger.PADDING)
        x[np.arange(WIDTH) < sizes[:, None]] = tagger.symbols("".join(pieces))
        path, margin = tagger.decode(model, x)
        for row in np.flatnonzero((path > 0).any(1)).tolist():
            k, at = part[row]
            for span, gain in proposals([at], len(texts[k]), path[row : row + 1], margin[row : row + 1]).items():
                proposed[k][span] = max(proposed[k].get(span, 0.0), gain)
    return [(own, sorted(own + reconcile(t, own, p))) for t, own, p in zip(texts, base, proposed, strict=True)]


def written_out(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def personal_data(documents: DataFrame, seed: int = 11) -> DataFrame:
    """Rows ``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)``, one per document.

    Counts and ``base_sha256`` are of the patterns' spans, ``spans`` has the tagger's too. A null text
    counts as empty and has no spans. Positions are in code points, ends exclusive.
    """
    model = tagger.trained(seed)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = find_spans(batch.column(1).to_pylist(), model)
            counts = [Counter(kind for _, kind, _ in base) for base, _ in found]
            columns = [batch.column(0), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(len(KINDS)))]
            hashes = [hashlib.sha256(written_out(base).encode()).hexdigest() for base, _ in found]
            columns += [pa.array(hashes, pa.string()), pa.array([written_out(x) for _, x in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")))
    counted = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInArrow(scan, f"doc_id long, {counted}, base_sha256 string, spans string")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each stretch covered by spans replaced by the kind of the first of them."""
    pieces, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            pieces += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join(pieces) + text[at:]


def redact(documents: DataFrame, seed: int = 11) -> DataFrame:
    """The documents, all columns, with personal data replaced by its kind; null texts stay null.

    ``n_chars``, where there, is set to the new length in code points.
    """
    model = tagger.trained(seed)
    at = documents.columns.index("text")
    size_at = documents.columns.index("n_chars") if "n_chars" in documents.columns else None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = find_spans([t or "" for t in texts], model)
            new = [t and redacted(t, spans) for t, (_, spans) in zip(texts, found, strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if size_at is not None:
                sizes = [None if t is None else len(t) for t in new]
                columns[size_at] = pa.array(sizes, batch.schema.field(size_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return documents.mapInArrow(scan, documents.schema)
