"""License scan: templates with optional and replaceable regions, compiled to automata over words.

In a template ``[...]`` may be absent and ``{n}`` stands for up to ``n`` words of any kind; all other
words are mandatory and have to match one by one. A template begins with mandatory words; the
places where they stand are found by a search for bytes, and only there does its automaton run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import utf8

# The phrases and labels of the contract.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Wordings of public licenses and notices, by label.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [the software] to deal in the software without restriction"),
    ("isc", "permission to use copy modify and [or] distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("apache-2.0", "licensed under the apache license [version] 2 0 [the license]"),
    ("apache-2.0", "under the terms of the apache license [version] 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu [{2}] general public license"),
    ("gpl", "released under the [terms of the] gnu [{1}] general public license [version {1}]"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under [a] [the] creative commons attribution [{3}] [international] license"),
    ("cc-by", "this work is licensed under cc by [{2}]"),
    ("cc0", "to the extent possible under law {8} has waived all copyright and related or neighboring rights to {8} work"),
    ("warranty-disclaimer", "provided as is without warranty of any kind [express or implied]"),
    ("reserved", "copyright [c] {6} all rights reserved"),
)

#: Bytes to words: A-Z in lower case, everything that is no letter, digit or non-ASCII byte a blank.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


@dataclass(frozen=True)
class Automaton:
    """States are numbers; ``word[s]`` leads on to ``s + 1`` (None: any word), ``skip[s]`` also to later ones."""

    label: str
    head: bytes
    word: tuple[bytes | None, ...]
    skip: tuple[tuple[int, ...], ...]

    def closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for later in self.skip[todo.pop()]:
                if later not in seen:
                    seen.add(later)
                    todo.append(later)
        return seen

    def match(self, words: list[bytes], start: int) -> int | None:
        """Past the end of the longest match from ``start``, if there is any."""
        states, at, best, goal = self.closure({0}), start, None, len(self.word)
        while states:
            if goal in states:
                best = at
            if at == len(words):
                break
            states = self.closure({s + 1 for s in states if s < goal and self.word[s] in (None, words[at])})
            at += 1
        return best


def compiled(label: str, template: str) -> Automaton:
    word: list[bytes | None] = []
    skip: dict[int, set[int]] = {}
    opened: list[int] = []
    head: list[str] = []
    plain = True
    for token in re.findall(r"\[|\]|\{\d+\}|[^\s\[\]]+", template):
        if token == "[":
            opened.append(len(word))
            plain = False
        elif token == "]":
            skip.setdefault(opened.pop(), set()).add(len(word))
        elif token[0] == "{":
            plain = False
            end = len(word) + int(token[1:-1])
            for state in range(len(word), end):
                skip.setdefault(state, set()).add(end)
            word += [None] * int(token[1:-1])
        else:
            word.append(token.encode())
            head += [token] * plain
    if not head or opened:
        raise ValueError(f"a template begins with mandatory words and closes its brackets: {template}")
    later = tuple(tuple(sorted(skip.get(s, ()))) for s in range(len(word) + 1))
    return Automaton(label, " ".join(head).encode(), tuple(word), later)


def places(line: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which ``phrase`` stands in ``line``, words parted and enclosed by one blank."""
    found, wanted = [], b" " + phrase + b" "
    at, counted, number = line.find(wanted), 0, 0
    while at >= 0:
        number += line.count(b" ", counted, at)
        counted = at
        found.append(number)
        at = line.find(wanted, at + 1)
    return found


def scan(text: bytes, automata: list[Automaton]) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str]]]:
    """The number of words, places and labels of phrases, and ``(start, end, label)`` of templates."""
    words = words_of(text)
    line = b" " + b" ".join(words) + b" "
    base = sorted((at, label) for phrase, label in PHRASES.items() for at in places(line, phrase.encode()))
    found = []
    for automaton in automata:
        for at in places(line, automaton.head):
            end = automaton.match(words, at)
            if end is not None:
                found.append((at, end, automaton.label))
    return len(words), base, sorted(found)


def covered(spans: list[tuple[int, int]]) -> int:
    total, last = 0, 0
    for start, end in sorted(spans):
        total += max(0, end - max(start, last))
        last = max(last, end)
    return total


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches string"


def license_scan(documents: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """Rows of ``SCHEMA``, one per document; a null text is empty, and an empty one scores 0.

    ``score`` is the share of the text's words within phrases or matched templates; ``matches`` lists
    templates' ``label:start:end`` in word numbers, ends exclusive.
    """
    automata = [compiled(label, template) for label, template in templates]
    lengths = {label: len(phrase.split()) for phrase, label in PHRASES.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                count, base, found = scan(text, automata)
                spans = [(at, at + lengths[label]) for at, label in base] + [(s, e) for s, e, _ in found]
                labels = {label for _, label in base}
                out.append(
                    (
                        count,
                        len(base),
                        base[0][0] if base else None,
                        base[-1][0] if base else None,
                        ",".join(sorted(labels)),
                        ",".join(sorted(labels | {label for _, _, label in found})),
                        covered(spans) / count if count else 0.0,
                        ",".join(f"{label}:{s}:{e}" for s, e, label in found),
                    )
                )
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else []
            if columns:
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), utf8()).mapInArrow(run, SCHEMA)
