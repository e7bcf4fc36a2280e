"""Declared shapes of the tables the operators exchange."""

from __future__ import annotations

CONTENT = "struct<added: array<string>, removed: array<string>>"

ENTRY = (
    "struct<id: struct<rev_id: bigint, rev_text: string>, title: string, sender: string, receiver: string, "
    f"comment: string, timestamp: timestamp, size: int, content: {CONTENT}>"
)

VECTOR = "array<struct<idx: int, value: double>>"

ENTRY_DOCUMENT = (
    f"entry {ENTRY}, labels map<string, boolean>, "
    f"features map<string, map<string, double>>, vector {VECTOR}, "
    "internal struct<slice: int>"
)

MODEL_WEIGHTS = (
    "label string, tags map<string, string>, idx int, weight double, trained_at timestamp"
)

PREDICTION_COLUMNS = [
    "label", "id", "predicted", "coded", "confidence", "correct", "diff", "snippet",
]
