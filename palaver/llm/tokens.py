"""Public tokenizers as texts to ids, loaded once per worker; nothing is trained here.

The byte-level vocabulary exists twice, as a file of merges and as ranks, with the same ids. Ranks are
read two to three times as fast; texts that could exceed that library's stack are read by merges.
"""

from __future__ import annotations

import base64
import json
import os
from functools import lru_cache

import numpy as np
import public_tokenizers
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

BYTES_FILE = "byte_bpe_50k.json"
RANKS_FILE = "byte_bpe_50k.tiktoken"
PIECES_FILE = "piece_bpe_32k.model"
#: Characters of a text read by ranks.
SHORT = 200_000


def path(name: str) -> str:
    return public_tokenizers.path(name)


def unicode_bytes() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 characters stand for themselves, all other bytes in turn for those from 256 on.
    """
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Bytes:
    """A byte-level vocabulary. ``plain`` takes the strings of special tokens for ordinary text."""

    def __init__(self, file: str, ranks: str, plain: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.merges = Tokenizer.from_file(file)
        self.merges.encode_special_tokens = plain
        with open(file, encoding="utf-8") as vocabulary:
            special = {t["content"]: t["id"] for t in json.load(vocabulary)["added_tokens"]}
        with open(ranks, "rb") as lines:
            known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens=special)
        self.allowed = set() if plain else set(special)
        stands, added = unicode_bytes(), {number: text.encode() for text, number in special.items()}
        names = map(self.merges.id_to_token, range(self.merges.get_vocab_size()))
        self.bytes = [added[i] if i in added else bytes(map(stands.__getitem__, t)) for i, t in enumerate(names)]

    def encode(self, text: str) -> np.ndarray:
        if len(text) > SHORT:
            found = self.merges.encode(text, add_special_tokens=False).ids
        else:
            found = self.ranks.encode(text, allowed_special=self.allowed, disallowed_special=())
        return np.fromiter(found, "<u4", len(found))


class Pieces:
    """A vocabulary of pieces, with bytes for what has no piece; it puts a blank before each text."""

    def __init__(self, file: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=file)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [
            bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode()
            for i, n in enumerate(names)
        ]

    def encode(self, text: str) -> np.ndarray:
        found = self.model.encode(text)
        return np.fromiter(found, "<u4", len(found))


@lru_cache(maxsize=4)
def byte_level(file: str, ranks: str, plain: bool) -> Bytes:
    return Bytes(file, ranks, plain)


@lru_cache(maxsize=4)
def piece_level(file: str) -> Pieces:
    return Pieces(file)
