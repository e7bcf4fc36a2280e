"""Ids by ranks equal those by merges; bytes of tokens give the text back."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from palaver.llm import tokens

FILE, RANKS = tokens.path(tokens.BYTES_FILE), tokens.path(tokens.RANKS_FILE)
PARTS = [" ", "  ", "   ", "\n", "\n\n", "\t", "\x1c", "\x85", "\xa0", "'s", "'", "a", "the", "The", "12", ".", "日本", "▁",
         "<|endoftext|>", "<s>", "<0x41>", "𝒳", "\x00", "ing", "Ünï", "http://a.b/c?d=e", "ZZZZ", "qqqqqq"]


@pytest.mark.parametrize("plain", [True, False])
def test_ranks_equal_merges(plain):
    merges = Tokenizer.from_file(FILE)
    merges.encode_special_tokens = plain
    own = tokens.byte_level(FILE, RANKS, plain)

    @settings(max_examples=400, deadline=None)
    @given(st.lists(st.one_of(st.sampled_from(PARTS), st.text(max_size=5)), max_size=14).map("".join))
    def equal(text):
        assert own.encode(text).tolist() == merges.encode(text, add_special_tokens=False).ids

    equal()


def test_long_texts_without_words():
    own = tokens.byte_level(FILE, RANKS, True)
    for text in (" " * 1_200_000, "\n " * 600_000 + "x", "ab" * 300_000):
        assert b"".join(own.bytes[i] for i in own.encode(text)) == text.encode()


def test_bytes_of_tokens():
    text = " Ünï 𝒳\n<|endoftext|> 1"
    for own, given_text in ((tokens.byte_level(FILE, RANKS, True), text), (tokens.piece_level(tokens.path(tokens.PIECES_FILE)), text[1:])):
        ids = own.encode(given_text)
        assert ids.dtype == np.dtype("<u4")
        assert b"".join(own.bytes[i] for i in ids) == text.encode()
