"""Encoding by pieces equals the library's encoding of whole texts."""

import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from granary.llm.tokens import Encoder, default_path

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
PAIRS = {f: (Encoder(default_path(f), limit=40), Tokenizer.from_file(default_path(f))) for f in FILES}
plain = st.text(alphabet="aAbé ßÉz19.,;:!?-_|*$ \n\t\r'", max_size=60)


def same(f, text):
    ours, theirs = PAIRS[f]
    data = ours(text)
    assert list(struct.unpack(f"<{len(data) // 4}I", data)) == theirs.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("f", FILES)
@settings(max_examples=400, deadline=None)
@given(text=plain)
def test_plain(f, text):
    same(f, text)


@pytest.mark.parametrize("f", FILES)
@settings(max_examples=400, deadline=None)
@given(text=st.text(max_size=40))
def test_any_text(f, text):
    same(f, text)


@pytest.mark.parametrize("f", FILES)
@pytest.mark.parametrize("text", ["", " ", "a  b", "a\n \nb", "x <|endoftext|> y", "it's  I'LL", "İstanbul ΣΑΣ", "é ́a", "\x1c a\x85b\xa0c", "a" * 5000, "10.5%|x"])
def test_corners(f, text):
    same(f, text)
