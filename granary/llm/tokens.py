"""Whole-text encoding with the tokenizers library, fast enough for a corpus.

Byte-level and word-level BPE never merges across the boundaries of its pre-tokens. A text is therefore cut at such
boundaries, and a bounded table keeps the ids of pieces already seen; only new pieces reach the library. Texts of plain
characters (Latin-1 letters, digits, ASCII punctuation other than the apostrophe, white space) are cut into the very
pre-tokens, which the library's model encodes. Other texts are cut at white space and go through the whole tokenizer.
A tokenizer of any other make encodes whole texts.
"""

from __future__ import annotations

import contextlib
import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator

#: Unicode White_Space, which the tokenizers' patterns mean by \s; fixed values.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACED = re.compile(f"[{_SPACE}]?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]").findall
_WORDS = re.compile(r"[^\t-\r ]+").findall
#: Plain characters: what both patterns take for letters, digits, other signs and white space alike.
_L, _P, _S = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff", r"""!"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~""", "\t\n\r "
_ODD = re.compile(f"[^{_L}{_P}0-9{_S}]").search
_PLAIN_SPACED = re.compile(f" ?[{_L}]+| ?[0-9]+| ?[{_P}]+|[{_S}]+(?![^{_S}])|[{_S}]+").findall
_PLAIN_WORDS = re.compile(f"[{_L}]+|[0-9]|[{_P}]+").findall
ROWS = 256


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level models use for each byte: printable ones are themselves, the rest count up from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


_LETTERS = _byte_letters()


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _make(spec: dict) -> str:
    """How to cut a text, from the tokenizer's own description: spaced, words or whole."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if spec["model"].get("type") != "BPE" or spec["model"].get("dropout"):
        return "whole"
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
        return "spaced"
    steps = [(n.get("type"), (n.get("pattern") or {}).get("Regex"), n.get("content")) for n in (norm or {}).get("normalizers", [])]
    split, *more = pre.get("pretokenizers") or [{}]
    pattern = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
    if [x[0] for x in steps] == ["NFC", "Replace", "Lowercase"] and steps[1][1:] == (r"\s+", " ") and [m.get("type") for m in more] == ["ByteLevel"]:
        if split.get("behavior") == "Removed" and split.get("invert") and split["pattern"].get("Regex") == pattern and not more[0].get("use_regex"):
            return "words"
    return "whole"


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes. limit: pieces that each table keeps."""

    def __init__(self, path: str, limit: int = 1 << 16):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._model, self._kind, self._special = self._tok.model, _make(spec), [t["content"] for t in spec.get("added_tokens") or []]
        self._plain: dict[str, bytes] = {}
        self._other: dict[str, bytes] = {}
        self.limit, self.size = limit, self._tok.get_vocab_size()

    def _pieces(self, new: list[str]) -> Iterator[bytes]:
        """Of pre-tokens."""
        for p in new:
            yield array("I", [t.id for t in self._model.tokenize(p.encode().decode("latin-1").translate(_LETTERS))]).tobytes()

    def _texts(self, new: list[str]) -> Iterator[bytes]:
        for x in self._tok.encode_batch_fast(new, add_special_tokens=False):
            yield array("I", x.ids).tobytes()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if self._kind == "whole" or any(s in text for s in self._special):
            return next(self._texts([text]))
        words = self._kind == "words"
        if _ODD(text):
            pieces, known, encode = (_WORDS if words else _SPACED)(text), self._other, self._texts
        else:
            pieces, known, encode = _PLAIN_WORDS(text.lower()) if words else _PLAIN_SPACED(text), self._plain, self._pieces
        new = [p for p in set(pieces) if p not in known]
        if not new:
            return b"".join(map(known.__getitem__, pieces))
        ids = dict(zip(new, encode(new), strict=True))
        if len(known) + len(ids) <= self.limit:
            known.update(ids)
            return b"".join(map(known.__getitem__, pieces))
        return b"".join([known.get(p) or ids.get(p, b"") for p in pieces])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def rows(batches: Iterable, *columns: str) -> Iterator[tuple]:
    """Rows of Arrow batches, a few at a time, so that a batch of long texts isn't held twice. Ends with tidy()."""
    for batch in batches:
        cols = [batch.column(c) for c in columns]
        for at in range(0, batch.num_rows, ROWS):
            yield from zip(*[c.slice(at, ROWS).to_pylist() for c in cols], strict=True)
    tidy()


def tidy() -> None:
    """Give freed memory back: Python workers live on after a task."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)
