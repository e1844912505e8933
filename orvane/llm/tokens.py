"""Byte-level BPE with the tokenizers library, made cheap by a memo of pieces.

A text's ids are the ids of its pre-tokens in order.  Between two characters
that are not white space, a single space or line break always begins a new
pre-token, so texts are cut there first and whole chunks are looked up; a chunk
not seen before is cut by the tokenizer's own pattern, and only pieces not seen
before are encoded by the library.  A line that has other white space at a cut
is cut by the pattern as a whole.  The ids are those of the library.
"""

from __future__ import annotations

import os
import threading
from array import array

import numpy as np

from .common import MODELS

#: Entries of a memo after which it ages: it is the old one then, and what is used from there comes into the new one.
MEMO = 500_000
#: Longer pieces are encoded each time.
LONG = 64
_LOCK = threading.Lock()
_KEPT: dict[str, BpeEncoder] = {}
MODELS.append(_KEPT)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_signs() -> dict[int, str]:
    """The printable sign that byte-level BPE uses for each byte: itself where it is printable, else the next free one from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Memo(dict):
    """Values by key, made by ``made`` where missing; holds two generations of entries."""

    def __init__(self):
        self.old: dict = {}

    def __missing__(self, key: str):
        out = self.old[key] if key in self.old else self.made(key)
        if len(key) <= LONG:
            self[key] = out
        return out

    def age(self) -> None:
        if len(self) > MEMO:
            self.old = dict(self)
            self.clear()


class _Signs(dict):
    """The signs of a character's bytes."""

    def __init__(self):
        super().__init__()
        self.of_byte = byte_signs()

    def __missing__(self, char: str) -> str:
        out = self[char] = "".join(self.of_byte[b] for b in char.encode())
        return out


class _Pieces(_Memo):
    """Ids of pre-tokens; a missing one is encoded by the library's model."""

    def __init__(self, model, kind: str, n_ids: int):
        super().__init__()
        self.tokenize, self.signs = model.tokenize, _Signs()
        self.one = [array(kind, [k]).tobytes() for k in range(n_ids)]

    def made(self, piece: str) -> bytes:
        return self.of_signs("".join(map(self.signs.__getitem__, piece)))

    def of_signs(self, signs: str) -> bytes:
        one = self.one
        return b"".join([one[t.id] for t in self.tokenize(signs)])


class _Chunks(_Memo):
    """Ids of chunks that follow ``lead``; None for a chunk at whose ends a cut would be wrong."""

    def __init__(self, lead: str, pieces: _Pieces, cut):
        super().__init__()
        self.lead, self.pieces, self.cut = lead, pieces, cut
        self.signs, self.of_signs = pieces.signs.__getitem__, pieces.of_signs
        self.lead_sign = "".join(map(self.signs, lead))

    def made(self, chunk: str) -> bytes | None:
        if chunk.isalpha():  # letters alone are one pre-token
            return self.of_signs(self.lead_sign + (chunk if chunk.isascii() else "".join(map(self.signs, chunk))))
        if not chunk:
            return None if self.lead else b""
        if chunk[0].isspace() or chunk[-1].isspace():
            return None
        if chunk[-1] in ".,;:!?" and chunk[:-1].isalpha():
            return self[chunk[:-1]] + self.pieces[chunk[-1]]
        return b"".join(map(self.pieces.__getitem__, self.cut(self.lead + chunk)))


class BpeEncoder:
    """Encodes texts to unsigned 16- or 32-bit ids (little-endian hosts).  Special strings in a text are ordinary text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        small = self.library.get_vocab_size() <= 65_536
        self.dtype = np.dtype("<u2" if small else "<u4")
        self.cut = regex.compile(public_tokenizers.PATTERN).findall
        self.pieces = _Pieces(self.library.model, "H" if small else "I", self.library.get_vocab_size())
        self.first, self.later = _Chunks("", self.pieces, self.cut), _Chunks(" ", self.pieces, self.cut)
        self.breaks = self.pieces["\n"]

    def _whole(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.cut(text)))

    def encode(self, text: str) -> bytes:
        for memo in (self.pieces, self.first, self.later):
            memo.age()
        out, lines = [], text.split("\n")
        if len(lines) > 1 and "" in lines:
            return self._whole(text)
        for line in lines:
            words = line.split(" ")
            if words[0] == "" and len(words) > 1:
                return self._whole(text)
            head = self.first[words[0]]
            try:
                out.append(head + b"".join(map(self.later.__getitem__, words[1:])))
            except TypeError:  # a None among them
                return self._whole(text)
        return self.breaks.join(out)


def encoder(path: str) -> BpeEncoder:
    """The encoder of this Python worker."""
    with _LOCK:
        if path not in _KEPT:
            _KEPT[path] = BpeEncoder(path)
        return _KEPT[path]
