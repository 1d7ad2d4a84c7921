"""Token ids of white-space words, by the tokenizers library.

The tokenizer file drops white space and never joins characters across it, so a text's ids are its words' ids in a row.
A word made of plain letters and trailing punctuation goes straight to the library's BPE model; every other word goes
through the library's whole pipeline (special tokens, normalisation, splitting).
"""

from __future__ import annotations

import re
import sys
from array import array

from tokenizers import Tokenizer

#: Letters that are their own NFC form, with a one-to-one lower case, and no apostrophe that could be a contraction.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for the code points from 256 on."""
    out, extra = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


_LETTERS = _byte_letters()


class WordIds(dict):
    """word in UTF-8 -> its ids as packed little-endian integers; words are encoded when first asked for, then remembered,
    up to ``limit`` of them; so are up to ``parts`` lower-cased parts of words."""

    def __init__(self, tokenizer_json: str, width: int = 4, limit: int | None = 800_000, parts: int = 100_000):
        super().__init__()
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.width, self.limit, self.parts, self.most = width, limit, {}, parts

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            if len(self.parts) >= self.most:
                self.parts.clear()
            spelt = part if part.isascii() else part.encode().decode("latin-1").translate(_LETTERS)
            found = self.parts[part] = self.pack([t.id for t in self.tokenizer.model.tokenize(spelt)])
        return found

    def pack(self, ids: list[int]) -> bytes:
        packed = array("H" if self.width == 2 else "I", ids)
        if sys.byteorder != "little":
            packed.byteswap()
        return packed.tobytes()

    def encode(self, word: str) -> bytes:
        m = _PLAIN.fullmatch(word)
        if m:
            return self._part(m[1].lower()) + (self._part(m[2]) if m[2] else b"")
        return self.pack(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def __missing__(self, word: bytes) -> bytes:
        ids = self.encode(word.decode())
        if self.limit is not None and len(self) >= self.limit:
            self.clear()
        self[word] = ids
        return ids

    def text(self, text: bytes | None) -> bytes:
        """``text`` in UTF-8; bytes.split() cuts at the six ASCII white-space characters only, all of which the tokenizer drops."""
        return b"".join(map(self.__getitem__, text.split())) if text else b""


_made: dict[tuple, WordIds] = {}


def word_ids(tokenizer_json: str, width: int = 4) -> WordIds:
    """One instance per worker process, kept from task to task."""
    key = (hash(tokenizer_json), width)
    if key not in _made:
        _made[key] = WordIds(tokenizer_json, width)
    return _made[key]
