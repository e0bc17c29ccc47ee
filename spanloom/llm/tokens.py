"""Token ids of whole texts, with a cache of what has been encoded before.

A byte-level BPE vocabulary of this kind cuts a text by a fixed pattern before it merges, and that
pattern never joins what stands before a blank to the blank and the non-white-space character
after it. So a text is the concatenation of its parts between such blanks, and each part has the
same ids wherever it stands. Parts seen before come from a cache; new ones are cut by the pattern
and go through the tokenizers library's merges. The cache is emptied at a fixed size. A text that
holds one of the vocabulary's added tokens as a string is not cut: it goes to the library as it is.
"""

from __future__ import annotations

import os
import re
import struct
from pathlib import Path

import numpy as np

#: Entries of the cache, about 200 bytes apiece.
CACHE = 450_000

#: A part with a character above this is not cut before it is encoded.
_PLAIN = "\u024f"
_BLANKS = re.compile(r" \s").search
_ENCODERS: dict[tuple[str, int], Encoder] = {}


def vocabulary_json(path: str | None = None) -> str:
    """The vocabulary file's text, read on the driver and sent with the job."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return Path(path).read_text(encoding="utf-8")


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else the next from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Encoder:
    """Encodes lists of texts into little-endian unsigned 16- or 32-bit ids."""

    def __init__(self, vocabulary: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.cut = regex.compile(public_tokenizers.PATTERN).findall
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.holds_added = re.compile("|".join(map(re.escape, added)), re.I).search if added else lambda t: None
        self.letters = byte_letters()
        self.pack = {n: struct.Struct(f"<{n}{'H' if self.dtype.itemsize == 2 else 'I'}").pack for n in range(1, 65)}
        self.cache = cache
        self.parts: dict[str, bytes] = {}
        self.signs: dict[str, bytes] = {}

    @staticmethod
    def of(vocabulary: str, cache: int = CACHE) -> Encoder:
        """One encoder for a worker process, kept from task to task."""
        key = (vocabulary, cache)
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = Encoder(vocabulary, cache)
        return _ENCODERS[key]

    @staticmethod
    def release() -> None:
        """Drops the worker process's encoder and its cache, for work that needs neither."""
        _ENCODERS.clear()

    @staticmethod
    def split(text: str) -> list[str]:
        """Parts of the text; each but the first stands after a blank that belongs to it."""
        parts = text.split(" ")
        if not parts[-1] or _BLANKS(text):
            merged = parts[:1]
            for p in parts[1:]:
                if p and not p[0].isspace():
                    merged.append(p)
                else:
                    merged[-1] += " " + p
            return merged
        return parts

    def _pieces(self, part: str) -> list[str]:
        """The pattern's pieces of ' ' + part."""
        if part.isalpha() or part and max(part) > _PLAIN:
            return [" " + part]
        if part[-1:] in (".", ",") and part[:-1].isalpha():
            return [" " + part[:-1], part[-1]]
        return self.cut(" " + part)

    def _piece(self, piece: str) -> bytes:
        """Ids of one of the pattern's pieces; its bytes go to the library's merges as letters."""
        if max(piece) > _PLAIN:
            ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        else:
            letters = self.letters
            ids = [t.id for t in self.tokenizer.model.tokenize("".join([letters[b] for b in piece.encode()]))]
        return self.pack[len(ids)](*ids) if len(ids) <= 64 else np.array(ids, self.dtype).tobytes()

    def _learn(self, part: str) -> bytes:
        """Ids of ' ' + part. A piece that is a blank and a word shares the word's entry."""
        known = self.parts
        if part.isalpha() and max(part) <= _PLAIN:
            made = self._piece(" " + part)
        else:
            ids = []
            for piece in self._pieces(part):
                word = piece[1:]
                if piece[0] == " " and word.isalpha() and word != part:
                    x = known.get(word)
                    ids.append(self._learn(word) if x is None else x)
                elif len(piece) > 3:
                    ids.append(self._piece(piece))
                else:
                    x = self.signs.get(piece)
                    if x is None:
                        if len(self.signs) > self.cache // 10:
                            self.signs.clear()
                        x = self.signs[piece] = self._piece(piece)
                    ids.append(x)
            made = b"".join(ids)
        known[part] = made
        return made

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; a null text has none."""
        if len(self.parts) > self.cache:
            self.parts.clear()
        whole = {i: t for i, t in enumerate(texts) if t and self.holds_added(t)}
        # What stands first has no blank before it and goes by itself.
        rows = [self.split(t) if t and i not in whole else [""] for i, t in enumerate(texts)]
        firsts = self.tokenizer.encode_batch_fast([r[0] for r in rows], add_special_tokens=False)
        known = self.parts.get
        found = [list(map(known, r[1:])) for r in rows]
        learn, out = self._learn, []
        for r, f, first in zip(rows, found, firsts):
            if None in f:
                f = [x if x is not None else known(p) or learn(p) for p, x in zip(r[1:], f)]
            head = np.array(first.ids, self.dtype).tobytes() if r[0] else b""
            out.append(np.frombuffer(head + b"".join(f), self.dtype))
        for i, t in whole.items():
            out[i] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, self.dtype)
        return out
