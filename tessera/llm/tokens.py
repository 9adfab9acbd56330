"""Token ids of whole texts by a public tokenizer file, a word at a time.

The vocabulary file's pre-tokenizer never joins characters across white space, and its normaliser treats white space
alone, so the ids of a text are those of its parts between ASCII white space, one after the other. Each Python worker
keeps the ids of up to KEPT_WORDS parts, found by 64-bit hashes of their bytes in flat arrays, a buffer of texts at a
time; of the others, those of letters go straight to the tokenizer's model, the rest to the tokenizer.
"""

from __future__ import annotations

import sys
import unicodedata
from array import array

import numpy as np

from . import common

#: Distinct parts whose ids a worker keeps; beyond it starts anew. Texts with parts longer than LONG_PART bytes go to the tokenizer whole.
KEPT_WORDS, SLOTS, LONG_PART = 1_000_000, 1 << 21, 4096


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: How byte-level vocabularies write bytes: printable ones as themselves, the others as characters from 256 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_AS_CHARACTERS = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}


def pack(kind: str, ids: list[int]) -> bytes:
    out = array(kind, ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Kept:
    """Ids by hash: an open-addressed table of keys, with places in one array of ids."""

    def __init__(self, kind: str):
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(SLOTS, np.uint64)
        self.first = np.zeros(SLOTS, np.int32)
        self.size = np.zeros(SLOTS, np.uint16)
        self.ids = np.zeros(1 << 20, self.kind)
        self.n = self.used = 0

    def slots(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each hash its slot, or the free one where it belongs; and whether it is there."""
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        key = self.keys[slot]
        on = np.flatnonzero((key != h) & (key != 0))
        while len(on):
            slot[on] = (slot[on] + 1) & (SLOTS - 1)
            k = self.keys[slot[on]]
            on = on[(k != h[on]) & (k != 0)]
        return slot, self.keys[slot] == h

    def add(self, h: np.ndarray, ids: list[bytes]) -> None:
        """Distinct hashes that are not there yet, with their packed ids."""
        flat = np.frombuffer(b"".join(ids), self.kind)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.ids.itemsize
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        first = self.used + np.cumsum(size) - size
        self.used += len(flat)
        self.n += len(h)
        todo = np.arange(len(h))
        while len(todo):  # of several that belong into one free slot, one stays and the others look again
            slot, _ = self.slots(h[todo])
            self.keys[slot] = h[todo]
            put = self.keys[slot] == h[todo]
            own = todo[put]
            self.first[slot[put]], self.size[slot[put]] = first[own], size[own]
            todo = todo[~put]


class WordEncoder:
    """encode(texts) gives each text's ids as an array of little-endian unsigned integers of WIDTH bytes."""

    def __init__(self, path: str, width: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind, self.kept = f"<u{width}", Kept(f"<u{width}")
        self.model = self.tokenizer.model
        self.format = "H" if width == 2 else "I"
        self.tails = {c: self.whole(c) for c in ".,"}
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def packed(self, ids: list[int]) -> bytes:
        return pack(self.format, ids)

    def letters(self, w: bytes) -> bytes | None:
        """The ids of a part of letters, which is one pre-token, straight from the model; with one full stop or comma after them, also a token."""
        text = w.decode("utf-8", "surrogatepass")
        tail = self.tails.get(text[-1], b"")
        if tail:
            text = text[:-1]
        if not text.isalpha() or "\u03a3" in text:  # the normaliser knows no final sigma
            return None
        if text.isascii():
            text = text.lower()
        else:
            if not unicodedata.is_normalized("NFC", text):
                return None
            text = text.lower()
            if not text.isalpha():
                return None
            text = text.encode("utf-8", "surrogatepass").decode("latin-1").translate(_AS_CHARACTERS)
        return pack(self.format, [t.id for t in self.model.tokenize(text)]) + tail

    def whole(self, text: str) -> bytes:
        return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for lo, hi in common.buffers(texts):
            out += self._buffer(texts[lo:hi])
        return out

    def _buffer(self, texts: list[str | None]) -> list[np.ndarray]:
        raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        # A special token's string is cut out before a text is split, so such texts are left to the tokenizer.
        apart = [any(s in r for s in self.special) for r in raw]
        buf, start, end, offsets, total, back = common.word_spans([b"" if p else r for r, p in zip(raw, apart)])
        if len(start) and (end - start).max() > LONG_PART:
            for i in np.unique(np.searchsorted(offsets, np.flatnonzero(end - start > LONG_PART), side="right") - 1):
                apart[i] = True
            buf, start, end, offsets, total, back = common.word_spans([b"" if p else r for r, p in zip(raw, apart)])
        h = common.mix((total[end] - total[start]) * back + (end - start).astype(np.uint64)) | np.uint64(1)
        slot, there = self.kept.slots(h)
        if not there.all():
            if self.kept.n > KEPT_WORDS:
                self.kept.clear()
                there = np.zeros(len(h), bool)
            new, at = np.unique(h[~there], return_index=True)
            where = np.flatnonzero(~there)[at]
            text = buf.tobytes()
            self.kept.add(new, [self.part(text[a:b]) for a, b in zip(start[where].tolist(), end[where].tolist())])
            slot, _ = self.kept.slots(h)
        size = self.kept.size[slot].astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.kept.ids[np.repeat(self.kept.first[slot] - upto[:-1], size) + np.arange(upto[-1])]
        edges = upto[offsets]
        return [np.frombuffer(self.whole(t), self.kind) if p else ids[a:b] for t, p, a, b in zip(texts, apart, edges[:-1], edges[1:])]

    def part(self, w: bytes) -> bytes:
        ids = self.letters(w)
        return self.whole(w.decode("utf-8", "surrogatepass")) if ids is None else ids


_encoders: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, width: int) -> WordEncoder:
    """The worker's encoder for a file, made once."""
    if (path, width) not in _encoders:
        _encoders[path, width] = WordEncoder(path, width)
    return _encoders[path, width]
