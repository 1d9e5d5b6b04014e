"""Token ids of whole texts by a public tokenizer file, with an exact cache of text parts.

Texts are cut where the byte-level pattern always cuts, whatever stands around: its matches never cross
from a non-space to white space, from a lone line end or tab to what follows, or from a letter to ASCII that is
no letter. Each distinct part goes through the library once. Parts of up to 16 bytes are their own keys, two
64-bit words, in an open-addressing table that is searched for all parts of a piece at once.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa

from .common import mix, text_bytes

#: Slots of a worker's table (24 bytes each) as a power of two; it is thinned when over FULL of them are taken.
SLOT_BITS, FULL = 21, 0.7
#: Bytes of the longer parts that are kept; the longest of them. Parts that are looked up at a time.
LONG_BYTES, LONG_PART, AT_ONCE = 16 << 20, 128, 1 << 18
END_ID = 0

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_ASCII_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])
#: ASCII that is neither a letter nor white space.
_MARK = np.array([b < 128 and not chr(b).isalpha() for b in range(256)]) & ~_WHITE
#: First bytes of characters that are letters throughout (U+00C0 to U+017F), but for two signs.
_LATIN = np.zeros(256, bool)
_LATIN[[0xC3, 0xC4, 0xC5]] = True
#: Bytes that may begin white space beyond ASCII, a special token's string or a control that some engines take as white space.
_ODD = np.zeros(256, bool)
_ODD[[0x00, 0x1C, 0x1D, 0x1E, 0x1F, 0x3C, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _odd_places(data: np.ndarray) -> np.ndarray:
    """Places of what keeps a text from being cut: see _ODD."""
    at = np.flatnonzero(_ODD[data])
    if not len(at):
        return at
    padded = np.append(data, np.zeros(2, np.uint8))
    a, b, c = padded[at], padded[at + 1], padded[at + 2]
    wide = (a == 0xE2) & ((b == 0x80) & ((c <= 0x8B) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
    wide |= (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE3) & (b == 0x80) & (c == 0x80) | (a == 0xEF) & (b == 0xBB) & (c == 0xBF)
    wide |= (a == 0xE1) & ((b == 0x9A) & (c == 0x80) | (b == 0xA0) & (c == 0x8E)) | (a == 0x3C) & (b == 0x7C) | (a < 0x20)
    return at[wide]


def part_starts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the parts of all rows begin, and which rows are one part because they can't be cut."""
    cut = np.zeros(len(data) + 1, bool)
    white = _WHITE[data]
    first = np.zeros(len(data) + 1, bool)
    first[off] = True
    cut[1:-1] = white[1:] & ~white[:-1]
    lone = white[1:-1] & (data[1:-1] != 0x20) & ~white[2:] & (~white[:-2] | first[1:-2])
    cut[2:-1] |= lone
    if len(data) > 1 and white[0] and data[0] != 0x20 and not white[1]:
        cut[1] = True
    letter = _ASCII_LETTER[data]
    latin = _LATIN[data[:-1]] & ~((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
    letter[1:] |= latin
    cut[1:-1] |= _MARK[data[1:]] & letter[:-1]
    rows = np.unique(np.searchsorted(off, _odd_places(data), side="right") - 1)
    for a, b in zip(off[rows].tolist(), off[rows + 1].tolist(), strict=True):
        cut[a:b] = False
    cut[off[:-1]] = True
    return np.flatnonzero(cut[:-1]), rows


class Encoder:
    """Encodes texts as the library does with add_special_tokens=False."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.release()

    def release(self) -> None:
        """Forget the parts: a worker outlives its tasks, and other stages need the memory."""
        self.table = None
        self.long: dict[bytes, np.ndarray] = {}
        self.long_bytes = 0

    @classmethod
    def at(cls, path: str) -> Encoder:
        """One for each worker and file: workers are used for many tasks."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _clear(self) -> None:
        """Rows of the table: the part (16 bytes, zeros at its end), and place << 8 | number of its ids in the store."""
        self.table = np.zeros((1 << SLOT_BITS, 3), np.uint64)
        self.again = np.zeros(1 << SLOT_BITS, bool)
        self.store, self.used, self.held = np.zeros(1 << 20, self.kind), 0, 0

    @staticmethod
    def _slot(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (mix(low ^ high * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The third word of each part's row; 0 if it isn't there."""
        slot = self._slot(low, high)
        rows = self.table[slot]
        hit = (rows[:, 0] == low) & (rows[:, 1] == high)
        out = np.where(hit, rows[:, 2], np.uint64(0))
        self.again[slot[hit]] = True
        left = np.flatnonzero(~hit & (rows[:, 0] != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << SLOT_BITS) - 1)
            rows = self.table[slot[left]]
            hit = (rows[:, 0] == low[left]) & (rows[:, 1] == high[left])
            out[left[hit]] = rows[hit, 2]
            self.again[slot[left[hit]]] = True
            left = left[~hit & (rows[:, 0] != 0)]
        return out

    def _put(self, rows: np.ndarray) -> None:
        """Add rows of parts that aren't there."""
        slot = self._slot(rows[:, 0], rows[:, 1])
        left = np.arange(len(rows))
        while len(left):
            free = left[self.table[slot[left], 0] == 0]
            self.table[slot[free]] = rows[free]  # of parts that meet in a slot one stays
            now = self.table[slot[left]]
            left = left[(now[:, 0] != rows[left, 0]) | (now[:, 1] != rows[left, 1])]
            slot[left] = (slot[left] + 1) & ((1 << SLOT_BITS) - 1)
        self.held += len(rows)

    def _thin(self) -> None:
        """Keep the parts that were met again since the last time; none if they are over half of all."""
        rows = self.table[self.again & (self.table[:, 0] != 0)]
        store = self.store
        self._clear()
        if len(rows) > 0.5 * FULL * (1 << SLOT_BITS):
            return
        sizes, places = (rows[:, 2] & np.uint64(255)).astype(np.int64), (rows[:, 2] >> np.uint64(8)).astype(np.int64)
        rows[:, 2] = self._keep(_gather(store, places, sizes), sizes)
        self._put(rows)

    def _keep(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Append the ids of some parts to the store; the third words of their rows."""
        while self.used + len(ids) > len(self.store):
            self.store = np.concatenate([self.store, np.zeros_like(self.store)])
        self.store[self.used : self.used + len(ids)] = ids
        place = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        return (place << 8 | sizes).astype(np.uint64)

    def _learn(self, low: np.ndarray, high: np.ndarray) -> None:
        new = np.unique(np.stack([low, high], axis=1).view("S16").ravel())
        if self.held + len(new) > FULL * (1 << SLOT_BITS):
            self._thin()
        for at in range(0, len(new), 8192):
            some = new[at : at + 8192]
            ids = [x.ids for x in self.tokenizer.encode_batch_fast([x.decode() for x in some.tolist()], add_special_tokens=False)]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            words = self._keep(np.fromiter(chain.from_iterable(ids), self.kind, sizes.sum()), sizes)
            self._put(np.column_stack([np.ascontiguousarray(some).view(np.uint64).reshape(-1, 2), words]))

    def _whole(self, part: bytes, keep: bool) -> np.ndarray:
        if (found := self.long.get(part)) is None:
            found = np.array(self.tokenizer.encode(part.decode(), add_special_tokens=False).ids, self.kind)
            if keep and len(part) <= LONG_PART:
                self.long_bytes += 256 + len(part)
                if self.long_bytes > LONG_BYTES:
                    self.long, self.long_bytes = {}, 0
                self.long[part] = found
        return found

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty) one after another, and where each begins (one more at the end)."""
        data, off = text_bytes(texts)
        if not len(data):
            return np.zeros(0, self.kind), np.zeros(len(off), np.int64)
        if self.table is None:
            self._clear()
        starts, odd = part_starts(data, off)
        sizes = np.diff(np.append(starts, len(data)))
        plain = sizes <= 16
        plain[np.searchsorted(starts, off[odd])] = False
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        word = np.ndarray(len(padded) - 7, np.uint64, padded, strides=(1,))  # the eight bytes from each place on
        out, counts = [], []
        for at in range(0, len(starts), AT_ONCE):
            begin, n, ok = (x[at : at + AT_ONCE] for x in (starts, sizes, plain))
            b, m = begin[ok], n[ok]
            low, high = word[b] & _KEEP[np.minimum(m, 8)], word[b + 8] & _KEEP[np.maximum(m - 8, 0)]
            found = self._find(low, high)
            missing = np.flatnonzero(found == 0)
            if len(missing):
                before = self.table
                self._learn(low[missing], high[missing])
                if self.table is before:
                    found[missing] = self._find(low[missing], high[missing])
                else:  # thinned: some of the others may have gone
                    found = self._find(low, high)
                    if (missing := np.flatnonzero(found == 0)).size:
                        self._learn(low[missing], high[missing])
                        found = self._find(low, high)
            count, place = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            count[ok], place[ok] = (found & np.uint64(255)).astype(np.int64), (found >> np.uint64(8)).astype(np.int64)
            used = self.used
            if len(others := np.flatnonzero(~ok)):  # for this time only, behind the store's end
                odd_starts = set(off[odd].tolist())
                ids = [self._whole(data[a : a + k].tobytes(), a not in odd_starts) for a, k in zip(begin[others].tolist(), n[others].tolist(), strict=True)]
                count[others] = [len(x) for x in ids]
                place[others] = (self._keep(np.concatenate(ids), count[others]) >> np.uint64(8)).astype(np.int64)
            out.append(_gather(self.store, place, count))
            self.used = used
            counts.append(count)
        ends = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        return np.concatenate(out), ends[np.searchsorted(starts, off)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as bytes of `kind`; None counts as empty."""
        flat, cuts = self.encode_all(pa.array(texts, pa.string()))
        return [flat[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def _gather(store: np.ndarray, places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """store[place : place + size] of all, one after another."""
    return store[np.repeat(places - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
