"""Vectorised hashing of words and characters, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text handled at once; all working arrays are a small multiple of this.
CHUNK_BYTES = 1 << 20
SPACES = " \t\n\v\f\r"
#: Bytes of a piece of a word, and of the longest word that is only taken as a whole.
PIECE_BYTES, LONG_WORD = 6, 32
_MULTIPLIER = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit numbers, another one for each seed."""
    x = x + np.uint64((seed * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_codes() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64), 7)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class WordHasher:
    """64-bit hashes of the words of texts: runs without space, tab or line break, lower case."""

    def __init__(self) -> None:
        self.codes = _byte_codes()
        self.up, self.down = _powers(_MULTIPLIER, 1 << 16), _powers(_INVERSE, 1 << 16)

    def _grow(self, n: int) -> None:
        if n > len(self.up):
            size = 1 << (n - 1).bit_length()
            self.up, self.down = _powers(_MULTIPLIER, size), _powers(_INVERSE, size)

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, start byte and end byte of every word of ``data``."""
        raw = np.frombuffer(data, dtype=np.uint8)
        solid = np.empty(len(raw) + 2, dtype=bool)
        solid[0] = solid[-1] = False
        solid[1:-1] = (raw != 32) & ((raw < 9) | (raw > 13))
        edges = np.flatnonzero(solid[1:] != solid[:-1])
        starts, ends = edges[::2], edges[1::2]
        return self.spans(data, starts, ends), starts, ends

    def spans(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of the bytes between each start and end."""
        raw = np.frombuffer(data, dtype=np.uint8)
        self._grow(len(raw) + 1)
        total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(self.codes[raw] * self.up[: len(raw)], out=total[1:])
        return mix((total[ends] - total[starts]) * self.down[starts])

    def batches(self, texts: list[str], parts_too: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Hashes for runs of texts: (first text, last + 1, word hashes, end offset of each text).

        ``parts_too`` adds the hashes of ``pieces`` to those of the words.
        """
        at = 0
        while at < len(texts):
            parts, size, to = [], 0, at
            while to < len(texts) and (to == at or size + len(texts[to]) < CHUNK_BYTES // 2):
                parts.append(texts[to])
                size += len(texts[to])
                to += 1
            if to == at + 1 and size > 4 * CHUNK_BYTES:
                hashes = np.concatenate([self._features(p.lower().encode(), parts_too)[0] for p in slices(parts[0])])
                yield at, to, hashes, np.array([len(hashes)])
            else:
                data = [p.lower().encode() for p in parts]
                hashes, starts = self._features(b"\n".join(data), parts_too)
                lengths = np.array([len(d) + 1 for d in data])
                yield at, to, hashes, np.searchsorted(starts, np.cumsum(lengths))
            at = to

    def _features(self, data: bytes, parts_too: bool) -> tuple[np.ndarray, np.ndarray]:
        """Hash and start byte of every word, and of every piece if wanted, by start byte."""
        hashes, starts, ends = self.words(data)
        if parts_too:
            where, codes = pieces(data, starts, ends)
            if len(where):
                starts = np.concatenate([starts, where])
                order = np.argsort(starts, kind="stable")
                hashes, starts = np.concatenate([hashes, codes])[order], starts[order]
        return hashes, starts


def pieces(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start byte and hash of the pieces of words: six bytes from each character on, inside the word.

    Words of more than ``LONG_WORD`` bytes have them throughout, others from characters of three
    bytes or more on, as in scripts without spaces: two of these, or three Greek or Cyrillic ones.
    """
    lengths = ends - starts
    chosen = lengths > LONG_WORD
    raw = np.frombuffer(data + bytes(8), dtype=np.uint8)
    if not data.isascii():
        wide = np.zeros(len(raw) + 1, dtype=np.int32)
        np.cumsum(raw >= 0xE0, out=wide[1:])
        chosen |= (wide[ends] > wide[starts]) & (lengths >= PIECE_BYTES)
    some = np.flatnonzero(chosen)
    counts = lengths[some] - PIECE_BYTES + 1
    upto = np.cumsum(counts)
    total = int(upto[-1]) if len(upto) else 0
    where = np.repeat(starts[some] - (upto - counts), counts) + np.arange(total)
    first = raw[where]
    where = where[(first >= 0xE0) | np.repeat(lengths[some] > LONG_WORD, counts) & ((first & 0xC0) != 0x80)]
    eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, 8)[where]).view("<u8").ravel()
    return where, mix(eight & np.uint64((1 << 8 * PIECE_BYTES) - 1), 11)


def slices(text: str) -> Iterator[str]:
    """A very long text in parts, cut behind white space (or nowhere, inside a giant word)."""
    at = 0
    while at < len(text):
        to = min(len(text), at + CHUNK_BYTES)
        while to < len(text) and text[to - 1] not in SPACES:
            to += 1
        yield text[at:to]
        at = to


def segments(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of consecutive runs that end at ``ends``."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    return starts, ends - starts


def word_grams(hashes: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``n`` consecutive words inside each text, with the new end offsets.

    A text of 1 to ``n`` - 1 words gives one gram of all its words; one without words none.
    """
    starts, lengths = segments(ends)
    grams = np.maximum(lengths - n + 1, np.minimum(lengths, 1))
    out_ends = np.cumsum(grams)
    total = int(out_ends[-1]) if len(out_ends) else 0
    first = np.repeat(starts - (out_ends - grams), grams) + np.arange(total)
    limit = np.repeat(ends, grams)
    value = np.zeros(total, dtype=np.uint64)
    for k in range(n):
        inside = first + k < limit
        word = np.where(inside, hashes[np.minimum(first + k, len(hashes) - 1)] if len(hashes) else 0, np.uint64(0))
        value = mix(value * np.uint64(_MULTIPLIER) + word, k + 1)
    return value, out_ends
