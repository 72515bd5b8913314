"""Words, pieces and hashes of a batch of texts, by numpy over its UTF-8 bytes.

A batch is one byte array and the offsets of its texts, as Arrow holds them.
Hashes are polynomial sums modulo 2^64 with random 64-bit values for bytes, so
that the hash of any slice follows from two running sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes worked on at once; one longer text is worked on alone.
STEP_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII capitals to small letters.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_POINT = np.zeros(256, bool)
_POINT[list(b".,!?;:")] = True
# A byte after which a blank surely ends a word: printable ASCII, or the second
# byte of a two-byte letter (lead bytes C3 to DF; C2 also leads odd spaces).
_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True
_LEAD = np.zeros(256, bool)
_LEAD[0xC3:0xE0] = True


def steps(texts: pa.Array, most: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts: first, last + 1, their bytes and their offsets (from 0)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each text's first word."""
    solid = ~SPACE[data]
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    some = offsets[1:] > offsets[:-1]
    firsts, lasts = offsets[:-1][some], offsets[1:][some] - 1
    begin[firsts], end[lasts] = solid[firsts], solid[lasts]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def pieces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of pieces that a tokenizer treats independently; pieces fill the texts.

    A piece begins at a text's start, at an ASCII blank after a character that
    is surely none, and at a point after an ASCII letter.  The split patterns of
    the tokenizers match across none of these places.
    """
    cut = np.zeros(len(data), bool)
    if len(data):
        sure = _PLAIN[data]
        sure[1:] |= (data[1:] >= 0x80) & _LEAD[data[:-1]]
        cut[1:] = (SPACE[data[1:]] & sure[:-1]) | (_POINT[data[1:]] & _LETTER[data[:-1]])
        cut[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    return np.flatnonzero(cut)


class Hashes:
    """Hashes of slices of a sequence of 64-bit values."""

    def __init__(self, seed: int):
        made = np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, 260, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.of_byte, self.base, self.mixer, self.scale = made[:256], made[256], made[257], made[258]
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, STEP_BYTES + 1)
            self.up, self.down = np.full(n, self.base), np.full(n, self.inverse)
            self.up[0] = self.down[0] = 1
            np.multiply.accumulate(self.up, out=self.up)
            np.multiply.accumulate(self.down, out=self.down)

    def slices(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of ``values[start:end]`` for each pair, mixed with its length."""
        self._grow(len(values))
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.down[np.minimum(starts, len(self.down) - 1)] + (ends - starts).astype(np.uint64) * self.scale
        h ^= h >> np.uint64(32)
        h *= self.mixer
        return h ^ (h >> np.uint64(29))

    def texts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.slices(self.of_byte[data], starts, ends)


def ragged(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices begin[0], begin[0] + 1, ... of every run, one run after the other."""
    ahead = np.cumsum(length) - length
    return np.repeat(begin - ahead, length) + np.arange(int(length.sum()))
