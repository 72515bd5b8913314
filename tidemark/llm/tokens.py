"""Token ids of batches of texts: distinct pieces are encoded once and put together."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa

from tidemark.llm.spans import LOWER, SPACE, Hashes, pieces, ragged, steps

#: Pieces kept per Python worker; then the memory starts anew.
KEPT_PIECES = 1_000_000


class Encoder:
    """Ids as the tokenizer gives them for whole texts, from a bounded memory of pieces.

    ``folded`` is for a vocabulary that makes letters small one by one and drops
    blanks: ASCII pieces that differ in these alone are then encoded once.  Others
    keep their capitals: added tokens match, and marks compose, before letters
    are made small.
    """

    def __init__(self, path: str, folded: bool = False):
        self.folded = folded
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        # a special token between two pieces keeps them apart in one call
        self.mark_id = max(added) if added else None
        self.mark = added[self.mark_id].content if added else None
        self.hashes = Hashes(4)
        self.forget()

    def forget(self) -> None:
        # keys in order, the place of each, and by place where its ids begin and end; no object per piece
        self.keys, self.places, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int32), 0
        self.begin, self.ids = np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        if self.mark is not None and not any(self.mark in t for t in texts):
            flat = np.array(self.tokenizer.encode_batch_fast([self.mark.join(texts)], add_special_tokens=False)[0].ids, np.uint32)
            marks = np.flatnonzero(flat == self.mark_id)
            if len(marks) == len(texts) - 1:
                return np.delete(flat, marks), np.diff(marks, prepend=-1, append=len(flat)) - 1
        each = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        return np.array([x for ids in each for x in ids], np.uint32), np.array([len(ids) for ids in each], np.int64)

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        known = self.count
        for at in range(0, len(texts), 1000):
            ids, length = self._encode(texts[at : at + 1000])
            used, now = int(self.begin[self.count]), self.count + len(length)
            while now >= len(self.begin):
                self.begin = np.resize(self.begin, 2 * len(self.begin))
            while used + len(ids) > len(self.ids):
                self.ids = np.resize(self.ids, 2 * len(self.ids))
            self.ids[used : used + len(ids)] = ids
            self.begin[self.count + 1 : now + 1] = used + np.cumsum(length)
            self.count = now
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys = np.insert(self.keys, at, keys[order])
        self.places = np.insert(self.places, at, (known + order).astype(np.int32))

    def step(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a step, and the offsets of each text's ids."""
        starts = pieces(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        ends = np.append(starts[1:], len(data))
        begins, body = starts, data
        if self.folded:
            solid = np.append(np.flatnonzero(~SPACE[data]), len(data))
            # a piece is followed by an ASCII blank, an ASCII point or nothing, so no mark composes with its end
            odd = data >= 0x80
            odd[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
            plain = ~np.logical_or.reduceat(odd, starts)
            begins = np.minimum(solid[np.searchsorted(solid, starts)], ends)
            body = np.where(np.repeat(plain, ends - starts), LOWER[data], data)
        codes, distinct = pd.factorize(self.hashes.texts(body, begins, ends))
        first = np.empty(len(distinct), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        if self.count + len(distinct) > KEPT_PIECES and self.count:
            self.forget()
        at = np.searchsorted(self.keys, distinct)
        new = np.ones(len(distinct), bool)
        if self.count:
            new = self.keys[np.minimum(at, self.count - 1)] != distinct
        if new.any():
            raw, some = body.tobytes(), first[new]
            self._learn(distinct[new], [raw[a:z].decode() for a, z in zip(begins[some].tolist(), ends[some].tolist(), strict=True)])
            at = np.searchsorted(self.keys, distinct)
        at = self.places[at][codes]
        length = self.begin[at + 1] - self.begin[at]
        ids = self.ids[ragged(self.begin[at], length)]
        ahead = np.append(0, np.cumsum(length))
        return ids, ahead[np.searchsorted(starts, offsets)]

    def documents(self, texts: pa.Array, end_id: int):
        """Ids of each text with the end id, in order."""
        for first, last, data, offsets in steps(texts):
            ids, at = self.step(data, offsets)
            for k in range(last - first):
                yield np.append(ids[at[k] : at[k + 1]], np.uint32(end_id))


@lru_cache(maxsize=2)
def encoder(path: str, folded: bool = False) -> Encoder:
    """One encoder per Python worker and vocabulary file."""
    return Encoder(path, folded)
