"""Token ids of whole texts, by way of a bounded table of chunks that each worker fills.

A chunk is a run of text whose ids don't depend on what stands around it. Chunks are found
and hashed for a whole slice of documents at once (``WordHasher``); only chunks that the
table doesn't know yet are encoded, all others cost one look-up for each distinct chunk.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from patchtrace.llm.common import WORD_TABLE_LIMIT, KeyTable, gather_runs, spans_of


class IdTable:
    """Ids of chunks by their 64-bit hash; starts anew when it holds too many."""

    def __init__(self, encode: Callable[[list[bytes]], list], dtype, limit: int = WORD_TABLE_LIMIT):
        self.encode, self.dtype = encode, dtype
        self.known = KeyTable(limit)
        self.fresh()

    def fresh(self):
        self.known.fresh()
        self.flat, self.used = np.zeros(1 << 16, self.dtype), 0
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def __call__(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, stops: np.ndarray):
        """The ids of all chunks, one after the other, and how many each chunk has."""
        if len(keys) == 0:
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        if self.known.full:
            self.fresh()
        row, new = self.known.rows(keys)
        if len(new):
            text = data.tobytes()
            ids = self.encode([text[a:b] for a, b in zip(starts[new].tolist(), stops[new].tolist(), strict=True)])
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            total = int(size.sum())
            while self.used + total > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), self.dtype)])
            self.flat[self.used:self.used + total] = np.fromiter((i for x in ids for i in x), self.dtype, total)
            self.starts = np.concatenate([self.starts, self.used + spans_of(size)[:-1]])
            self.lengths = np.concatenate([self.lengths, size.astype(np.int32)])
            self.used += total
        lengths = self.lengths[row].astype(np.int64)
        return gather_runs(self.flat, self.starts[row], lengths), lengths


def per_row(lengths: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of the chunk lengths of each row, given where each row's chunks begin."""
    total = spans_of(lengths)
    return total[ends[1:]] - total[ends[:-1]]
