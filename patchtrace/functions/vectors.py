"""Vector helpers that run inside tasks on Arrow batches (numpy, no per-row Python)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def pooled_bucket_means(dim: int, window: int, stride: int, min_window: int = 2):
    """Pandas UDF: bucket ids of an item's tokens -> mean of its window vectors.

    The window count comes from the token count (0 below ``min_window``, 1 up to
    ``window``, else ceil((L - window) / stride) + 1). Token at position p lies in the
    windows w with stride*w <= p < stride*w + window and w < n; a whole Arrow batch is
    pooled with one ``np.bincount``. Items without a window get null.

    Marked non-deterministic only so that the optimizer neither pushes a filter on its
    result below a shuffle nor inlines it twice: it is evaluated exactly once per row.
    """

    @F.pandas_udf(ArrayType(DoubleType()))
    def pool(buckets: pd.Series) -> pd.Series:
        n = len(buckets)
        if n == 0:
            return pd.Series([], dtype=object)
        arrs = buckets.to_numpy()
        lens = np.fromiter((len(a) for a in arrs), dtype=np.int64, count=n)
        nw = np.where(lens < min_window, 0,
                      np.where(lens <= window, 1, -((window - lens) // stride) + 1)).astype(np.int64)
        total = int(lens.sum())
        flat = np.concatenate(arrs).astype(np.int64) if total else np.zeros(0, dtype=np.int64)
        row = np.repeat(np.arange(n, dtype=np.int64), lens)
        pos = np.arange(total, dtype=np.int64) - np.repeat(np.cumsum(lens) - lens, lens)
        nwr = np.repeat(nw, lens)
        hi = np.minimum(pos // stride, nwr - 1)
        lo = np.maximum(-((window - 1 - pos) // stride), 0)
        mult = np.where(nwr > 0, hi - lo + 1, 0).astype(np.float64)
        sums = np.bincount(row * dim + flat, weights=mult, minlength=n * dim).reshape(n, dim)
        out = sums / np.maximum(nw, 1)[:, None]
        res = pd.Series(list(out), dtype=object)
        res[nw <= 0] = None
        return res

    return pool.asNondeterministic()


def list_offsets(arr):
    """(lengths, flat values) of an Arrow list array, slice-aware; null lists are empty."""
    offs = arr.offsets.to_numpy()
    vals = arr.values.to_numpy(zero_copy_only=False)[offs[0]:offs[-1]] if len(arr) else np.zeros(0)
    return np.diff(offs).astype(np.int64), vals


#: Tokens and rows that a step of the pooling holds arrays for.
STEP_TOKENS, STEP_ROWS = 1 << 18, 4096


def bucket_count_batches(key: list[str], col: str, dim: int, out: str = "embedding"):
    """``mapInArrow`` function: (key..., bucket ids as bytes) -> (key..., their counts)."""
    import pyarrow as pa

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, STEP_ROWS):
                rb = whole.slice(at, STEP_ROWS)
                n, ids = rb.num_rows, rb.column(col).cast(pa.binary())
                ends = np.frombuffer(ids.buffers()[1], dtype=np.int32)[ids.offset:ids.offset + n + 1]
                flat = np.frombuffer(ids.buffers()[2] or b"", dtype=np.uint8)[ends[0]:ends[-1]]
                row = np.repeat(np.arange(n, dtype=np.int64), np.diff(ends))
                counts = np.bincount(row * dim + flat, minlength=n * dim).astype(np.float64)
                emb = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * dim, dim, dtype=np.int32)), pa.array(counts))
                yield pa.RecordBatch.from_arrays([rb.column(k) for k in key] + [emb], names=list(key) + [out])

    return run


def _steps(batches, col: str):
    """The batches in slices of at most STEP_ROWS rows and about STEP_TOKENS list entries (or one row)."""
    for rb in batches:
        ends = np.cumsum(list_offsets(rb.column(col))[0])
        at = 0
        while at < rb.num_rows:
            before = ends[at - 1] if at else 0
            n = int(np.searchsorted(ends, before + STEP_TOKENS, side="right")) - at
            n = max(1, min(n, STEP_ROWS))
            yield rb.slice(at, n)
            at += n


def pooled_bucket_batches(key: list[str], col: str, dim: int, window: int, stride: int,
                          min_window: int = 2, out: str = "embedding"):
    """``mapInArrow`` function: (key..., bucket ids) -> (key..., mean of window vectors).

    Same arithmetic as ``pooled_bucket_means``, but it reads the bucket ids as one flat
    Arrow buffer and writes the pooled vectors back as one list array built over the
    flat result matrix (no per-row Python objects either way). Rows without a window
    are dropped. A batch is pooled in steps, so that the arrays beside it are small whatever its texts' lengths.
    """
    import pyarrow as pa

    def run(batches):
        for rb in _steps(batches, col):
            n = rb.num_rows
            lens, flat = list_offsets(rb.column(col))
            flat = flat.astype(np.int64)
            nw = np.where(lens < min_window, 0,
                          np.where(lens <= window, 1, -((window - lens) // stride) + 1)).astype(np.int64)
            total = int(lens.sum())
            row = np.repeat(np.arange(n, dtype=np.int64), lens)
            pos = np.arange(total, dtype=np.int64) - np.repeat(np.cumsum(lens) - lens, lens)
            nwr = np.repeat(nw, lens)
            hi = np.minimum(pos // stride, nwr - 1)
            lo = np.maximum(-((window - 1 - pos) // stride), 0)
            mult = np.where(nwr > 0, hi - lo + 1, 0).astype(np.float64)
            sums = np.bincount(row * dim + flat, weights=mult, minlength=n * dim).reshape(n, dim)
            keep = np.nonzero(nw > 0)[0]
            if not len(keep):
                continue
            vecs = sums[keep] / nw[keep][:, None]
            offsets = pa.array(np.arange(0, (len(keep) + 1) * dim, dim, dtype=np.int32))
            emb = pa.ListArray.from_arrays(offsets, pa.array(vecs.ravel()))
            idx = pa.array(keep)
            cols = [rb.column(k).take(idx) for k in key] + [emb]
            yield pa.RecordBatch.from_arrays(cols, names=list(key) + [out])

    return run
