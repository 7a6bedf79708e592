"""Windows of subword ids (E1) and encoders that take ids.

The built-in tokens (``embed.tokens``) are words of code. A pretrained encoder has a tokenizer of its own,
and its windows are cut in that tokenizer's ids: at most 512, stride 256, special ids
counted. The tokenizer is a plug-in point:

    make_tokenizer() -> encode
    encode(texts: list[str]) -> (ids: int32 array, lengths: int array)

``make_tokenizer`` runs once in each task; ``encode`` gives the ids of a slice of texts end to end and how
many each text has. Windows are cut from that flat array by their offsets, all rows of a
slice at once, and leave Python as one Arrow list column: no Python object for any token or window.

Defined results: a null text counts as empty; a text with fewer than two ids (special ones
included) has no window; rows with equal keys each have their own windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from patchtrace.operators.embed import MIN_WINDOW, STRIDE, WINDOW

Encode = Callable[[list], tuple[np.ndarray, np.ndarray]]
#: Bytes of text that are tokenized at a time (one row at least).
SLICE_BYTES = 1 << 20


def file_tokenizer(path: str, bos: int | None = None, eos: int | None = None) -> Callable[[], Encode]:
    """A ``tokenizers`` file as a tokenizer, with special ids at the ends of each text.

    ``path`` must name the file on every executor. Special strings within a text are ordinary text."""
    def make() -> Encode:
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.no_truncation()
        own.no_padding()
        own.encode_special_tokens = True
        before = [] if bos is None else [bos]
        after = [] if eos is None else [eos]

        def encode(texts):
            rows = [np.array(before + e.ids + after, np.int32) for e in own.encode_batch_fast(texts, add_special_tokens=False)]
            return np.concatenate(rows) if rows else np.zeros(0, np.int32), np.array([len(r) for r in rows], np.int64)

        return encode
    return make


def rank_tokenizer(path: str, pattern: str, bos: int | None = None, eos: int | None = None) -> Callable[[], Encode]:
    """A byte-level BPE given as ranks (a ``.tiktoken`` file) with its split ``pattern``; the ids stay in
    numpy arrays, so it is the faster one. ``path`` must name the file on every executor."""
    def make() -> Encode:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        before = np.array([] if bos is None else [bos], np.int32)
        after = np.array([] if eos is None else [eos], np.int32)

        def encode(texts):
            rows = [x for t in texts for x in (before, own.encode_to_numpy(t, disallowed_special=()).astype(np.int32), after)]
            sizes = np.array([len(r) for r in rows], np.int64).reshape(-1, 3).sum(1)
            return np.concatenate(rows) if rows else np.zeros(0, np.int32), sizes

        return encode
    return make


def window_offsets(lengths: np.ndarray, window: int = WINDOW, stride: int = STRIDE,
                   least: int = MIN_WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, number, start, end) of every window of sequences of these lengths, in order."""
    n = np.where(lengths < least, 0, np.where(lengths <= window, 1, -((window - lengths) // stride) + 1))
    row = np.repeat(np.arange(len(lengths)), n)
    number = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = number * stride
    return row, number, start, np.minimum(start + window, lengths[row])


def _slices(batches) -> Iterator:
    """Cut batches into runs of rows with at most ``SLICE_BYTES`` of text, one row at least."""
    import pyarrow.compute as pc

    for rb in batches:
        size = pc.fill_null(pc.binary_length(rb.column("_text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(size), 0
        while at < rb.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
            yield rb.slice(at, stop - at)
            at = stop


def subword_windows(items: DataFrame, key: list[str], make_tokenizer: Callable[[], Encode], text: str = "text",
                    window: int = WINDOW, stride: int = STRIDE) -> DataFrame:
    """Key..., win_no, start, end (offsets in ids, end exclusive), ids array<int>; map-only."""
    if not 0 < stride <= window:
        raise ValueError("the stride must be over 0 and at most the window")
    own = items.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.coalesce(F.col(text), F.lit("")).alias("_text"))
    keys = own.columns[:-1]

    def run(batches):
        import pyarrow as pa
        encode = make_tokenizer()
        for rb in _slices(batches):
            flat, lengths = encode(rb.column("_text").to_pylist())
            base = np.cumsum(lengths) - lengths
            row, number, start, end = window_offsets(np.asarray(lengths, np.int64), window, stride)
            for lo in range(0, len(row), 1 << 12):                             # a long text has many windows
                r, s, e = (x[lo:lo + (1 << 12)] for x in (row, start, end))
                size = e - s
                edges = np.concatenate([[0], np.cumsum(size)])
                at = np.repeat(base[r] + s - edges[:-1], size) + np.arange(edges[-1])
                ids = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(flat[at], pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [*[rb.column(k).take(pa.array(r)) for k in keys], pa.array(number[lo:lo + (1 << 12)], pa.int32()),
                     pa.array(s, pa.int32()), pa.array(e, pa.int32()), ids], names=[*keys, "win_no", "start", "end", "ids"])

    schema = StructType([own.schema[k] for k in keys]
                        + [StructField(c, IntegerType()) for c in ("win_no", "start", "end")]
                        + [StructField("ids", ArrayType(IntegerType()))])
    return own.mapInArrow(run, schema).toDF(*key, "win_no", "start", "end", "ids")


def id_encoder(make_encode: Callable[[], Callable], batch_size: int = 64) -> Callable[[DataFrame], DataFrame]:
    """E2 with a model that takes ids: ``make_encode()`` runs once in each Python worker and returns
    ``encode(ids: list of int32 arrays) -> numpy (n, dim)``. Windows get ``embedding`` in the model's own dimension."""
    def vectors(ids: Iterator) -> Iterator:
        import pandas as pd

        encode = make_encode()
        for batch in ids:
            rows = [np.asarray(x, np.int32) for x in batch]
            done = [encode(rows[i:i + batch_size]) for i in range(0, len(rows), batch_size)]
            yield pd.Series([v for part in done for v in np.asarray(part, np.float64)], dtype=object)

    import pandas as pd

    vectors.__annotations__ = {"ids": Iterator[pd.Series], "return": Iterator[pd.Series]}
    udf = F.pandas_udf(vectors, ArrayType(DoubleType()))

    def encode(windows: DataFrame) -> DataFrame:
        return windows.withColumn("embedding", udf("ids"))

    return encode


def ids_digest(ids: str = "ids") -> Column:
    """md5 of the ids in decimal, joined by blanks."""
    return F.md5(F.array_join(F.transform(F.col(ids), lambda x: x.cast("string")), " "))


def subword_encoder(make_tokenizer: Callable[[], Encode], encode: Callable[[DataFrame], DataFrame],
                    text: str = "text") -> Callable[[DataFrame, list[str]], DataFrame]:
    """An item encoder ``(items, key) -> (key..., embedding)``: subword windows, their vectors, the mean."""
    from patchtrace.operators.embed import mean_pool

    def run(items: DataFrame, key: list[str]) -> DataFrame:
        return mean_pool(encode(subword_windows(items, key, make_tokenizer, text)), key)
    return run
