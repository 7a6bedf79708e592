"""Helpers shared by the operators of this subpackage.

Every operator reads its input columns by exact name and position (``pick``), so extra
columns, also ones whose names clash with result columns or differ only in case, never
disturb it. Text leaves the JVM in Arrow batches, and ``text_slices`` cuts each batch into
runs of bounded bytes, so a task's memory follows its longest single text and never the
number of rows.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task expands into words at a time.
SLICE_BYTES = 1 << 20
#: Distinct words that a worker's table may hold before it starts anew.
WORD_TABLE_LIMIT = 1_000_000
#: Rows of an Arrow batch; whole documents are wide.
BATCH_ROWS = 500
#: Bits of a row filter (2 MB), the proven bound of what is sent to every executor.
FILTER_BITS = 1 << 24


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's rows per Arrow batch, which bounds what a task holds off the heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Select ``new_name=old_name`` columns by exact spelling, whatever else ``df`` has."""
    names = df.columns
    at = {new: names.index(old) for new, old in columns.items()}
    plain = df.toDF(*[f"_in{i}" for i in range(len(names))])
    return plain.select(*[F.col(f"_in{i}").alias(new) for new, i in at.items()])


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text",
                limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each slice holds at most ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size.astype(np.int64))
        start = 0
        while start < n:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def strings(column: pa.Array) -> list[str]:
    """A text column as strings, null as the empty text."""
    return [t or "" for t in column.to_pylist()]


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker (functions are shipped by value,
    so their own module globals last for one task only)."""
    name = "_patchtrace_llm_worker"
    module = sys.modules.get(name)
    if module is None:
        module = sys.modules[name] = types.ModuleType(name)
        module.cache = {}
    return module.cache


class KeyTable:
    """Numbers 64-bit keys in the order in which they are first met; 12 bytes a key."""

    def __init__(self, limit: int = WORD_TABLE_LIMIT):
        self.limit = limit
        self.fresh()

    def fresh(self):
        self.keys, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    @property
    def full(self) -> bool:
        return len(self.keys) > self.limit

    def rows(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each key, and where in ``keys`` each new one stands first (in number order)."""
        codes, distinct = pd.factorize(keys)
        spot = np.searchsorted(self.keys, distinct)
        row = np.full(len(distinct), -1, np.int64)
        inside = spot < len(self.keys)
        hit = np.flatnonzero(inside)[self.keys[spot[inside]] == distinct[inside]]
        row[hit] = self.row[spot[hit]]
        new = np.flatnonzero(row < 0)
        row[new] = len(self.keys) + np.arange(len(new))
        first = np.empty(len(distinct), np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        order = new[np.argsort(distinct[new])]
        self.row = np.insert(self.row, spot[order], row[order].astype(np.int32))
        self.keys = np.insert(self.keys, spot[order], distinct[order])
        return row[codes], first[new]


def spans_of(lengths: np.ndarray) -> np.ndarray:
    """0 and the running sum of ``lengths``."""
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def gather_runs(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenate ``flat[s:s+l]`` for each start and length."""
    total = int(lengths.sum())
    if total == 0:
        return flat[:0]
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return flat[shift + np.arange(total)]


def binary_array(data: bytes | np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A large binary column from one buffer and the length of each value."""
    return pa.Array.from_buffers(pa.large_binary(), len(lengths),
                                 [None, pa.py_buffer(spans_of(lengths)), pa.py_buffer(data)])


def row_filter(df: DataFrame, number: Column, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit array of fixed size that marks ``number`` modulo ``bits``, for every row.

    A set bit means "possibly there": it thins out rows before an exact join and decides
    nothing. At most ``bits / 64`` rows reach the driver, whatever the size of ``df``.
    """
    rows = (df.select(F.pmod(number, F.lit(bits).cast("long")).alias("b"))
            .groupBy(F.expr("b div 64").alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, int(b % 64))")).alias("v")).toArrow())
    out = np.zeros(bits // 64, np.int64)
    out[rows["word"].to_numpy()] = rows["v"].to_numpy()
    return out


def fold(column: Column, modulus: int) -> Column:
    """The contracts' split of documents: crc32 of the id's text, modulo a number."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(modulus))


def row_key(id_: Column, text: Column) -> Column:
    """A row's 128-bit name, made of its id and text: the same whenever and in whatever order it is read."""
    own = F.coalesce(id_.cast("string"), F.lit("")), id_.isNull(), F.coalesce(text, F.lit("")), text.isNull()
    return F.concat(F.hex(F.xxhash64(*own)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), *own)))


def drop_listed(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``rows`` without those whose ``key`` is listed in ``gone`` (few, as a rule).

    The list marks a bit filter of fixed size: rows that it doesn't mark stay where they are,
    only the others are shuffled for the exact anti-join.
    """
    stay, doubt = _spotted(rows, gone, key)
    return stay.unionByName(doubt.join(gone, key, "left_anti"))


def only_listed(rows: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """The ``rows`` whose ``key`` is listed (few, as a rule), by the same bit filter: others aren't shuffled."""
    return _spotted(rows, listed, key)[1].join(listed, key, "left_semi")


def _spotted(rows: DataFrame, listed: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows that a bit filter of the list doesn't mark, and those that it does."""
    marked = rows.sparkSession.sparkContext.broadcast(row_filter(listed, F.xxhash64(key)))
    spotted = rows.withColumn("_spot", F.pmod(F.xxhash64(key), F.lit(FILTER_BITS).cast("long")))

    def part(hit: bool):
        def run(batches):
            bits = marked.value
            for b in batches:
                spot = b.column("_spot").to_numpy()
                yield b.filter(pa.array((bits[spot >> 6] >> (spot & 63) & 1 == 1) == hit))
        return run

    return tuple(spotted.mapInArrow(part(hit), spotted.schema).drop("_spot") for hit in (False, True))


def write_stage(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder of ``spark.checkpoint.dir``."""
    return df.checkpoint()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the public splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _mod64_powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


class WordHasher:
    """Hashes the words ``[^\\x20\\x09-\\x0D]+`` of a text column without making Python strings.

    A word's hash is a polynomial over 64-bit values of its bytes, read off one running sum
    over the block (the difference of two sums, shifted back to position 0), then mixed with
    the length. ``lower`` gives A-Z the values of a-z; ``split_tail`` makes a comma or full stop
    behind a final ASCII letter a word of its own. Blocks are cut at white space, so a long
    text takes no more memory than a block or its longest word.
    """

    BASE = 0x9E3779B97F4A7C15
    BLOCK = 1 << 20

    def __init__(self, lower: bool = False, split_tail: bool = False):
        self.split_tail = split_tail
        self.values = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        if lower:
            self.values[65:91] = self.values[97:123]
        self.blank = np.zeros(256, bool)
        self.blank[[9, 10, 11, 12, 13, 32]] = True
        self.up = self.down = np.zeros(0, np.uint64)

    def _block(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        if len(data) > len(self.up):
            size = max(len(data), self.BLOCK)
            self.up = _mod64_powers(self.BASE, size)
            self.down = _mod64_powers(pow(self.BASE, -1, 1 << 64), size)
        run = self.values[data]
        run *= self.up[:len(data)]
        np.cumsum(run, out=run)
        h = run[stops - 1]
        h[starts > 0] -= run[starts[starts > 0] - 1]
        return mix64(h * self.down[starts] + (stops - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, first byte, byte after the last) of each word, and where each row's words begin;
        ``data`` then holds the bytes that these refer to."""
        column = pc.fill_null(column, "").cast(pa.large_string())
        at = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
        self.data = np.zeros(0, np.uint8)
        if len(column) == 0 or at[-1] == at[0]:
            none = np.zeros(0, np.int64)
            return np.zeros(0, np.uint64), none, none, np.zeros(len(column) + 1, np.int64)
        self.data = data = np.frombuffer(column.buffers()[2], np.uint8)[at[0]:at[-1]]
        at = at - at[0]
        blank = self.blank[data]
        edge = np.zeros(len(data) + 1, bool)  # a row begins here
        edge[at] = True
        begin = ~blank
        begin[1:] &= blank[:-1] | edge[1:-1]
        end = ~blank
        end[:-1] &= blank[1:] | edge[1:-1]
        starts, stops = np.flatnonzero(begin), np.flatnonzero(end) + 1
        if self.split_tail:
            before = data[np.maximum(stops - 2, 0)] | 32
            tail = np.isin(data[stops - 1], (44, 46)) & (stops - starts > 1) & (before >= 97) & (before <= 122)
            cut = stops[tail]
            stops = stops - tail
            starts = np.concatenate([starts, cut - 1])
            order = np.argsort(starts, kind="stable")
            starts, stops = starts[order], np.concatenate([stops, cut])[order]
        hashes, done = [], 0
        while done < len(starts):
            origin = starts[done]
            stop = max(done + 1, int(np.searchsorted(stops, origin + self.BLOCK, "right")))
            part = slice(origin, stops[stop - 1])
            hashes.append(self._block(data[part], starts[done:stop] - origin, stops[done:stop] - origin))
            done = stop
        words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        return words, starts, stops, np.searchsorted(starts, at)
