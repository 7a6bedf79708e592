"""Line dedup: lines that stand in many documents stay in one of them only.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z lower-cased.
Keys of at least ``min_chars`` code points that ``min_docs`` documents hold lose all their lines
but those of the largest id.

Only hashes travel: each long line becomes (128-bit key hash, id, 128-bit row key, position).
These rows are range-partitioned by all of their columns and sorted by hash, then id
(descending), row and position, so a line that a third of all rows hold is cut into as many
partitions as it needs. Every partition is streamed in that order: the first id of a hash is
the one that keeps its lines, the others lose theirs as soon as enough ids have been seen. What a partition must
know of its neighbours (the run that reaches over its edges) is two small records for each
partition, which the driver strings together.

The result is a bitmap of kept lines for each document that loses any, compressed; text is
read again only where somebody wants the kept text (``kept_lines``).

Defined results: null text counts as empty, and an empty text is one empty line; a null id
counts as one id, smaller than all others; rows that share an id are one document when
documents are counted, and each of them loses the lines that the id loses; equal rows get
equal bitmaps. Two different keys are taken as one if both of their 64-bit hashes agree
(2**-128 a pair).
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from patchtrace.llm.common import pick, text_slices, write_stage

#: White space that is stripped from a line (fixed by the contract).
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS, MIN_DOCS = 40, 5


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _two_hashes(*columns: Column) -> list[Column]:
    """128 bits: the same 64-bit hash from two seeds."""
    return [F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)]


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, r1, r2): the row key is a hash of id and text, so it needs no numbering."""
    src = pick(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    r1, r2 = _two_hashes(F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("id").isNull(), F.col("text"))
    return src.select("id", "text", r1.alias("r1"), r2.alias("r2"))


def long_lines(src: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, id, r1, r2, pos) of every line whose key is long enough."""
    lines = src.select("id", "r1", "r2", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keys = lines.select("id", "r1", "r2", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    h1, h2 = _two_hashes(F.col("key"))
    return keys.select(h1.alias("h1"), h2.alias("h2"), "id", "r1", "r2", "pos")


def _differ(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Row by row, with null equal to null."""
    other = pc.fill_null(pc.not_equal(a, b), True)
    return pc.and_not(other, pc.and_(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


@dataclass
class Run:
    """Rows of one hash: the hash, the first and the last id, and how many ids there are."""

    hash: tuple[int, int]
    first: object
    last: object
    n_ids: int


class RunReader:
    """Cuts sorted batches into runs of one hash, going on with a run from batch to batch."""

    def __init__(self, before: Run | None = None):
        self.run = before

    def __call__(self, batch: pa.RecordBatch):
        """(run number of each row, ordinal of its id in the run, ids of each run so far). Run 0 is the
        one that the rows before ended with; it may have no row here."""
        h1, h2 = (batch.column(c).to_numpy() for c in ("h1", "h2"))
        ids = batch.column("id")
        new_run = np.ones(len(h1), bool)
        new_run[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new_id = new_run.copy()
        new_id[1:] |= _differ(ids.slice(1), ids.slice(0, len(ids) - 1))
        seen = 0
        if self.run is not None and self.run.hash == (int(h1[0]), int(h2[0])):
            new_run[0] = False
            new_id[0] = ids[0].as_py() != self.run.last
            seen = self.run.n_ids
        run, step = np.cumsum(new_run), np.cumsum(new_id)
        starts = np.flatnonzero(new_run)
        ends = np.flatnonzero(np.append(new_run[1:], True))
        base = np.full(int(run[-1]) + 1, -seen, np.int64)
        base[run[starts]] = step[starts] - 1
        ordinal = step - 1 - base[run]
        total = np.full(int(run[-1]) + 1, seen, np.int64)
        total[run[ends]] = ordinal[ends] + 1
        if run[-1] > 0 or self.run is None:
            self.run = Run((int(h1[-1]), int(h2[-1])), ids[int(starts[-1])].as_py(), None, 0)
        self.run = Run(self.run.hash, self.run.first, ids[-1].as_py(), int(total[-1]))
        return run, ordinal, total


def _edges(kind: pa.DataType):
    """One row for a partition: its first run and its last run (``one``: they are the same)."""
    def run(batches):
        reader, first, part = RunReader(), None, None
        for b in batches:
            if b.num_rows == 0:
                continue
            run_no, _, total = reader(b)
            part = b.column("part")[0].as_py()
            if first is None or first[1]:  # the first run goes on, or begins here
                k = run_no[0]
                start, stop = np.searchsorted(run_no, [k, k + 1])
                if first is None or k == 0:
                    begin = b.column("id")[int(start)].as_py() if first is None else first[0].first
                    h = b.column("h1")[int(start)].as_py(), b.column("h2")[int(start)].as_py()
                    first = Run(h, begin, b.column("id")[int(stop) - 1].as_py(), int(total[k])), run_no[-1] == k
                else:
                    first = first[0], False
        if first is not None:
            a, z = first[0], reader.run
            ids = [pa.array([x], kind) for x in (a.first, a.last, z.first, z.last)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([bool(first[1])]),
                 *[pa.array([x], pa.int64()) for x in (*a.hash, a.n_ids, *z.hash, z.n_ids)], *ids],
                names=["part", "one", "a1", "a2", "a_ids", "z1", "z2", "z_ids", "a_first", "a_last", "z_first", "z_last"])
    return run


def stitch(edges: list) -> dict[int, tuple[Run | None, tuple | None]]:
    """For each partition: the run that reaches into it, and (hash, ids of the whole run) of the run
    that reaches out of it. ``edges`` are the rows of ``_edges`` in partition order."""
    into, carried, until_end = {}, {}, {}
    before = None
    for e in edges:
        held = before if before is not None and before.hash == (e.a1, e.a2) else None
        into[e.part] = held
        carried[e.part] = held.n_ids - (held.last == e.a_first) if held is not None else 0
        until_end[e.part] = e.z_ids + (carried[e.part] if e.one else 0)
        before = Run((e.z1, e.z2), None, e.z_last, until_end[e.part])
    out, after = {}, None
    for e in reversed(edges):
        goes_on = after is not None and after[0] == (e.z1, e.z2)
        whole = after[1] if goes_on else until_end[e.part]
        out[e.part] = into[e.part], after if goes_on else None
        after = (e.a1, e.a2), whole if e.one else e.a_ids + carried[e.part]
    return out


def _stream_drops(joints, min_docs: int):
    """Rows of the lines that go, while a sorted partition is read once."""
    names = ["id", "r1", "r2", "pos"]

    def run(batches):
        reader, reach, waiting = None, None, []
        for b in batches:
            if b.num_rows == 0:
                continue
            if reader is None:
                held, reach = joints.value.get(b.column("part")[0].as_py(), (None, None))
                reader = RunReader(held)
            run_no, ordinal, total = reader(b)
            if reach is not None and reader.run.hash == reach[0]:
                total[-1] = reach[1]
            if waiting and total[0] >= min_docs:
                yield from waiting
            if waiting and (total[0] >= min_docs or run_no[-1] > 0):
                waiting = []
            later = ordinal > 0
            gone = later & (total[run_no] >= min_docs)
            if gone.any():
                yield b.filter(pa.array(gone)).select(names)
            if total[-1] < min_docs:
                rest = later & (run_no == run_no[-1])
                if rest.any():  # the lines of fewer than min_docs ids
                    waiting.append(b.filter(pa.array(rest)).select(names))

    return run


def pack_bits(positions: np.ndarray) -> bytes:
    """Bitmap of kept lines (1: kept) up to the last dropped one, compressed; later lines are kept."""
    keep = np.ones(int(positions.max()) + 1, np.uint8)
    keep[positions] = 0
    return zlib.compress(np.packbits(keep).tobytes())


def unpack_bits(packed: bytes, n_lines: int) -> np.ndarray:
    """The bitmap as one boolean a line."""
    bits = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8))[:n_lines].astype(bool)
    keep = np.ones(n_lines, bool)
    # the last byte is padded with zeros; the last real bit is the last 0 of a dropped line
    keep[:len(bits)] = bits
    return keep


def keep_bitmaps(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                 min_docs: int = MIN_DOCS) -> DataFrame:
    """(r1, r2, n_last, keep) of each document that loses lines: its row key, the number of lines
    that the bitmap covers, and the bitmap. Documents that lose nothing have no row."""
    src = _source(docs, id_col, text_col)
    spark = docs.sparkSession
    lines = long_lines(src, min_chars)
    order = [F.col("h1"), F.col("h2"), F.col("id").desc_nulls_last(), F.col("r1"), F.col("r2"), F.col("pos")]
    ranged = write_stage(lines.repartitionByRange(*order).sortWithinPartitions(*order)
                         .withColumn("part", F.spark_partition_id()))
    kind = src.schema["id"].dataType.simpleString()
    edge = (f"part int, one boolean, a1 long, a2 long, a_ids long, z1 long, z2 long, z_ids long, "
            f"a_first {kind}, a_last {kind}, z_first {kind}, z_last {kind}")
    arrow = to_arrow_type(src.schema["id"].dataType)
    edges = ranged.mapInArrow(_edges(arrow), edge).collect()  # one row a partition
    joints = spark.sparkContext.broadcast(stitch(sorted(edges, key=lambda e: e.part)))
    drops = ranged.mapInArrow(_stream_drops(joints, min_docs), f"id {kind}, r1 long, r2 long, pos int")

    def pack(batches):
        for b in batches:
            pos = [np.asarray(p, np.int64) for p in b.column("pos").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("r1"), b.column("r2"), pa.array([int(p.max()) + 1 for p in pos], pa.int64()),
                 pa.array([pack_bits(p) for p in pos], pa.binary())], names=["r1", "r2", "n_last", "keep"])

    # a set: rows repeated with id and text share one bitmap
    return (drops.groupBy("r1", "r2").agg(F.collect_set("pos").alias("pos"))
            .mapInArrow(pack, "r1 long, r2 long, n_last long, keep binary"))


def kept_lines(docs: DataFrame, bitmaps: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
               with_text: bool = True) -> DataFrame:
    """id_col, n_lines, n_dropped, kept_sha256 and, on demand, the kept ``text``, for every row of ``docs``."""
    src = _source(docs, id_col, text_col).join(bitmaps, ["r1", "r2"], "left").select("id", "text", "n_last", "keep")
    kind = src.schema["id"].dataType.simpleString()

    def run(batches):
        for b in text_slices(batches):
            n_lines, n_gone, digest, kept = [], [], [], []
            for t, n_last, packed in zip(b.column("text").to_pylist(), b.column("n_last").to_pylist(),
                                         b.column("keep").to_pylist(), strict=True):
                data = t.encode("utf-8")
                n_lines.append(data.count(b"\n") + 1)
                if packed is None:
                    n_gone.append(0)
                else:
                    lines = data.split(b"\n")
                    keep = np.ones(len(lines), bool)
                    keep[:n_last] = unpack_bits(packed, n_last)
                    n_gone.append(int((~keep).sum()))
                    data = b"\n".join(lines[i] for i in np.flatnonzero(keep))
                digest.append(hashlib.sha256(data).hexdigest())
                if with_text:
                    kept.append(data.decode("utf-8"))
            columns = {"id": b.column("id"), "n_lines": pa.array(n_lines, pa.int64()),
                       "n_dropped": pa.array(n_gone, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
            if with_text:
                columns["text"] = pa.array(kept, pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    out = f"id {kind}, n_lines long, n_dropped long, kept_sha256 string" + (", text string" if with_text else "")
    return src.mapInArrow(run, out).withColumnRenamed("id", id_col)
