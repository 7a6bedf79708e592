"""Exact dedup: composable polynomial fingerprints, confirmed chunk by chunk.

The normalised text (its UTF-8 bytes without ``[\\x20\\x09-\\x0D]``) is cut into chunks. A
chunk's hash is a polynomial in its bytes modulo a prime; two neighbours combine by

    hash(a + b) = hash(a) * base ** len(b) + hash(b)

so all chunks of a slice of documents are hashed at once and in any order, and a text that
is stored as many rows is hashed by many tasks (``fingerprint_parts``). Two primes give 62
bits; the byte length belongs to the key.

Equal fingerprints only nominate. Every member of a group is compared with the group's
first row, chunk against chunk, in a join on (fingerprint, length, chunk number) whose
large side Spark may split, so a group with a third of all rows is spread out. Rows that
turn out different form a group of their own in the next round (as a rule there is none).

Rows are known by a 128-bit hash of id and text, never by a number given while reading: the input
may come in another order each time it is read (after a shuffle it does). Rows that repeat id
and text share a key; which of them stays is settled among themselves.

Defined results: null text counts as empty; empty texts are equal to each other; of equal
texts the one with the most code points stays, then the smallest id (of any type that can be
ordered; null ids come last), then, for repeated rows, an arbitrary one; every input row gets one result row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchtrace.llm.common import (FILTER_BITS, drop_listed, only_listed, pick, row_filter, row_key, spans_of, strings,
                                   text_slices, write_stage)

#: The white space that normalisation deletes (fixed by the contract).
BLANKS = b" \t\n\v\f\r"
#: (prime below 2**31, base) of the two polynomials.
MODULI = ((2147483647, 1103515245), (2147483629, 1664525233))
CHUNK = 1 << 16


def normalise(text: str) -> bytes:
    return text.encode("utf-8").translate(None, BLANKS)


def _powers(chunk: int, moduli) -> list[np.ndarray]:
    out = []
    for p, r in moduli:
        w = np.ones(chunk + 1, np.uint64)
        filled = 1
        while filled <= chunk:  # doubling: the next block is this one times base ** filled
            step = np.uint64(pow(r, filled, p))
            more = min(filled, chunk + 1 - filled)
            w[filled:filled + more] = w[:more] * step % np.uint64(p)
            filled += more
        out.append(w)
    return out


def combine(left: tuple[int, int], right: tuple[int, int], p: int, r: int) -> tuple[int, int]:
    """(hash, length) of a concatenation from those of its two parts."""
    return (left[0] * pow(r, right[1], p) + right[0]) % p, left[1] + right[1]


class Fingerprinter:
    def __init__(self, chunk: int = CHUNK, moduli=MODULI):
        self.chunk, self.moduli, self.powers = chunk, moduli, _powers(chunk, moduli)

    def chunk_hashes(self, data: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """Hash of each chunk of ``data``; no length is 0 or over the chunk size."""
        starts = spans_of(lengths)[:-1]
        power = np.repeat(starts + lengths - 1, lengths) - np.arange(len(data))
        value = data.astype(np.uint64) + np.uint64(1)
        return [np.add.reduceat(value * w[power], starts) % np.uint64(p)
                for (p, _), w in zip(self.moduli, self.powers, strict=True)]

    def texts(self, normal: list[bytes]) -> np.ndarray:
        """The fingerprint of each text: chunk hashes first, then combined by shifts."""
        sizes = np.array([len(b) for b in normal], np.int64)
        pieces = -(-sizes // self.chunk)
        ends = spans_of(pieces)
        out = np.zeros(len(normal), np.int64)
        if ends[-1] == 0:
            return out
        lengths = np.full(int(ends[-1]), self.chunk, np.int64)
        some = sizes > 0
        lengths[ends[1:][some] - 1] = sizes[some] - (pieces[some] - 1) * self.chunk
        hashes = self.chunk_hashes(np.frombuffer(b"".join(normal), np.uint8), lengths)
        both = []
        for (p, r), h in zip(self.moduli, hashes, strict=True):
            whole = np.zeros(len(normal), np.int64)
            one = pieces == 1
            whole[one] = h[ends[:-1][one]]
            for row in np.flatnonzero(pieces > 1):
                part = (0, 0)
                for k in range(ends[row], ends[row + 1]):
                    part = combine(part, (int(h[k]), int(lengths[k])), p, r)
                whole[row] = part[0]
            both.append(whole)
        return (both[0] << 31) | both[1]


def fingerprint_parts(parts: DataFrame, *, id_col: str = "doc_id", part_col: str = "part",
                      text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Fingerprints of texts stored as numbered parts: id_col, n_bytes, fp.

    Parts are hashed wherever they lie; a group gathers only five numbers for each part.
    """
    (p1, r1), (p2, r2) = MODULI

    def run(batches):
        own = Fingerprinter(chunk)
        for b in text_slices(batches):
            normal = [normalise(t) for t in strings(b.column("text"))]
            fp = own.texts(normal)
            n = [len(x) for x in normal]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("part"), pa.array(n, pa.int64()), pa.array(fp >> 31),
                 pa.array([pow(r1, k, p1) for k in n], pa.int64()), pa.array(fp & ((1 << 31) - 1)),
                 pa.array([pow(r2, k, p2) for k in n], pa.int64())],
                names=["id", "part", "n", "h1", "s1", "h2", "s2"])

    src = pick(parts, id=id_col, part=part_col, text=text_col).withColumn("part", F.col("part").cast("long"))
    kind = src.schema["id"].dataType.simpleString()
    hashed = src.mapInArrow(run, f"id {kind}, part long, n long, h1 long, s1 long, h2 long, s2 long")
    rows = hashed.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("part", "n", "h1", "s1", "h2", "s2")))
                                    .alias("all"))
    fold = f"""aggregate(all, named_struct('n', 0L, 'a', 0L, 'b', 0L), (s, x) -> named_struct(
        'n', s.n + x.n, 'a', (s.a * x.s1 + x.h1) % {p1}L, 'b', (s.b * x.s2 + x.h2) % {p2}L))"""
    return (rows.select(F.col("id").alias(id_col), F.expr(fold).alias("f"))
            .select(id_col, F.col("f.n").alias("n_bytes"),
                    F.expr("shiftleft(f.a, 31) | f.b").alias("fp")))


def _suspect_chunks(src: DataFrame, groups: DataFrame, chunk: int, moduli) -> DataFrame:
    """Chunks of the texts whose fingerprint may occur twice (a bit filter of fixed size lets
    a few others through; the joins that follow drop them)."""
    marked = src.sparkSession.sparkContext.broadcast(row_filter(groups, F.expr("fp + 31 * n_bytes")))

    def run(batches):
        own, bits = Fingerprinter(chunk, moduli), marked.value
        for b in text_slices(batches):
            normal = [normalise(t) for t in strings(b.column("text"))]
            fp = own.texts(normal)
            size = np.array([len(x) for x in normal], np.int64)
            spot = (fp + 31 * size) % FILTER_BITS
            hit = np.flatnonzero((size > 0) & (bits[spot >> 6] >> (spot & 63) & 1 == 1))
            pieces = -(-size[hit] // chunk)
            row = np.repeat(hit, pieces)
            number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            body = [normal[r][k * chunk:(k + 1) * chunk] for r, k in zip(row, number, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("row_key").take(pa.array(row)), pa.array(fp[row]), pa.array(size[row]),
                 pa.array(number, pa.int64()), pa.array(body, pa.binary())],
                names=["row_key", "fp", "n_bytes", "chunk_no", "body"])

    return src.mapInArrow(run, "row_key string, fp long, n_bytes long, chunk_no long, body binary")


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                chunk: int = CHUNK, moduli=MODULI) -> DataFrame:
    """id_col, keep_id, group_size, kept, text_sha256, ``row_key`` (the row's hash of id and text) and
    ``row_no``, which tells the rows of this result apart (it names no row of a second reading)."""
    src = pick(docs, id=id_col, text=text_col)
    src = src.withColumn("row_key", row_key(F.col("id"), F.col("text")))
    kind = src.schema["id"].dataType.simpleString()

    def fingerprints(batches):
        own = Fingerprinter(chunk, moduli)
        for b in text_slices(batches):
            texts = strings(b.column("text"))
            normal = [normalise(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column("row_key"), b.column("id"), pa.array(own.texts(normal)),
                 pa.array([len(x) for x in normal], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([hashlib.sha256(x).hexdigest() for x in normal], pa.string())],
                names=["row_key", "id", "fp", "n_bytes", "n_chars", "sha"])

    # numbered and written once; the number only settles which of equal rows stays
    rows = write_stage(src.mapInArrow(fingerprints, f"row_key string, id {kind}, fp long, n_bytes long, "
                                                    "n_chars long, sha string")
                       .withColumn("row_no", F.monotonically_increasing_id()))
    key = ["fp", "n_bytes"]
    first = (rows.where("n_bytes > 0").groupBy(key).agg(F.min("row_key").alias("first"), F.count("*").alias("n"))
             .where("n > 1").select(*key, "first"))
    first = write_stage(first)
    pieces = write_stage(_suspect_chunks(src, first, chunk, moduli))
    other = None
    round_no = 0
    while True:
        # rows that repeat id and text have the same chunks: one of each is enough to compare with.
        # Written, so that the join below is a plain one that Spark may split at a hot group
        ref = write_stage(pieces.join(first.select(F.col("first").alias("row_key")), "row_key")
                          .select(*key, "chunk_no", F.col("body").alias("ref")).dropDuplicates([*key, "chunk_no"]))
        seen = (pieces.join(ref, [*key, "chunk_no"])
                .groupBy("row_key", *key).agg(F.bool_and(F.col("body") == F.col("ref")).alias("same")))
        differ = write_stage(seen.where("not same").select("row_key", *key))
        if differ.isEmpty():
            break
        round_no += 1
        now = differ.withColumn("cls", F.lit(round_no))
        other = now if other is None else other.join(differ, "row_key", "left_anti").unionByName(now)
        first = write_stage(differ.groupBy(key).agg(F.min("row_key").alias("first")))
        pieces = write_stage(pieces.join(differ.select("row_key"), "row_key", "left_semi"))
    if other is None:
        rows = rows.withColumn("cls", F.lit(0))
    else:
        rows = (rows.join(other.select("row_key", "cls"), "row_key", "left")
                .withColumn("cls", F.coalesce("cls", F.lit(0))))
    best = F.min(F.struct((-F.col("n_chars")).alias("short"), F.col("id").isNull().alias("no_id"), "id", "row_no"))
    classes = (rows.groupBy(*key, "cls").agg(best.alias("best"), F.count("*").alias("group_size"))
               .select(*key, "cls", "group_size", F.col("best.id").alias("keep_id"),
                       F.col("best.row_no").alias("keep_row")))
    return (rows.join(classes, [*key, "cls"])
            .select("row_no", "row_key", F.col("id").alias(id_col), "keep_id", "group_size",
                    (F.col("row_no") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256")))


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` (all its columns) that ``exact_dedup`` keeps.

    Of rows that repeat id and text one stays, whatever their other columns hold."""
    names = docs.columns
    plain = docs.toDF(*[f"_in{i}" for i in range(len(names))])
    plain = plain.withColumn("row_key", row_key(F.col(f"_in{names.index(id_col)}"), F.col(f"_in{names.index(text_col)}")))
    found = (exact_dedup(docs, id_col=id_col, text_col=text_col).groupBy("row_key")
             .agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1"))
    found = write_stage(found.select("row_key", "kept"))
    alone = drop_listed(plain, found.select("row_key"), "row_key")
    # repeated rows that stay: a partial aggregate keeps one of them in each task
    again = only_listed(plain, found.where("kept").select("row_key"), "row_key")
    one = again.groupBy("row_key").agg(F.first(F.struct(*[f"_in{i}" for i in range(len(names))])).alias("r")).select("r.*")
    return alone.drop("row_key").unionByName(one).toDF(*names)
