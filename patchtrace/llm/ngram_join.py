"""N-gram Jaccard join: prefix index, set-relation skipping, connected documents.

A document's set holds its distinct word shingles as 64-bit hashes. Two sets link when
``den * |a & b| >= num * |a | b|`` (75 / 100). The join is exact: prefixes of the sets, in
one global order from rare to frequent shingles, must share an element, and every nominee
(for components only those that aren't already connected) is decided on the whole sets.

* Equal sets are one class from the start; copies are never expanded into pairs.
* The global order needs only to be the same everywhere, not exact: shingles are ordered by
  a counter table of fixed size that counts the shingles of all documents.
* An index list (all classes that share a prefix shingle) is sorted by position. Its first
  entry, the class with fewest rarer shingles of its own, becomes the list's leader. Every
  class is first compared with the leader that it shares most lists with.
* Answers are then derived from the leader's: what is connected through a leader needs no
  comparison among its members, and for two classes compared with one leader the known
  overlaps bound their own, ``|a & b| <= min(oa, ob) + min(na - oa, nb - ob)``.
* ``ngram_links`` decides every candidate pair instead, connected or not (the leader's bound
  still spares comparisons): all links between classes, with the classes' sizes; ``link_counts``
  weighs them by these. Its work and its result grow with the number of links.
* What is left joins list by list on blocks of set size. An entry at position p of a set of
  n elements reaches only partners of at most (n - p) * den / num elements, so a late
  position skips whole blocks.

All joins are equi-joins that Spark may split at hot keys; classes are dropped from a
task's second copy on before the shuffle; very long lists are salted by a rule that follows
from the counter table, and the block join puts their parts together again.

Defined results: words are split on ``[\\x20\\x09-\\x0D]`` after lower-casing A-Z; fewer
words than the shingle size make one shingle of them all; no word, no text: an empty set,
linked with nothing; rows that repeat an id are one node; ids may be of any type that can be
ordered; a null id gets its size and a null component.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchtrace.llm.common import (FILTER_BITS, WordHasher, drop_listed, mix64, pick, row_filter,
                                   spans_of, text_slices, write_stage)

SHINGLE = 5
#: Link when 100 * intersection >= 75 * union.
NUM, DEN = 75, 100
#: Counter table: four counters a document, within these powers of two (at most 16 MB).
COUNTERS = (1 << 16, 1 << 22)
BLOCK = 256
#: Entries of an index list that one task takes at most, by the counter table's estimate.
LIST_LIMIT = 1 << 17
#: Class keys that a task remembers, to leave out later copies.
SEEN_LIMIT = 300_000


class Shingler:
    """Turns a text column into sorted sets of 64-bit shingle hashes."""

    def __init__(self, size: int = SHINGLE):
        self.size, self.hasher = size, WordHasher(lower=True)
        self.odd = np.random.default_rng(5).integers(1, 1 << 62, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sets(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All sets one after the other, and where each begins (with the end)."""
        word, _, _, ends = self.hasher(column)
        n = max(0, len(word) - self.size + 1)
        rolled = np.zeros(n, np.uint64)
        for i in range(self.size):
            rolled += word[i:i + n] * self.odd[i]
        rolled = mix64(rolled)
        out = []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            if b - a >= self.size:
                own = np.sort(rolled[a:b - self.size + 1])
                new = np.ones(len(own), bool)
                np.not_equal(own[1:], own[:-1], out=new[1:])
                out.append(own[new])
            elif b > a:
                short = word[a:b] * self.odd[:b - a]
                out.append(mix64(short.sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
            else:
                out.append(rolled[:0])
        return (np.concatenate(out) if out else rolled[:0]), spans_of([len(s) for s in out])


def class_keys(flat: np.ndarray, ends: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each set, sums of two different mixes of its elements."""
    n = np.diff(ends)
    keys = []
    for salt in (2 * seed + 1, 2 * seed + 2):
        mixed = mix64(flat + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
        total = np.zeros(len(n), np.uint64)
        some = np.flatnonzero(n)
        if len(some):
            total[some] = np.add.reduceat(mixed, ends[:-1][some])
        keys.append(mix64(total + n.astype(np.uint64)).view(np.int64))
    return keys[0], keys[1]


def prefix_length(n, num: int = NUM, den: int = DEN):
    return n - (n * num + den - 1) // den + 1


def _needed(a: str, b: str, num: int, den: int) -> str:
    """SQL: the least overlap of two linked sets of these sizes."""
    return f"(({a} + {b}) * {num} + {num + den - 1}) div {num + den}"


def _sets_and_counters(src: DataFrame, width: int, seed: int, size: int) -> DataFrame:
    """First reading: one row per document, and the task's counters as compressed blocks."""
    kind = src.schema["id"].dataType.simpleString()

    def run(batches):
        own, counts = Shingler(size), np.zeros(width, np.int64)
        none = lambda m, t: pa.nulls(m, t)
        for b in text_slices(batches):
            flat, ends = own.sets(b.column("text"))
            k, k2 = class_keys(flat, ends, seed)
            counts += np.bincount((flat & np.uint64(width - 1)).astype(np.int64), minlength=width)
            m = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(np.diff(ends)), pa.array(k), pa.array(k2),
                 none(m, pa.int32()), none(m, pa.binary())], names=["id", "n", "k", "k2", "block", "counts"])
        blocks = counts.reshape(-1, BLOCK)
        spot = np.flatnonzero(blocks.any(1))
        for part in np.array_split(spot, max(1, len(spot) // 2048)):
            m = len(part)
            yield pa.RecordBatch.from_arrays(
                [none(m, b_type), *[none(m, pa.int64())] * 3, pa.array(part.astype(np.int32)),
                 pa.array([zlib.compress(blocks[s].tobytes(), 1) for s in part], pa.binary())],
                names=["id", "n", "k", "k2", "block", "counts"])

    b_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    return src.mapInArrow(run, f"id {kind}, n long, k long, k2 long, block int, counts binary")


def _counter_table(blocks: DataFrame, width: int) -> np.ndarray:
    """Sum the tasks' counters block by block; the table has ``width`` numbers."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for block, c in zip(b.column("block").to_pylist(), b.column("counts").to_pylist(), strict=True):
                c = np.frombuffer(zlib.decompress(c), np.int64)
                total[block] = total[block] + c if block in total else c
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([c.tobytes() for c in total.values()], pa.binary())],
            names=["block", "counts"])

    out = np.zeros((width // BLOCK, BLOCK), np.int64)
    got = blocks.repartition("block").mapInArrow(add, "block int, counts binary").toArrow()
    for block, c in zip(got["block"].to_pylist(), got["counts"].to_pylist(), strict=True):
        out[block] = np.frombuffer(c, np.int64)
    return np.minimum(out.ravel(), (1 << 31) - 1).astype(np.int32)


def _postings(src: DataFrame, table, seed: int, size: int, num: int, den: int, limit: int) -> DataFrame:
    """Second reading: the prefix of each class in the global order (once a task)."""

    def run(batches):
        own, counts, seen = Shingler(size), table.value, set()
        mask = np.uint64(len(counts) - 1)
        for b in text_slices(batches):
            flat, ends = own.sets(b.column("text"))
            k, _ = class_keys(flat, ends, seed)
            hs, ks, ns, ps = [], [], [], []
            if len(seen) > SEEN_LIMIT:
                seen.clear()
            freq = counts[(flat & mask).astype(np.int64)]
            for i, key in enumerate(k.tolist()):
                a, z = ends[i], ends[i + 1]
                if z == a or key in seen:
                    continue
                seen.add(key)
                m = prefix_length(int(z - a), num, den)
                order = np.lexsort((flat[a:z], freq[a:z]))[:m] if m > 1 else [np.lexsort((flat[a:z], freq[a:z]))[0]]
                hs.append(a + order)
                ks.append(np.full(m, key, np.int64))
                ns.append(np.full(m, z - a, np.int32))
                ps.append(np.arange(m, dtype=np.int32))
            if not hs:
                continue
            spot, key = np.concatenate(hs), np.concatenate(ks)
            parts = 1 + freq[spot].astype(np.int64) // limit
            salt = np.where(parts > 1, (key & 0x7FFFFFFF) % parts + 1, 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat[spot].view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(np.concatenate(ps)),
                 pa.array(np.concatenate(ns)), pa.array(key)], names=["h", "salt", "pos", "n", "k"])

    return src.mapInArrow(run, "h long, salt int, pos int, n int, k long")


def _shared_lists(postings: DataFrame) -> DataFrame:
    """Entries of lists that two classes share, each with its list's leader (lk, ln, lp)."""

    def run(batches):
        head = None  # the current list's first entry: h, salt, pos, n, k, and whether it is out
        last = None
        for b in batches:
            if b.num_rows == 0:
                continue
            h, salt, pos, n, k = (b.column(c).to_numpy() for c in ("h", "salt", "pos", "n", "k"))
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]) | (salt[1:] != salt[:-1])
            again = np.zeros(len(h), bool)
            again[1:] = ~first[1:] & (k[1:] == k[:-1])
            if head is not None and (h[0], salt[0]) == head[:2]:
                first[0], again[0] = False, k[0] == last
            last = k[-1]
            # entry 0 of the arrays below stands for the list that goes on from the batch before
            base = head or (0, 0, 0, 0, 0, True)
            lead = np.maximum.accumulate(np.where(first, np.arange(1, len(h) + 1), 0))
            col = [np.concatenate([[v], x]) for v, x in zip(base[:5], (h, salt, pos, n, k), strict=True)]
            members = ~first & ~again
            out = np.zeros(len(h) + 1, bool)
            out[1:] = members
            out[lead[members]] = True
            out[1:] |= first & (salt > 0)  # a salted list may go on in another part
            if base[5]:
                out[0] = False
            where = np.flatnonzero(out)
            lead = np.concatenate([[0], lead])[where]
            state = bool(out[0]) or base[5]
            at = int(np.concatenate([[0], np.maximum.accumulate(np.where(first, np.arange(1, len(h) + 1), 0))])[-1])
            if at:
                head = (h[at - 1], salt[at - 1], pos[at - 1], n[at - 1], k[at - 1], bool(out[at]))
            else:
                head = (*base[:5], state)
            yield pa.RecordBatch.from_arrays(
                [pa.array(col[0][where]), pa.array(col[2][where].astype(np.int32)),
                 pa.array(col[3][where].astype(np.int32)), pa.array(col[4][where]), pa.array(col[4][lead]),
                 pa.array(col[3][lead].astype(np.int32)), pa.array(col[2][lead].astype(np.int32))],
                names=["h", "pos", "n", "k", "lk", "ln", "lp"])

    return (postings.repartition("h", "salt").sortWithinPartitions("h", "salt", "pos", "n", "k")
            .mapInArrow(run, "h long, pos int, n int, k long, lk long, ln int, lp int"))


def _texts_of(src: DataFrame, ids) -> DataFrame:
    """The texts of documents whose id the bit filter marks (a few others may pass, too)."""
    marked = src.sparkSession.sparkContext.broadcast(ids)

    def run(batches):
        bits = marked.value
        for b in batches:
            spot = b.column("_spot").to_numpy()
            yield b.filter(pa.array(bits[spot >> 6] >> (spot & 63) & 1 == 1))

    spotted = src.where("id is not null").withColumn("_spot", F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS).cast("long")))
    return spotted.mapInArrow(run, spotted.schema).drop("_spot")


def _overlaps(src: DataFrame, pairs: DataFrame, seed: int, size: int) -> DataFrame:
    """Add the exact overlap ``o`` to pairs (a, b) of classes; their sets are made anew from the
    texts of the documents ``low`` and ``low2``, which are smaller than the sets."""
    left = _texts_of(src, row_filter(pairs, F.xxhash64("low"))).select(F.col("id").alias("low"), F.col("text").alias("x"))
    right = _texts_of(src, row_filter(pairs, F.xxhash64("low2"))).select(F.col("id").alias("low2"), F.col("text").alias("y"))

    def run(batches):
        own, kept = Shingler(size), (None, None)
        for whole in batches:
            for b in text_slices(iter([whole]), "x"):
                fx, ex = own.sets(b.column("x"))
                kx, _ = class_keys(fx, ex, seed)
                a, z = b.column("a").to_numpy(), b.column("b").to_numpy()
                o = np.full(len(a), -1, np.int64)
                for i in range(len(a)):
                    if kx[i] != a[i]:
                        continue
                    if kept[0] != z[i]:  # rows of one partner follow each other after the join
                        fy, ey = own.sets(b.column("y").slice(i, 1))
                        if class_keys(fy, ey, seed)[0][0] != z[i]:
                            continue
                        kept = (z[i], fy)
                    both = np.concatenate([fx[ex[i]:ex[i + 1]], kept[1]])
                    both.sort(kind="stable")
                    o[i] = np.count_nonzero(both[1:] == both[:-1])
                hit = np.flatnonzero(o >= 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a[hit]), pa.array(z[hit]), b.column("n").take(pa.array(hit)),
                     b.column("n2").take(pa.array(hit)), pa.array(o[hit])], names=["a", "b", "n", "n2", "o"])

    return (pairs.select("a", "b", "n", "n2", "low", "low2").join(left, "low").join(right, "low2")
            .select("a", "b", "n", "n2", "x", "y")
            .mapInArrow(run, "a long, b long, n int, n2 int, o long").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node that is reachable, by label passing with short cuts."""
    both = write_stage(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
                       .union(edges.select(F.col("b"), F.col("a"))).where("u <> v").distinct())
    label = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select(
        "node", F.least("node", "m").alias("comp"))
    label = write_stage(label)
    while True:
        near = (both.join(label.select(F.col("node").alias("v"), "comp"), "v")
                .groupBy(F.col("u").alias("node")).agg(F.min("comp").alias("near")))
        step = label.join(near, "node").select("node", F.col("comp").alias("old"),
                                               F.least("comp", "near").alias("comp"))
        # short cut: follow the new label to that node's own new label
        hop = step.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        step = write_stage(step.join(hop, "comp", "left")
                           .select("node", "old", F.coalesce("far", "comp").alias("comp")))
        label = step.select("node", "comp")
        if step.where("old <> comp").isEmpty():
            return label


def _linked(num: int, den: int) -> str:
    return f"o >= {_needed('n', 'n2', num, den)}"


def _prepared(docs: DataFrame, id_col: str, text_col: str, size: int, num: int, den: int, list_limit: int,
              counters: int | None):
    """What both joins start from: documents, their classes, shared lists, leaders' overlaps (``told``),
    and the function that decides pairs of classes."""
    src = pick(docs, id=id_col, text=text_col)
    if counters is None:
        counters = min(COUNTERS[1], max(COUNTERS[0], 1 << (max(1, docs.count()) * 4 - 1).bit_length()))
    seed = 0
    while True:  # a class key that two different sets share (as good as never) asks for another seed
        read = write_stage(_sets_and_counters(src, counters, seed, size))
        meta = read.where("block is null").select("id", "n", "k", "k2")
        classes = (meta.where("n > 0").groupBy("k").agg(
            F.min("id").alias("low"), F.min("n").alias("n"), F.max("n").alias("n9"),
            F.min("k2").alias("k2"), F.max("k2").alias("k29")))
        if classes.where("n <> n9 or k2 <> k29").isEmpty():
            break
        seed += 1
    sc = docs.sparkSession.sparkContext
    table = sc.broadcast(_counter_table(read.where("block is not null").select("block", "counts"), counters))
    shared = write_stage(_shared_lists(_postings(src, table, seed, size, num, den, list_limit)))

    low = write_stage(shared.select("k").distinct().join(classes.select("k", "low"), "k"))
    named = lambda df: (df.join(low.select(F.col("k").alias("a"), "low"), "a")
                        .join(low.select(F.col("k").alias("b"), F.col("low").alias("low2")), "b"))
    fits = (f"least(n, ln) * {den} >= greatest(n, ln) * {num} "
            f"and least(n - pos, ln - lp) >= {_needed('n', 'ln', num, den)}")
    nominees = (shared.where(f"k <> lk and {fits}").groupBy("k", "lk", "n", "ln").agg(F.count("*").alias("c"))
                .groupBy("k").agg(F.max(F.struct("c", "lk", "n", "ln")).alias("best"))
                .select(F.col("k").alias("a"), F.col("best.lk").alias("b"), F.col("best.n").alias("n"),
                        F.col("best.ln").alias("n2")))
    decide = lambda pairs: _overlaps(src, write_stage(named(pairs)), seed, size)
    return meta, classes, shared, write_stage(decide(nominees)), decide


def _candidates(entries: DataFrame, num: int, den: int, condition: str = "true") -> DataFrame:
    """Pairs (a, b) of classes, other than leader and member, that a list and the bounds allow to link;
    ``entries`` has h, k, n, pos, comp, lead and o, the overlap with the leader."""
    log = f"int(floor(ln({{}}) / {float(np.log(den / num))!r}))"
    left = (entries.withColumn("far", F.expr(f"least((n - pos) * {den} div {num}, n * {den} div {num})"))
            .where("far >= n")
            .withColumn("blk", F.explode(F.expr(f"sequence({log.format('n')}, {log.format('far')})"))))
    right = entries.select("h", *[F.col(c).alias(c + "2") for c in ("k", "n", "pos", "comp", "lead", "o")],
                           F.expr(log.format("n")).alias("blk"))
    pairs = left.join(right, ["h", "blk"]).where(
        f"(n < n2 or (n = n2 and k < k2)) and {condition} and n2 <= far "
        f"and least(n - pos, n2 - pos2) >= {_needed('n', 'n2', num, den)} "
        f"and (lead <> lead2 or least(o, o2) + least(n - o, n2 - o2) >= {_needed('n', 'n2', num, den)}) "
        f"and not (lead = k2 or lead2 = k)")
    return pairs.select(F.col("k").alias("a"), F.col("k2").alias("b"), "n", "n2").distinct()


def ngram_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
               num: int = NUM, den: int = DEN, list_limit: int = LIST_LIMIT,
               counters: int | None = None) -> DataFrame:
    """One row per document: id_col, n_shingles, component_id (the smallest id it is linked to)."""
    meta, classes, shared, told, decide = _prepared(docs, id_col, text_col, size, num, den, list_limit, counters)
    linked = _linked(num, den)
    # rows that repeat an id are one node, whatever their texts
    same_id = (meta.where("n > 0 and id is not null").select("id", "k").distinct()
               .groupBy("id").agg(F.min("k").alias("a"), F.max("k").alias("b")).where("a <> b"))
    ids = (meta.where("n > 0 and id is not null").join(same_id.select("id", "a"), "id")
           .select("a", F.col("k").alias("b")).where("a <> b").distinct())
    first = write_stage(told.where(linked).select("a", "b").union(ids))
    near = components(first)

    # every class with its component so far, its leader and its overlap with it
    state = (shared.select("k").distinct()
             .join(near.select(F.col("node").alias("k"), "comp"), "k", "left")
             .join(told.select(F.col("a").alias("k"), F.col("b").alias("lead"), "o"), "k", "left")
             .select("k", F.coalesce("comp", "k").alias("comp"), F.coalesce("lead", "k").alias("lead"), "o"))
    entries = shared.select("h", "k", "n", "pos").join(write_stage(state), "k")
    mixed = (entries.groupBy("h").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"))
             .where("c0 <> c1").select("h"))
    entries = (entries.join(mixed, "h")
               .select("h", "k", "n", "pos", "comp", "lead", F.coalesce("o", F.col("n").cast("long")).alias("o")))
    entries = write_stage(entries)
    pairs = _candidates(entries, num, den, "comp <> comp2")
    more = decide(pairs).where(linked).select("a", "b")
    whole = components(first.union(more))

    member = (classes.select("k", "low").join(whole.select(F.col("node").alias("k"), "comp"), "k", "left")
             .select("k", "low", F.coalesce("comp", "k").alias("comp")))
    lowest = member.groupBy("comp").agg(F.min("low").alias("component_id"))
    member = member.join(lowest, "comp").select("k", "component_id")
    full = meta.where("n > 0 and id is not null").join(member, "k").select("id", "n", "component_id")
    rest = meta.where("n = 0 or id is null").select(
        "id", "n", F.when(F.col("n") == 0, F.col("id")).alias("component_id"))
    return full.unionByName(rest).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def ngram_links(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
                num: int = NUM, den: int = DEN, list_limit: int = LIST_LIMIT,
                counters: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Every link between different sets, and who has which set.

    Links: one row per linked pair of classes of equal sets, a, b (the classes' keys), rep, rep2
    (the smallest ids of the two, smaller first), overlap (common shingles). Members: one row per
    document with a set and an id, id_col, n_shingles, k (its class's key), rep, class_size
    (distinct ids of the class). Copies share a class and are never expanded.
    """
    meta, classes, shared, told, decide = _prepared(docs, id_col, text_col, size, num, den, list_limit, counters)
    lead = told.select(F.col("a").alias("k"), F.col("b").alias("lead"), "o")
    entries = write_stage(shared.select("h", "k", "n", "pos").join(lead, "k", "left").select(
        "h", "k", "n", "pos", F.col("k").alias("comp"), F.coalesce("lead", "k").alias("lead"),
        F.coalesce("o", F.col("n").cast("long")).alias("o")))
    more = decide(_candidates(entries, num, den))
    found = (told.union(more).where(_linked(num, den))
             .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "o").distinct())
    ids = meta.where("n > 0 and id is not null").select("id", "n", "k")
    sizes = ids.groupBy("k").agg(F.min("id").alias("rep"), F.countDistinct("id").alias("class_size"))
    links = write_stage(found.join(sizes.select(F.col("k").alias("a"), F.col("rep").alias("x")), "a")
                        .join(sizes.select(F.col("k").alias("b"), F.col("rep").alias("y")), "b")
                        .select("a", "b", F.least("x", "y").alias("rep"), F.greatest("x", "y").alias("rep2"),
                                F.col("o").alias("overlap")))
    members = ids.join(sizes, "k").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "rep", "class_size", "k")
    return links, members


def link_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document with a set and an id: id_col, n_shingles, n_links (documents linked to its
    text, copies included, each once a class)."""
    links, members = ngram_links(docs, id_col=id_col, text_col=text_col, **options)
    sizes = members.select("k", "class_size").distinct()
    both = links.select("a", "b").union(links.select("b", "a"))
    others = (both.join(sizes.withColumnRenamed("k", "b"), "b").groupBy(F.col("a").alias("k"))
              .agg(F.sum("class_size").alias("others")))
    return members.join(others, "k", "left").select(
        id_col, "n_shingles", (F.col("class_size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))


def keep_smallest(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` (all its columns) whose id is the smallest of its group.

    Documents without a set or an id are linked with nothing and stay.
    """
    found = ngram_join(docs, id_col=id_col, text_col=text_col, **options)
    gone = write_stage(found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("id")).distinct())
    plain = docs.toDF(*[f"_in{i}" for i in range(len(docs.columns))])
    plain = plain.withColumn("id", F.col(f"_in{docs.columns.index(id_col)}"))
    return drop_listed(plain, gone, "id").drop("id").toDF(*docs.columns)
