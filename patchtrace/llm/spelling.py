"""Spelling variants: words that differ in one code point, by a dictionary of trie-node pairs.

The vocabulary is numbered twice as a trie, once forward and once reversed: a node is a
prefix or a suffix. Taking code point i out of a word leaves the pair (prefix node i, suffix
node behind i); the word itself, cut at i, is the pair (prefix node i, suffix node at i). Two words
meet at a pair exactly if they are near:

* two words with a point taken out: they differ in that point (replaced);
* one with a point taken out and one uncut: they differ by an inserted point. Of a run of equal points
  only the first counts here, so that a pair of words meets once.

A pair fixes all but one point, so at most one uncut word and one word for each letter of the
alphabet meet there. No two words are ever paired as rows: a pair's words are counted and the
most frequent one is read off the group. Node numbers are exact, nothing is verified later.

Numbering is one streaming pass over the sorted words (range-partitioned): a word's new nodes
lie below its longest common prefix with the word before. What reaches over a partition's
edge (the path of the last word) goes through the driver, one word for each partition. A node that only one
word passes can meet nobody, so a word emits only positions where both its prefix and its
suffix are shared; few are.

Defined results: null and empty texts have no words; a null id counts as the empty text in the hash;
repeated rows count each time; an empty table or one without repeated words gives no rows.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchtrace.llm.common import pick, write_stage

#: Fixed by the contract: what a word is made of, and which runs are damaged.
LETTERS = r"A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMAGE = 31
MIN_CHARS, MIN_COUNT, RATIO = 7, 2, 10


def vocabulary(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
               min_count: int = MIN_COUNT, damage: int | None = DAMAGE) -> DataFrame:
    """(word, n) of all documents; with ``damage``, one point goes from runs whose hash it divides."""
    src = pick(docs, id=id_col, text=text_col).where("text is not null")
    runs = src.select("id", F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{min_chars},}}"), F.lit(0)))
                      .alias("run")).withColumn("run", F.translate("run", UPPER, LOWER))
    word = F.col("run")
    if damage:
        h = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary"))
        at = (F.col("h") % F.length("run")).cast("int")
        cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
        runs = runs.withColumn("h", h)
        word = F.when(F.col("h") % damage == 0, cut).otherwise(F.col("run"))
    return (runs.select(word.alias("word")).where(F.length("word") >= min_chars)
            .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count))


def _shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    if a[:1] != b[:1]:
        return 0
    return len(os.path.commonprefix((a, b)))


class TrieWalk:
    """Numbers the trie nodes on the way along sorted words.

    Node numbers: the root is 0; a node first met at depth d of a word is ``base + d``, where base
    is the total length of the words before it.
    """

    def __init__(self, base: int = 0, path: tuple[int, ...] = ()):
        self.base = base
        #: Nodes at depth 1, 2, ... that the word before shares with the next one.
        self.path = list(path)

    def step(self, word: str, ahead: int) -> list[int]:
        """Nodes at depths 1 to max(shared with the word before, ``ahead`` shared with the next one)."""
        nodes = self.path + [self.base + d for d in range(len(self.path) + 1, ahead + 1)]
        self.base += len(word)
        self.path = nodes[:ahead]
        return nodes


def _ends(batches):
    """One row for a partition: part, first and last word, rows, total length, the depth down to
    which the last word's path is the first word's, and the local numbers of the path below."""
    first = last = part = None
    rows = base = 0
    path: list[int] = []  # all nodes of the last word, by local number
    for b in batches:
        for w in b.column("word").to_pylist():
            if first is None:
                first, part = w, b.column("part")[0].as_py()
                path = list(range(1, len(w) + 1))
            else:
                k = _shared(last, w)
                path = path[:k] + [base + d for d in range(k + 1, len(w) + 1)]
            base += len(w)
            rows += 1
            last = w
    if first is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([first]), pa.array([last]), pa.array([rows], pa.int64()),
             pa.array([base], pa.int64()), pa.array([path], pa.list_(pa.int64()))],
            names=["part", "first", "last", "n", "length", "path"])


ENDS = "part int, first string, last string, n long, length long, path array<long>"


def join_ends(ends: list) -> dict[int, dict]:
    """For each partition: number of rows and node base before it, the path that its first word shares
    with the word before, and how much its last word shares with the word behind."""
    out, rows, base, last, path = {}, 0, 0, None, []
    for e in ends:
        k = 0 if last is None else _shared(last, e.first)
        if last is not None:
            out[before]["ahead"] = k
        # local number d at depth d is a node of the first word; its first k nodes were met before
        new = [path[d - 1] if n == d and d <= k else base + n for d, n in enumerate(e.path, 1)]
        out[e.part] = {"rows": rows, "base": base, "path": tuple(path[:k]), "ahead": 0}
        rows, base, last, path, before = rows + e.n, base + e.length, e.last, new, e.part
    return out


def _with_next(batches):
    """(word, fields, the word behind it or None) of a partition's rows, across batches."""
    held = None
    for b in batches:
        for row in zip(*[b.column(i).to_pylist() for i in range(b.num_columns)], strict=True):
            if held is not None:
                yield held, row[0]
            held = row
    if held is not None:
        yield held, None


def _sorted_words(df: DataFrame, word: str) -> DataFrame:
    """``df`` range-partitioned and sorted by ``word``, its first column, with the partition's number."""
    return write_stage(df.repartitionByRange(word).sortWithinPartitions(word).withColumn("part", F.spark_partition_id()))


def _joined(df: DataFrame):
    ends = df.select("word", "part").mapInArrow(_ends, ENDS).collect()  # one row a partition
    return df.sparkSession.sparkContext.broadcast(join_ends(sorted(ends, key=lambda e: e.part)))


def _walk(joints, batches, part_at: int):
    """(row, rank, nodes shared with other words) of each row of one partition."""
    walk, rank, ahead_of_last = None, 0, 0
    for row, behind in _with_next(batches):
        if walk is None:
            own = joints.value[row[part_at]]
            walk, rank, ahead_of_last = TrieWalk(own["base"], own["path"]), own["rows"], own["ahead"]
        ahead = ahead_of_last if behind is None else _shared(row[0], behind)
        yield row, rank, walk.step(row[0], ahead)
        rank += 1


#: Rows of an output batch.
CHUNK = 20_000


def _out(rows, names, types):
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _forward(joints):
    names, types = ["back", "rank", "n", "nodes"], [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def run(batches):
        rows = []
        for (word, n, _), rank, nodes in _walk(joints, batches, 2):
            rows.append((word[::-1], rank, n, nodes))
            if len(rows) >= CHUNK:
                yield _out(rows, names, types)
                rows = []
        if rows:
            yield _out(rows, names, types)

    return run


#: Kinds of entries: an uncut word; a word with a point taken out, the first of its run or a later one.
UNCUT, FIRST, LATER = 0, 1, 2


def _entries(joints):
    names = ["prefix", "suffix", "kind", "rank", "n"]
    types = [pa.int64(), pa.int64(), pa.int8(), pa.int64(), pa.int64()]

    def run(batches):
        rows = []
        for (back, rank, n, before, _), _, behind in _walk(joints, batches, 4):
            size, a, b = len(back), len(before), len(behind)
            if a + b < size - 1:
                continue
            before, behind = [0, *before], [0, *behind]
            for i in range(max(0, size - 1 - b), min(a, size - 1) + 1):
                # code point i is back[size - 1 - i], the one before it back[size - i]
                kind = FIRST if i == 0 or back[size - i] != back[size - 1 - i] else LATER
                rows.append((before[i], behind[size - 1 - i], kind, rank, n))
            for i in range(max(0, size - b), min(a, size) + 1):
                rows.append((before[i], behind[size - i], UNCUT, rank, n))
            if len(rows) >= CHUNK:
                yield _out(rows, names, types)
                rows = []
        if rows:
            yield _out(rows, names, types)

    return run


def near_words(vocab: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(word, n, rank) of the vocabulary, and (rank, n_near, best) of the words that have near words;
    ``best`` holds the count and the negative rank of the near word that comes first. Ranks are
    places in code-point order."""
    words = _sorted_words(vocab.select("word", "n"), "word")
    at = _joined(words)
    forward = words.mapInArrow(_forward(at), "back string, rank long, n long, nodes array<long>")
    ranked = forward.select(F.reverse("back").alias("word"), "n", "rank")
    backward = _sorted_words(forward.withColumnRenamed("back", "word"), "word")
    entries = backward.mapInArrow(_entries(_joined(backward)), "prefix long, suffix long, kind byte, rank long, n long")
    pair = Window.partitionBy("prefix", "suffix")
    met = (entries.withColumn("size", F.count("*").over(pair)).where("size > 1")
           .groupBy("prefix", "suffix").agg(F.collect_list(F.struct("n", (-F.col("rank")).alias("low"), "kind")).alias("g")))
    # at most one entry for each letter and an uncut word
    mine = met.select("g", F.explode("g").alias("x"))

    def is_near(y):
        return ((y["low"] != F.col("x.low")) &
                F.when((y["kind"] != UNCUT) & (F.col("x.kind") != UNCUT), True)
                .otherwise((y["kind"] != LATER) & (F.col("x.kind") != LATER)))

    others = mine.select((-F.col("x.low")).alias("rank"), F.filter("g", is_near).alias("o")).where("size(o) > 0")
    best = F.array_max(F.transform("o", lambda y: F.struct(y["n"].alias("n"), y["low"].alias("low"))))
    near = (others.select("rank", F.size("o").cast("long").alias("n_near"), best.alias("best"))
            .groupBy("rank").agg(F.sum("n_near").alias("n_near"), F.max("best").alias("best")))
    return ranked, near


def spelling_variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                      min_count: int = MIN_COUNT, ratio: int = RATIO, damage: int | None = DAMAGE) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary."""
    ranked, near = near_words(vocabulary(docs, id_col=id_col, text_col=text_col, min_chars=min_chars,
                                         min_count=min_count, damage=damage))
    linked = F.col("best.n") >= ratio * F.col("n")
    table = write_stage(ranked.join(near, "rank", "left").select(
        "rank", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(linked, -F.col("best.low")).alias("form_rank"), F.when(linked, F.col("best.n")).alias("form_n")))
    # follow forms to the end: a form has ratio times the count, so the chain is short, and each
    # round only goes on with rows whose end has a form itself
    step = table.where("form_rank is not null").select(F.col("rank").alias("end"), F.col("form_rank").alias("next"))
    moving = write_stage(table.where("form_rank is not null").select("rank", F.col("form_rank").alias("end")))
    ended = None
    while not moving.isEmpty():
        moved = write_stage(moving.join(step, "end", "left"))
        over = moved.where("next is null").select("rank", F.col("end").alias("root_rank"))
        ended = over if ended is None else ended.unionByName(over)
        moving = moved.where("next is not null").select("rank", F.col("next").alias("end"))
    if ended is None:
        return table.select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"),
                            "n", "n_near", "form_n")
    names = table.select(F.col("rank").alias("at"), F.col("word").alias("name"))
    spelled = (table.where("form_rank is not null").select("rank", "form_rank").join(ended, "rank")
               .join(names.withColumnsRenamed({"at": "form_rank", "name": "form"}), "form_rank")
               .join(names.withColumnsRenamed({"at": "root_rank", "name": "root"}), "root_rank")
               .select("rank", "form", "root"))
    return table.join(spelled, "rank", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
