"""Packing: first-fit decreasing on a tournament tree, in randomised groups of documents.

Documents are dealt out by a hash and, within a task, read in hash order; every run of
about ``GROUP_TOKENS`` tokens is a group that is packed by itself, so memory is bounded by
a group and its longest document, and a lost task is packed again to the same result.

In a group, whole sequences are cut off long documents, then the rests are placed, longest
first, each into the first bin that has room: the leaf that a descent in a tournament tree
over the bins' free space finds in logarithmic time. Cutting is free, so the emptiest bins
are then emptied into the gaps of the fullest ones, and the one bin that stays partly full
is cut into sequences whose lengths are powers of two, which need no padding.

Defined results: a null text counts as empty; an empty text is its end token alone; null
and repeated ids are packed row by row.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchtrace.llm.common import WordHasher, binary_array, pick, text_slices, worker_cache
from patchtrace.llm.tokens import IdTable, per_row

LENGTH = 2048
GROUP_TOKENS = 1 << 20


class BinTree:
    """Bins in order of opening; finds the first with enough room."""

    def __init__(self, bins: int, room: int):
        self.size = 1 << max(0, bins - 1).bit_length()
        self.best = [room] * (2 * self.size)

    def place(self, length: int) -> int:
        """Take ``length`` from the first bin that has it."""
        best, node = self.best, 1
        while node < self.size:
            node *= 2
            if best[node] < length:
                node += 1
        found = node - self.size
        best[node] -= length
        while node > 1:
            node //= 2
            best[node] = max(best[2 * node], best[2 * node + 1])
        return found


def first_fit_decreasing(lengths: list[int], room: int) -> list[list[int]]:
    """Item numbers in each bin."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    tree = BinTree(max(1, len(lengths)), room)
    bins: list[list[int]] = []
    for i in order:
        at = tree.place(lengths[i])
        if at == len(bins):
            bins.append([])
        bins[at].append(i)
    return bins


def pack(sizes: list[int], room: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold each token of each document once."""
    whole, rests = [], []
    for doc, n in enumerate(sizes):
        cut = n - n % room
        whole += [[(doc, s, room)] for s in range(0, cut, room)]
        if n > cut:
            rests.append((doc, cut, n - cut))
    bins = [[rests[i] for i in b] for b in first_fit_decreasing([r[2] for r in rests], room)]
    fill = [sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda i: (-fill[i], i))
    bins, fill = [bins[i] for i in order], [fill[i] for i in order]
    low, high = 0, len(bins) - 1  # gaps are filled from the front, bins emptied from the back
    while low < high:
        gap = room - fill[low]
        if gap == 0:
            low += 1
            continue
        doc, start, n = bins[high].pop()
        take = min(n, gap)
        bins[low].append((doc, start, take))
        fill[low] += take
        fill[high] -= take
        if take < n:
            bins[high].append((doc, start + take, n - take))
        if not bins[high]:
            high -= 1
    bins = [b for b in bins if b]
    out = whole + bins
    if bins and sum(p[2] for p in bins[-1]) < room:
        out += _powers_of_two(out.pop())
    return out


def _powers_of_two(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    left, out = sum(p[2] for p in pieces), []
    pieces = pieces[::-1]
    while left:
        size = 1 << (left.bit_length() - 1)
        left -= size
        out.append([])
        while size:
            doc, start, n = pieces.pop()
            take = min(n, size)
            out[-1].append((doc, start, take))
            size -= take
            if take < n:
                pieces.append((doc, start + take, n - take))
    return out


def tokenize(docs: DataFrame, tokenizer_file: str, *, id_col: str = "doc_id", text_col: str = "text",
             end_id: int = 1) -> DataFrame:
    """id, n_tokens and ids (16- or 32-bit little-endian numbers) of each document with its end token.

    For tokenizers that drop white space and never join what it parts, nor letters and what is
    none: the ids of a text are those of its runs between ASCII white space.
    """

    def run(batches):
        table, kind, folds, special = _chunk_encoder(tokenizer_file)
        exact, folded, end = WordHasher(), WordHasher(lower=True, split_tail=True), np.array([end_id], kind)
        for b in text_slices(batches):
            # where no special token can stand, words that differ in case or end in a comma or full
            # stop share their entries in the table
            plain = folds and not any(pc.any(pc.match_substring(b.column("text"), s, ignore_case=True)).as_py()
                                      for s in special)
            hasher = folded if plain else exact
            keys, starts, stops, ends = hasher(b.column("text"))
            ids, lengths = table(keys, hasher.data, starts, stops)
            n = per_row(lengths, ends)
            # put the end token behind each document's ids
            stop = np.cumsum(n)
            both = np.insert(ids, stop, end[0]) if len(ids) else np.repeat(end, len(n))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("row_no"), pa.array(n + 1),
                 binary_array(both.tobytes(), (n + 1) * kind.itemsize).cast(pa.binary())],
                names=["id", "row_no", "n_tokens", "ids"])

    src = pick(docs, id=id_col, text=text_col).withColumn("row_no", F.monotonically_increasing_id())
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, row_no long, n_tokens long, ids binary")


def _chunk_encoder(tokenizer_file: str) -> tuple[IdTable, np.dtype, bool, list[str]]:
    """The worker's chunk table with its tokenizer, loaded once; the type of ids, whether case is
    dropped, the special tokens."""
    cache = worker_cache()
    if tokenizer_file not in cache:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(tokenizer_file)
        own.no_truncation()
        own.no_padding()
        kind = np.dtype("<u2" if own.get_vocab_size() <= 1 << 16 else "<u4")
        cache[tokenizer_file] = IdTable(
            lambda chunks: [e.ids for e in own.encode_batch_fast([c.decode("utf-8") for c in chunks],
                                                                 add_special_tokens=False)], kind), kind, \
            '"Lowercase"' in own.to_str(), [t.content for t in own.get_added_tokens_decoder().values()]
    return cache[tokenizer_file]


def pack_documents(docs: DataFrame, tokenizer_file: str, *, id_col: str = "doc_id", text_col: str = "text",
                   end_id: int = 1, room: int = LENGTH, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    tokens = tokenize(docs, tokenizer_file, id_col=id_col, text_col=text_col, end_id=end_id)
    kind = tokens.schema["id"].dataType.simpleString()
    dealt = (tokens.withColumn("slot", F.xxhash64("id", "row_no"))
             .repartition("slot").sortWithinPartitions("slot", "row_no"))

    def run(batches):
        base, done = TaskContext.get().partitionId() << 32, 0
        held, size = [], 0

        def packed():
            nonlocal done
            out, crc = [], []
            for pieces in pack([n for _, n, _ in held], room):
                offset = 0
                for doc, start, n in pieces:
                    id_, total, ids = held[doc]
                    crc.append(zlib.crc32(ids[start:start + n].astype("<u4").tobytes()))
                    out.append((id_, start, n, total, base + done, offset))
                    offset += n
                done += 1
            id_, start, n, total, seq, offset = map(list, zip(*out, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(id_, id_type), *[pa.array(x, pa.int64()) for x in (start, n, crc, total, seq, offset)]],
                names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        id_type = None
        for b in batches:
            id_type = b.schema.field("id").type
            rows = zip(b.column("id").to_pylist(), b.column("n_tokens").to_pylist(), b.column("ids"), strict=True)
            for id_, n, raw in rows:
                buffer = raw.as_buffer()
                held.append((id_, n, np.frombuffer(buffer, f"<u{len(buffer) // n}")))
                size += n
                if size >= group_tokens:
                    yield packed()
                    held, size = [], 0
        if held:
            yield packed()

    return (dealt.mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
                                  "sequence_id long, offset long").withColumnRenamed("id", id_col))
