"""BPE encoding and decoding by a deterministic automaton over tokens.

``MergeAutomaton`` starts from the automaton that accepts every byte string one byte token
at a time and applies one gadget for each merge ``u v -> w``, in order: the arcs labelled
``u`` are led to a copy of their target that has lost its arc ``v`` (the pair can't stand
unmerged any more), and every state with an arc ``u`` gets an arc ``w`` to where ``v`` led.
The result accepts exactly the token sequences that the merge list produces, one for each
byte string. All arcs with one label lead to one state, so the automaton is a table of
target states by token plus, for each state, its parent, its birth and the arcs it lost;
whether an arc exists follows from these, and asked-for transitions are kept in a table.

Encoding a pre-split word walks the automaton along the word's bytes (longest token first,
stepping back from dead ends) to its one accepted path. Decoding emits the arc labels.

Whole texts are cut into runs of non-blank characters with at most one space before them;
the pre-split pattern never joins what lies in two such runs, nor a letter and the comma or
full stop behind it, so a bounded table of runs
holds their ids (``IdTable``). Texts with blanks beyond ASCII are pre-split whole.

Defined results: a null text counts as empty, which has no ids; special tokens in a text
become their own ids, as the tokenizer file says; repeated rows get one result each.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from patchtrace.llm.common import WordHasher, binary_array, gather_runs, pick, spans_of, strings, text_slices, \
    worker_cache
from patchtrace.llm.tokens import IdTable, per_row

#: Blanks beyond ASCII (Unicode White_Space): fixed values.
_OTHER_BLANK = re.compile("[\x85\xa0  -     　]")
_NOW = 1 << 60
_SPACE_KEY = np.uint64(0xA0761D6478BD642F)


def byte_letters() -> dict[str, int]:
    """The public byte-level alphabet: printable Latin-1 stands for itself, other bytes follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class MergeAutomaton:
    """Built from the labels (bytes by token), the single-byte tokens and the ordered merges."""

    def __init__(self, labels: list[bytes], singles: dict[int, int], merges: list[tuple[int, int, int]]):
        n = len(labels)
        self.labels, self.ids = labels, {}
        self.birth, self.left = [_NOW] * n, [-1] * n  # a token without arcs is never born
        self.target = [0] * n
        self.parent, self.born, self.arcs_in = [-1], [0], [1]  # state 0 is the start
        self.lost: dict[tuple[int, int], int] = {}
        for token in singles.values():
            self.birth[token] = 0
            self.arcs_in[0] += 1
        for time, (u, v, w) in enumerate(merges, 1):
            self._gadget(time, u, v, w)
        for token in range(n):
            if self.birth[token] < _NOW:
                self.ids[labels[token]] = token
        self.longest = max(map(len, self.ids), default=1)
        self.table: dict[tuple[int, int], bool] = {}

    def _gadget(self, time: int, u: int, v: int, w: int) -> None:
        state, end = self.target[u], self.target[v]
        if self.birth[u] == _NOW or self.birth[w] < _NOW or not self.has_arc(state, v, time - 1):
            return  # the pair never stands side by side: the merge has no effect
        if self.arcs_in[state] > 1 or u == v:
            self.arcs_in[state] -= 1
            self.parent.append(state)
            self.born.append(time)
            self.arcs_in.append(1)
            state = self.target[u] = len(self.parent) - 1
        self.lost[state, v] = time
        self.birth[w], self.left[w], self.target[w] = time, u, end
        self.arcs_in[end] += 1

    def has_arc(self, state: int, token: int, time: int = _NOW) -> bool:
        """Whether the state had the arc at that time; follows copies and added arcs back."""
        lost, birth, born = self.lost, self.birth, self.born
        if birth[token] > time:
            return False
        while True:
            gone = lost.get((state, token))
            if gone is not None and gone <= time:
                return False
            if born[state] > birth[token]:
                time, state = born[state] - 1, self.parent[state]
            elif birth[token] == 0:
                return True
            else:
                time, token = birth[token], self.left[token]

    def step(self, state: int, token: int) -> bool:
        known = self.table.get((state, token))
        if known is None:
            if len(self.table) > 2_000_000:
                self.table.clear()
            known = self.table[state, token] = self.has_arc(state, token)
        return known

    def encode(self, word: bytes) -> list[int]:
        """The one token sequence that the automaton accepts for the word."""
        n, ids, target = len(word), self.ids, self.target
        whole = ids.get(word)
        if whole is not None and self.step(0, whole):
            return [whole]
        path: list[int] = []
        places = [(0, 0, min(n, self.longest))]  # (position, state, next length to try)
        dead = set()
        while places:
            at, state, size = places.pop()
            if at == n:
                return path
            while size > 0:
                token = ids.get(word[at:at + size])
                if token is not None and (at + size, target[token]) not in dead and self.step(state, token):
                    break
                size -= 1
            if size == 0:
                dead.add((at, state))
                if path:
                    path.pop()
                continue
            places.append((at, state, size - 1))
            path.append(token)
            places.append((at + size, target[token], min(n - at - size, self.longest)))
        if n == 0:
            return []
        raise ValueError("a byte of the word has no token")

    def decode(self, ids) -> bytes:
        """Emit the labels of the arcs."""
        return b"".join(self.labels[i] for i in ids)


class BytePairCodec:
    """A byte-level BPE tokenizer file: pre-split pattern, special tokens, automaton."""

    def __init__(self, tokenizer_file: str, pattern: str):
        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        labels = [b""] * (1 + max([*vocab.values(), *special.values()]))
        for token, i in vocab.items():
            if token not in special:
                labels[i] = bytes(letters[c] for c in token)
        singles = {labels[i][0]: i for t, i in vocab.items() if len(t) == 1 and t not in special}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.automaton = MergeAutomaton(labels, singles, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        self.labels = list(labels)
        for token, i in special.items():
            self.labels[i] = token.encode("utf-8")
        self.special = special
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") \
            if special else None
        self.split = regex.compile(pattern)
        size = np.fromiter(map(len, self.labels), np.int64, len(self.labels))
        self.letters = np.frombuffer(b"".join(self.labels), np.uint8)
        self.letter_ends = spans_of(size)
        self.kind = np.dtype(np.uint16 if len(labels) <= 1 << 16 else np.uint32)
        self.hasher = WordHasher(split_tail=True)
        self.table = IdTable(lambda chunks: [self.encode(c.decode("utf-8")) for c in chunks], self.kind)

    def encode(self, text: str) -> list[int]:
        """Ids of one text, by its pre-split words."""
        out: list[int] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append(self.special[part])
            else:
                for word in self.split.findall(part):
                    out += self.automaton.encode(word.encode("utf-8"))
        return out

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's begin."""
        keys, starts, stops, ends = self.hasher(column)
        data = self.hasher.data
        sizes = np.fromiter((len(t.encode("utf-8")) for t in strings(column)), np.int64, len(column))
        row_at = spans_of(sizes)
        # the blanks before each word, and behind each row's last one
        n = len(starts)
        first = np.zeros(n, bool)
        first[ends[:-1][np.diff(ends) > 0]] = True
        row = np.repeat(np.arange(len(column)), np.diff(ends))
        before = np.empty(n, np.int64)
        before[1:] = stops[:-1]
        before[first] = row_at[row[first]]
        gap = starts - before
        lead = np.zeros(n, bool)
        some = gap > 0
        lead[some] = data[starts[some] - 1] == 32
        head, single = np.flatnonzero(gap > 1), np.flatnonzero(some & ~lead)
        last = np.where(np.diff(ends) > 0, stops[np.maximum(ends[1:], 1) - 1] if n else 0, row_at[:-1])
        tail = np.flatnonzero(row_at[1:] > last)
        a = np.concatenate([before[head], starts[single] - 1, last[tail]])
        z = np.concatenate([starts[head] - 1, starts[single], row_at[1:][tail]])
        text = data.tobytes()
        blank_keys = np.fromiter((xxhash.xxh3_64_intdigest(text[i:j]) for i, j in zip(a.tolist(), z.tolist(), strict=True)),
                                 np.uint64, len(a))
        starts = starts - lead
        keys = np.where(lead, keys ^ _SPACE_KEY, keys)
        starts, stops = np.concatenate([starts, a]), np.concatenate([stops, z])
        keys = np.concatenate([keys, blank_keys])
        order = np.argsort(starts, kind="stable")
        starts, stops, keys = starts[order], stops[order], keys[order]
        ids, lengths = self.table(keys, data, starts, stops)
        return ids, spans_of(per_row(lengths, np.searchsorted(starts, row_at)))

    def encode_texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Like ``encode_column``, with texts that hold other blanks pre-split whole."""
        odd = [i for i, t in enumerate(strings(column)) if not t.isascii() and _OTHER_BLANK.search(t)]
        ids, ends = self.encode_column(column)
        if odd:
            parts = [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            for i in odd:
                parts[i] = np.array(self.encode(column[i].as_py()), self.kind)
            ids, ends = np.concatenate(parts), spans_of([len(p) for p in parts])
        return ids, ends

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of many id lists; bytes that are no UTF-8 become U+FFFD."""
        size = self.letter_ends[ids.astype(np.int64) + 1] - self.letter_ends[ids]
        text = gather_runs(self.letters, self.letter_ends[ids], size).tobytes()
        at = spans_of(size)[ends].tolist()
        return [text[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]


def codec(tokenizer_file: str, pattern: str) -> BytePairCodec:
    """The worker's codec, compiled once."""
    cache = worker_cache()
    key = ("codec", tokenizer_file, pattern)
    if key not in cache:
        cache[key] = BytePairCodec(tokenizer_file, pattern)
    return cache[key]


def encode_documents(docs: DataFrame, tokenizer_file: str, pattern: str, *, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """One row per document: id_col, ids (little-endian unsigned 32-bit numbers), n_tokens, decoded."""

    def run(batches):
        own = codec(tokenizer_file, pattern)
        for b in text_slices(batches):
            ids, ends = own.encode_texts(b.column("text"))
            n = np.diff(ends)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), binary_array(ids.astype("<u4").tobytes(), n * 4).cast(pa.binary()), pa.array(n),
                 pa.array(own.decode_all(ids, ends), pa.string())], names=["id", "ids", "n_tokens", "decoded"])

    src = pick(docs, id=id_col, text=text_col)
    kind = src.schema["id"].dataType.simpleString()
    return (src.mapInArrow(run, f"id {kind}, ids binary, n_tokens long, decoded string")
            .withColumnRenamed("id", id_col))


def digests(docs: DataFrame, tokenizer_file: str, pattern: str, *, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256: ``encode_documents`` hashed in the task."""

    def run(batches):
        own = codec(tokenizer_file, pattern)
        for b in text_slices(batches):
            ids, ends = own.encode_texts(b.column("text"))
            raw = ids.astype("<u4").tobytes()
            at = (ends * 4).tolist()
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(np.diff(ends)),
                 pa.array([hashlib.sha256(raw[i:j]).hexdigest() for i, j in zip(at[:-1], at[1:], strict=True)]),
                 pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in own.decode_all(ids, ends)])],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    src = pick(docs, id=id_col, text=text_col)
    kind = src.schema["id"].dataType.simpleString()
    return (src.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
            .withColumnRenamed("id", id_col))
