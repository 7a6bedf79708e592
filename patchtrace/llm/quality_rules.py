"""Quality rules: counts of a text and its divergence from language references.

Base counts come from one pass over the bytes of a slice of documents. The verdict compares
two histograms of a text with references that are summed over all documents of a language:
character classes, and the language's most common words (with one place for all
others). The measure is the Jensen-Shannon distance (square root of the divergence in
bits, 0 to 1); a text is compared with every language and the nearest one counts, so a null
or wrong language label does no harm. Short texts have no stable histogram: the verdict
applies from a minimum number of characters or words on, and its limits widen with the
inverse square root of the sample.

Reference words are made of letters only, in any script and of any length. Tasks sum them in
bounded tables, Spark adds the sums up, and each partition of the totals offers its most common
words of every language, so that one small window ends the search for all languages at once.

Defined results: a null text has no words; repeated rows get one result each; with no
language label at all, all documents together are the one reference; without documents
the result is empty.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchtrace.llm.common import WordHasher, mix64, pick, strings, text_slices, write_stage

#: Characters that count as symbols (fixed by the contract).
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
REPEAT_PERCENT = 20
#: Distinct words that a task sums before it hands them on.
TABLE_LIMIT = 200_000
COMMON_WORDS = 48
#: Guards and limits of the verdict: smallest sample, limit, widening.
CHAR_GUARD, CHAR_LIMIT, CHAR_SLACK = 200, 0.18, 3.0
WORD_GUARD, WORD_LIMIT, WORD_SLACK = 60, 0.16, 2.0
CLASSES = ("lower", "upper", "digit", "blank", "stop", "symbol", "other ascii", "beyond ascii", "inside a character")


def class_table() -> np.ndarray:
    """The class of each byte; bytes inside a UTF-8 character are the last one and not counted."""
    t = np.full(256, 6, np.int64)
    t[97:123], t[65:91], t[48:58] = 0, 1, 2
    t[[9, 10, 11, 12, 13, 32]] = 3
    t[list(b".,;:!?'\"()-")] = 4
    t[list(SYMBOLS)] = 5
    t[192:], t[128:192] = 7, 8
    return t


@dataclass
class Reference:
    """Per language: distribution over character classes, word hashes, distribution over them."""

    languages: list[str]
    chars: np.ndarray
    words: list[np.ndarray]
    shares: list[np.ndarray]


class Counter:
    """Counts of a slice of texts."""

    def __init__(self):
        self.exact, self.lower, self.classes = WordHasher(), WordHasher(lower=True), class_table()
        self.odd = np.random.default_rng(9).integers(1, 1 << 62, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def chars(self, column: pa.Array, data: np.ndarray) -> np.ndarray:
        """Characters of each class in each row."""
        size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        n = len(CLASSES)
        row = np.repeat(np.arange(len(size)) * n, size)
        return np.bincount(row + self.classes[data], minlength=len(size) * n).reshape(len(size), n)[:, :-1]

    def base(self, column: pa.Array) -> dict[str, np.ndarray]:
        word, _, _, ends = self.exact(column)
        chars = self.chars(column, self.exact.data)
        n_words = np.diff(ends)
        row = np.repeat(np.arange(len(column)), n_words)
        m = max(0, len(word) - WINDOW + 1)
        window = mix64(row[:m].astype(np.uint64) + np.uint64(1))
        for i in range(WINDOW):
            window += word[i:i + m] * self.odd[i]
        start = np.flatnonzero(row[:m] == row[WINDOW - 1:][:m]) if m else np.zeros(0, np.int64)
        order = start[np.argsort(window[start], kind="stable")]
        same = window[order][1:] == window[order][:-1]
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        covered = np.zeros(len(word), bool)
        for i in range(WINDOW):
            covered[order[twice] + i] = True
        run = np.concatenate([[0], np.cumsum(covered)])
        dup = []
        for t in strings(column):
            lines = [x for x in t.encode("utf-8").split(b"\n") if x.strip()]
            dup.append(len(lines) - len(set(lines)))
        return {"n_words": n_words, "word_chars": chars.sum(1) - chars[:, 3], "n_symbols": chars[:, 5],
                "n_dup_lines": np.array(dup, np.int64), "n_repeat_words": run[ends[1:]] - run[ends[:-1]],
                "chars": chars}


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of ``p`` from the distribution ``q``."""
    mid = (p + q) / 2

    def part(x):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log2(x / mid), 0.0).sum(1)

    return np.sqrt(np.clip((part(p) + part(np.broadcast_to(q, p.shape))) / 2, 0, 1))


def references(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang",
               common_words: int = COMMON_WORDS) -> Reference:
    """Sum the histograms of all documents of each language."""
    src = pick(docs, text=text_col, lang=lang_col)

    def table_of(words: dict):
        rows = list(words.items())
        for i in range(0, len(rows), 10_000):
            part = rows[i:i + 10_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k, _ in part], pa.string()), pa.array([k[1] for k, _ in part], pa.string()),
                 pa.array([int(n) for _, n in part], pa.int64())], names=["lang", "word", "n"])

    def run(batches):
        own, total, words, spell = Counter(), {}, {}, {}
        for b in text_slices(batches):
            langs = b.column("lang").to_pylist()
            word, starts, stops, ends = own.lower(b.column("text"))
            data = own.lower.data
            chars = own.chars(b.column("text"), data)
            row = np.repeat(np.arange(len(langs)), np.diff(ends))
            for lang in set(langs):
                mine = np.array([x == lang for x in langs], bool)
                total[lang] = total.get(lang, 0) + chars[mine].sum(0)
                at_word = np.flatnonzero(mine[row])
                words[lang, "#all"] = words.get((lang, "#all"), 0) + len(at_word)
                keys, first, n = np.unique(word[at_word], return_index=True, return_counts=True)
                for key, at, c in zip(keys.tolist(), at_word[first].tolist(), n.tolist(), strict=True):
                    if key not in spell:
                        text = data[starts[at]:stops[at]].tobytes().lower().decode("utf-8", "replace")
                        spell[key] = text if text.isalpha() else None
                    if spell[key] is not None:
                        words[lang, spell[key]] = words.get((lang, spell[key]), 0) + c
            if len(words) + len(spell) > TABLE_LIMIT:
                yield from table_of(words)
                words, spell = {}, {}
        yield from table_of(words)
        yield from table_of({(lang, f"#{i}"): c for lang, t in total.items() for i, c in enumerate(t)})

    counts = write_stage(src.mapInArrow(run, "lang string, word string, n long")
                         .groupBy("lang", "word").agg(F.sum("n").alias("n")))
    if counts.where("lang is not null").isEmpty():
        counts = write_stage(counts.withColumn("lang", F.lit("")))
    counts = counts.where("lang is not null")
    sums = {(r["lang"], r["word"]): r["n"] for r in counts.where("word like '#%'").collect()}
    languages = sorted({lang for lang, _ in sums})
    chars, words, shares = [], [], []
    hasher = WordHasher(lower=True)

    def most_common(batches):
        best: dict[str, list] = {}
        for b in batches:
            for lang, word, n in zip(*[b.column(c).to_pylist() for c in ("lang", "word", "n")], strict=True):
                best.setdefault(lang, []).append((-n, word))
            best = {x: heapq.nsmallest(common_words, rows) for x, rows in best.items()}
        rows = [(lang, word, -n) for lang, top in best.items() for n, word in top]
        lang, word, n = map(list, zip(*rows, strict=True)) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.string()), pa.array(n, pa.int64())],
                                         names=["lang", "word", "n"])

    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    tops: dict[str, list] = {}
    for r in (counts.where(~F.col("word").startswith("#")).mapInArrow(most_common, "lang string, word string, n long")
              .withColumn("place", place).where(F.col("place") <= common_words).orderBy("lang", "place").collect()):
        tops.setdefault(r["lang"], []).append((r["word"], r["n"]))
    for lang in languages:
        c = np.array([sums.get((lang, f"#{i}"), 0) for i in range(len(CLASSES) - 1)], float)
        chars.append(c / max(1.0, c.sum()))
        top = tops.get(lang, [])
        n = np.array([k for _, k in top], float)
        all_words = max(1.0, float(sums.get((lang, "#all"), 0)))
        words.append(hasher(pa.array([w for w, _ in top], pa.string()))[0])
        shares.append(np.append(n / all_words, 1 - n.sum() / all_words))
    return Reference(languages, np.array(chars).reshape(len(languages), len(CLASSES) - 1), words, shares)


def divergences(column: pa.Array, chars: np.ndarray, own: Counter, ref: Reference) -> tuple[np.ndarray, np.ndarray]:
    """Distances of each text from the nearest language: characters, words."""
    word, _, _, ends = own.lower(column)
    rows, n = len(column), np.diff(ends)
    row = np.repeat(np.arange(rows), n)
    p = chars / np.maximum(chars.sum(1, keepdims=True), 1)
    by_char, by_word = np.ones((rows, len(ref.languages))), np.ones((rows, len(ref.languages)))
    for j in range(len(ref.languages)):
        by_char[:, j] = js_distance(p, ref.chars[j])
        order = np.argsort(ref.words[j])
        keys = ref.words[j][order]
        place = np.full(len(word), len(keys), np.int64)
        if len(keys):
            spot = np.searchsorted(keys, word).clip(max=len(keys) - 1)
            hit = keys[spot] == word
            place[hit] = order[spot[hit]]
        h = np.bincount(row * (len(keys) + 1) + place, minlength=rows * (len(keys) + 1))
        by_word[:, j] = js_distance(h.reshape(rows, -1) / np.maximum(n, 1)[:, None], ref.shares[j])
    if not ref.languages:
        return np.zeros(rows), np.zeros(rows)
    best = (by_char + by_word).argmin(1)
    return by_char[np.arange(rows), best], by_word[np.arange(rows), best]


def quality_rules(docs: DataFrame, ref: Reference, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, the base counts, base_failed, kept, char_distance, word_distance."""
    held = docs.sparkSession.sparkContext.broadcast(ref)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        own = Counter()
        for b in text_slices(batches):
            c = own.base(b.column("text"))
            far_char, far_word = divergences(b.column("text"), c["chars"], own, held.value)
            n, size = c["n_words"], c["chars"].sum(1)
            failed = (n < MIN_WORDS) | (100 * c["n_repeat_words"] > REPEAT_PERCENT * n)
            odd = (size >= CHAR_GUARD) & (far_char > CHAR_LIMIT + CHAR_SLACK / np.sqrt(np.maximum(size, 1)))
            odd |= (n >= WORD_GUARD) & (far_word > WORD_LIMIT + WORD_SLACK / np.sqrt(np.maximum(n, 1)))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), *[pa.array(c[x].astype(np.int64)) for x in names], pa.array(failed),
                 pa.array(~failed & ~odd), pa.array(far_char), pa.array(far_word)],
                names=["id", *names, "base_failed", "kept", "char_distance", "word_distance"])

    src = pick(docs, id=id_col, text=text_col)
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, " + ", ".join(f"{x} long" for x in names)
                          + ", base_failed boolean, kept boolean, char_distance double, word_distance double"
                          ).withColumnRenamed("id", id_col)
