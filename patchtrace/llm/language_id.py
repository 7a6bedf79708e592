"""Language ID: unigram pieces summed over all segmentations.

The vocabulary is a fixed public one (a SentencePiece model file, a parameter); only the
piece probabilities of each language are learned here. A word's probability in a language
is the sum over all ways to cut it into pieces of the product of their probabilities,
computed by a forward pass over the word's positions. A text's log probability is the sum
over its words (pieces never cross ASCII white space), and Bayes' rule with equal priors gives
the predicted language and its posterior probability, the score.

Probabilities come from expectation maximisation: forward-backward passes over the word
counts of a bounded sample (about ``per_language`` documents of each language, drawn by a
hash of the id among all documents that may be learned from). The passes run in Spark
tasks; the driver sees one number per (language, piece), bounded by the vocabulary. Every
text is scored whole.

Defined results: text is lower-cased; a code point that no piece spells has one small
probability in every language; ``und`` with score 0 where the text is null, empty or has
no letter; ties go to the alphabetically first language; null languages are not learned
from; with nothing to learn from every text is ``und``; repeated rows get one result each.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchtrace.llm.common import (WORD_TABLE_LIMIT, KeyTable, WordHasher, pick, strings, text_slices,
                                   worker_cache, write_stage)

#: Documents of each language in the training sample (the documented bound).
PER_LANGUAGE = 1000
#: Probability of a code point outside the vocabulary.
UNKNOWN = 1e-7
#: Code points of a training word: longer runs (scripts without blanks) are cut into parts of this length.
TRAINING_PART = 64
MARK = "▁"
_LETTER = re.compile(r"[^\W\d_]")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 14


@dataclass
class UnigramModel:
    """Piece probabilities, one row per piece and one column per language."""

    languages: list[str]
    pieces: list[str]
    p: np.ndarray
    name: str = field(default_factory=lambda: uuid.uuid4().hex)


def read_pieces(model_file: str) -> list[str]:
    """The ordinary lower-case pieces of a SentencePiece model, of every length."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    plain = (sp.id_to_piece(i) for i in range(sp.get_piece_size())
             if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)))
    return sorted({x for x in plain if x == x.lower()})


class Lattice:
    """Finds the pieces at every position of many words at once."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces)
        by_length: dict[int, list[tuple[int, int]]] = {}
        for i, piece in enumerate(pieces):
            h = 0
            for c in piece:
                h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            by_length.setdefault(len(piece), []).append((h, i))
        self.tables = {}
        for k, rows in sorted(by_length.items()):
            rows.sort()
            self.tables[k] = (np.array([h for h, _ in rows], np.uint64), np.array([i for _, i in rows]))

    def chunks(self, words: list[str]):
        """Yield (word numbers, lengths, {k: piece ids [word, start]}) for words of like length.

        Id ``size`` means no piece; ``size + 1`` stands for an unknown single code point.
        """
        marked = [MARK + w for w in words]
        lengths = np.fromiter(map(len, marked), np.int64, len(marked))
        order = np.argsort(lengths, kind="stable")
        at = 0
        while at < len(order):
            # fewer words at a time where they are long, so that memory stays bounded
            stop = min(len(order), at + _CHUNK)
            while stop - at > 1 and (stop - at) * lengths[order[stop - 1]] > _CHUNK * 32:
                stop = at + max(1, (stop - at) // 2)
            rows = order[at:stop]
            at = stop
            n, width = lengths[rows], int(lengths[rows[-1]])
            flat = np.frombuffer("".join(marked[r] for r in rows).encode("utf-32-le"), np.uint32)
            text = np.zeros((len(rows), width), np.uint64)
            text[np.arange(width)[None, :] < n[:, None]] = flat.astype(np.uint64) + np.uint64(1)
            ids, h = {}, np.zeros_like(text)
            for k in range(1, min(width, max(self.tables)) + 1):
                m = width - k + 1
                h = h[:, :m] * _BASE + text[:, k - 1:]
                found = np.full((len(rows), m), self.size, np.int32)
                if k in self.tables:
                    keys, numbers = self.tables[k]
                    spot = np.searchsorted(keys, h.ravel()).clip(max=len(keys) - 1)
                    found = np.where(keys[spot] == h.ravel(), numbers[spot], self.size)
                    found = found.astype(np.int32).reshape(len(rows), m)
                found[np.arange(m)[None, :] + k > n[:, None]] = self.size
                if k == 1:
                    found[(found == self.size) & (np.arange(m)[None, :] < n[:, None])] = self.size + 1
                ids[k] = found
            yield rows, n, ids


def _with_extras(p: np.ndarray) -> np.ndarray:
    return np.vstack([p, np.zeros(p.shape[1]), np.full(p.shape[1], UNKNOWN)])


def forward(n: np.ndarray, ids: dict[int, np.ndarray], p: np.ndarray) -> np.ndarray:
    """Log probability of each word under each column of ``p`` (with its two extra rows)."""
    width, langs, longest = int(n[-1]), p.shape[1], max(ids)
    alpha = [np.ones((len(n), langs))]
    scale, out = np.zeros(len(n)), np.zeros((len(n), langs))
    for i in range(1, width + 1):
        now = np.zeros((len(n), langs))
        for k in range(1, min(i, longest) + 1):
            now += alpha[-k] * p[ids[k][:, i - k]]
        alpha.append(now)
        ends = n == i
        if ends.any():
            out[ends] = np.log(np.maximum(now[ends], 1e-300)) + scale[ends, None]
        if i % 8 == 0:
            top = np.maximum.reduce([a.max(1) for a in alpha[-longest:]])
            top = np.where(top > 0, top, 1.0)
            scale += np.log(top)
            alpha = [a / top[:, None] for a in alpha[-longest:]]
        else:
            alpha = alpha[-longest:]
    return out


def expected_counts(words: list[str], langs: np.ndarray, weight: np.ndarray, lattice: Lattice,
                    p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece by each language, over all segmentations of the words."""
    full = _with_extras(p)
    counts = np.zeros((lattice.size + 2) * p.shape[1])
    for rows, n, ids in lattice.chunks(words):
        own, w, width = langs[rows], weight[rows], int(n[-1])
        prob = {k: full[v, own[:, None]] for k, v in ids.items()}
        alpha = np.zeros((len(rows), width + 1))
        beta = np.zeros((len(rows), width + 1))
        alpha[:, 0] = 1
        for i in range(1, width + 1):
            for k in range(1, min(i, max(ids)) + 1):
                alpha[:, i] += alpha[:, i - k] * prob[k][:, i - k]
        beta[np.arange(len(rows)), n] = 1
        for i in range(width - 1, -1, -1):
            for k in range(1, min(width - i, max(ids)) + 1):
                beta[:, i] += prob[k][:, i] * beta[:, i + k]
        total = np.maximum(beta[:, 0], 1e-300)
        for k, found in ids.items():
            m = found.shape[1]
            use = alpha[:, :m] * prob[k] * beta[:, k:k + m] * (w / total)[:, None]
            counts += np.bincount((found * p.shape[1] + own[:, None]).ravel(), use.ravel(), len(counts))
    return counts.reshape(-1, p.shape[1])[:lattice.size]


def fit(docs: DataFrame, model_file: str, *, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang", learn_from=None, per_language: int = PER_LANGUAGE,
        rounds: int = 3) -> UnigramModel:
    """Learn piece probabilities from a bounded sample of the labelled documents.

    ``learn_from`` is a condition on the column ``id``; rows that fail it are never read for
    training. ``per_language`` bounds the sample in expectation (a hash threshold per language).
    """
    spark = docs.sparkSession
    known = pick(docs, id=id_col, text=text_col, lang=lang_col).where(
        "lang is not null and text is not null and text <> ''")
    if learn_from is not None:
        known = known.where(learn_from(F.col("id")))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return UnigramModel([], [], np.zeros((0, 0)))
    share = spark.createDataFrame(
        [(x, i, min(1.0, per_language / sizes[x])) for i, x in enumerate(languages)],
        "lang string, number int, share double")
    draw = F.pmod(F.xxhash64(F.col("id"), F.lit(21)), F.lit(1 << 30)) / float(1 << 30)
    words = (known.join(F.broadcast(share), "lang").where(draw < F.col("share"))
             .select("number", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"\\S{{1,{TRAINING_PART}}}"), F.lit(0)))
                     .alias("word"))
             .groupBy("number", "word").agg(F.count("*").alias("n")))
    words = write_stage(words)
    pieces = read_pieces(model_file)
    p = np.full((len(pieces), len(languages)), 1.0 / len(pieces))
    for _ in range(rounds):
        held = spark.sparkContext.broadcast((pieces, p))

        def count(batches, held=held):
            kept, prob = held.value
            lattice, total = Lattice(kept), np.zeros((len(kept), prob.shape[1]))
            for b in batches:
                total += expected_counts(b.column("word").to_pylist(), b.column("number").to_numpy(),
                                         b.column("n").to_numpy().astype(float), lattice, prob)
            spot, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(spot.astype(np.int32)), pa.array(lang.astype(np.int32)), pa.array(total[spot, lang])],
                names=["piece", "lang", "c"])

        got = (words.mapInArrow(count, "piece int, lang int, c double")
               .groupBy("piece", "lang").agg(F.sum("c").alias("c")).toPandas())
        c = np.zeros_like(p)
        c[got.piece.to_numpy(int), got.lang.to_numpy(int)] = got.c.to_numpy()
        # every piece keeps a share: smoothed by what all languages have in common, and evenly
        pooled = c.sum(1) / c.sum()
        floor = 0.5 * pooled + 0.5 / len(pieces)
        p = (c + 20.0 * floor[:, None]) / (c.sum(0) + 20.0)
    return UnigramModel(languages, pieces, p)


class Identifier:
    """Scores text columns; keeps the log probabilities of the words it has met in a bounded table."""

    def __init__(self, model: UnigramModel):
        self.model = model
        if model.languages:
            self.lattice, self.p = Lattice(model.pieces), _with_extras(model.p)
        self.hasher, self.known = WordHasher(lower=True), KeyTable(WORD_TABLE_LIMIT)
        self.fresh()

    def fresh(self):
        self.known.fresh()
        self.logs = np.zeros((1 << 14, len(self.model.languages)), np.float32)

    def words_scored(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.model.languages)))
        for rows, n, ids in self.lattice.chunks(words):
            out[rows] = forward(n, ids, self.p)
        return out

    def totals(self, column: pa.Array) -> np.ndarray:
        """Log probability of each text in each language."""
        if self.known.full:
            self.fresh()
        keys, starts, stops, ends = self.hasher(column)
        total = np.zeros((len(column), len(self.model.languages)))
        if len(keys):
            row, new = self.known.rows(keys)
            if len(new):
                text = self.hasher.data.tobytes()
                words = [text[a:b].decode("utf-8").lower()
                         for a, b in zip(starts[new].tolist(), stops[new].tolist(), strict=True)]
                last = len(self.known.keys)
                while last > len(self.logs):
                    self.logs = np.concatenate([self.logs, np.zeros_like(self.logs)])
                self.logs[last - len(new):last] = self.words_scored(words)
            some = np.flatnonzero(np.diff(ends))
            total[some] = np.add.reduceat(self.logs[row], ends[:-1][some], axis=0, dtype=np.float64)
        return total

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """The language and its posterior probability, for each text."""
        if not self.model.languages:
            return ["und"] * len(column), np.zeros(len(column))
        total = self.totals(column)
        post = np.exp(total - total.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
        best = post.argmax(1)
        lettered = np.array([bool(_LETTER.search(t)) for t in strings(column)], bool)
        score = np.where(lettered, post[np.arange(len(column)), best], 0.0)
        return [self.model.languages[b] if x else "und" for b, x in zip(best, lettered, strict=True)], score


def identifier(model: UnigramModel) -> Identifier:
    """The worker's identifier for this model; one model is held at a time."""
    cache = worker_cache()
    if cache.get("language", (None, None))[0] != model.name:
        cache["language"] = (model.name, Identifier(model))
    return cache["language"][1]


def identify(docs: DataFrame, model: UnigramModel, *, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """One row per document: id_col, lang_pred, score."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        judge = identifier(held.value)
        for part in text_slices(batches):
            lang, score = judge.predict(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(lang, pa.string()), pa.array(score)],
                names=["id", "lang_pred", "score"])

    src = pick(docs, id=id_col, text=text_col)
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: UnigramModel, *, text_col: str = "text",
                    least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (all its columns) whose language is known with a posterior of ``least``."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    plain = docs.toDF(*[f"_in{i}" for i in range(len(docs.columns))])

    def run(batches):
        judge = identifier(held.value)
        for part in text_slices(batches, f"_in{at}"):
            lang, score = judge.predict(part.column(at))
            keep = (np.array(lang) != "und") & (score >= least)
            yield part.filter(pa.array(keep, pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
