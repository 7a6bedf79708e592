"""Quality classifier: compressed sizes under a good and a bad zstandard dictionary.

Two raw-content dictionaries are filled from labelled good and bad texts. A text is
compressed with either one. The size difference is normalised in two ways, by the sizes
themselves, ``log(bad / good)``, and by the text's length, ``(bad - good) / sqrt(bytes)``;
the better ratio ``log(min(good, bad) / bytes)`` stands beside them, since text that
repeats itself shrinks under any dictionary. A logistic regression on the three, fitted on
labelled texts that filled neither dictionary, turns them into a calibrated score.

Training reads a bounded sample of labelled rows: at most about ``per_class`` rows of each
class. The sample is drawn by a hash of the id among all labelled rows, so it covers the
table evenly. Every second row may fill its dictionary, in hash order until it is full: texts
of up to ``PIECE`` characters whole, longer ones piece by piece in turns, from a hash-drawn
piece on. All other rows calibrate; their features come from whole texts and are computed in
tasks, so three numbers a row reach the driver. Every text is scored whole.

Defined results: a null text counts as empty; an empty text has no difference and
gets the calibrated score of three zeros; repeated rows are scored alike, one result each; labels that
are null or neither 0 nor 1 are not learned from; without labels of both classes every
score is the share of label 1 (0.5 without any label).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchtrace.llm.common import pick, strings, text_slices, write_stage

#: Sampled labelled rows of each class (the documented bound of training).
PER_CLASS = 2400
#: Bytes of each raw dictionary.
DICTIONARY_BYTES = 1 << 18
#: Characters of a text that go into a dictionary before the next text's turn.
PIECE = 1 << 12
LEVEL = 6


@dataclass(frozen=True)
class CompressionModel:
    """Both dictionaries and the calibration; a few hundred KB, whatever the corpus."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    level: int = LEVEL

    def scorer(self):
        return _Scorer(self)


class _Scorer:
    def __init__(self, model: CompressionModel):
        self.model = model
        self.sides = []
        for content in (model.good, model.bad):
            if content:
                held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                held.precompute_compress(level=model.level)
                self.sides.append(zstandard.ZstdCompressor(
                    dict_data=held, level=model.level, write_content_size=False,
                    write_checksum=False, write_dict_id=False))

    def features(self, text: str) -> tuple[float, float, float]:
        """Both normalised size differences and the better compression ratio (logarithms)."""
        data = text.encode("utf-8")
        if not data or len(self.sides) < 2:
            return 0.0, 0.0, 0.0
        good, bad = (len(side.compress(data)) for side in self.sides)
        return (math.log(bad / good), (bad - good) / math.sqrt(len(data)),
                math.log(min(good, bad) / len(data)))

    def score(self, text: str) -> float:
        logit = self.model.weights[0] + sum(
            w * f for w, f in zip(self.model.weights[1:], self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, logit))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, steps: int = 50) -> np.ndarray:
    """Newton's method for a logistic regression with a small ridge."""
    w = np.zeros(x.shape[1])
    keep = np.eye(x.shape[1]) * ridge
    keep[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _dictionary(pieces: list[bytes], size: int) -> bytes:
    """Raw dictionary content of one size: the pieces one after the other until it is full."""
    return b"".join(pieces)[:size]


def _turns(rows: list[tuple[int, int, int]], room: int) -> list[tuple[int, int]]:
    """(row, piece) in the order of filling, for rows (row, draw, characters) in hash order."""
    out, taken, turn, left = [], 0, 0, rows
    while left and taken < room:
        for row, draw, n in left:
            count = -(-n // PIECE)
            piece = (draw + turn) % count
            out.append((row, piece))
            taken += min(PIECE, n - piece * PIECE)
            if taken >= room:
                break
        turn += 1
        left = [r for r in left if turn < -(-r[2] // PIECE)]
    return out


def _features(rows: DataFrame, model: CompressionModel) -> np.ndarray:
    """The features and the label of each row, in an order of their own."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = held.value.scorer()
        for part in text_slices(batches):
            f = np.array([scorer.features(t) for t in strings(part.column("text"))], float)
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in f.T), part.column("y")], names=["a", "b", "c", "y"])

    got = (rows.select("text", F.col("y").cast("double").alias("y"))
           .mapInArrow(run, "a double, b double, c double, y double").toArrow())
    out = np.column_stack([got[c].to_numpy() for c in ("a", "b", "c", "y")])
    return out[np.lexsort(out.T)]


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", learn_from=None, per_class: int = PER_CLASS,
        dictionary_bytes: int = DICTIONARY_BYTES, level: int = LEVEL) -> CompressionModel:
    """Fit on a bounded sample of the labelled rows.

    ``learn_from`` is a condition on the column ``id`` that says which rows may be learned
    from. ``per_class`` bounds the sample (in expectation, by a hash threshold); its texts
    are read whole.
    """
    known = pick(labels, id=id_col, y=label_col).where("y in (0, 1) and id is not null")
    if learn_from is not None:
        known = known.where(learn_from(F.col("id")))
    known = known.groupBy("id").agg(F.max("y").alias("y"), F.min("y").alias("other")).where("y = other")
    count = {int(r["y"]): r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = {y: min(1.0, per_class / max(1, count.get(y, 0))) for y in (0, 1)}
    draw = F.pmod(F.xxhash64(F.col("id"), F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    sample = known.where(draw < F.when(F.col("y") == 1, share[1]).otherwise(share[0])).select("id", "y")
    # the sample is small by construction: it is broadcast, the texts are not shuffled
    rows = write_stage(pick(docs, id=id_col, text=text_col).join(F.broadcast(sample), "id")
                       .where("text is not null and text <> ''")
                       .select("id", "y", "text", F.monotonically_increasing_id().alias("row")))
    known_rows = rows.select("row", "y", F.xxhash64("id", F.lit(12)).alias("h"), F.length("text").alias("n"),
                             F.octet_length("text").alias("bytes"), "id", F.xxhash64("text").alias("t"))
    listed = sorted(known_rows.collect(), key=lambda r: (r["h"], r["id"], r["t"], r["row"]))
    part = {y: [r for r in listed if r["y"] == y] for y in (0, 1)}
    total = sum(count.values())
    base = (count.get(1, 0) + 0.5) / (total + 1) if total else 0.5
    flat = (math.log(base / (1 - base)), 0.0, 0.0, 0.0)
    if min(len(part[0]), len(part[1])) < 4:
        return CompressionModel(b"", b"", flat, level)
    # both dictionaries have one size, or the larger one would win on size alone
    room = min(dictionary_bytes, *(sum(r["bytes"] for r in part[y][::2]) for y in (0, 1)))
    turns = [(row, piece, y) for y in (0, 1)
             for row, piece in _turns([(r["row"], r["h"] & 0xFFFFF, r["n"]) for r in part[y][::2]], room)]
    plan = F.broadcast(docs.sparkSession.createDataFrame(
        [(row, piece * PIECE + 1, at) for at, (row, piece, _) in enumerate(turns)], "row long, start int, at int"))
    pieces = dict(map(tuple, rows.join(plan, "row").select("at", F.expr(f"substring(text, start, {PIECE})")).collect()))
    filling = {y: [pieces[at].encode("utf-8") + b"\n" for at, t in enumerate(turns) if t[2] == y] for y in (0, 1)}
    size = min(dictionary_bytes, *(sum(map(len, filling[y])) for y in (0, 1)))
    good, bad = (_dictionary(filling[y], size) for y in (1, 0))
    held = _features(rows.join(plan, "row", "left_anti"), CompressionModel(good, bad, flat, level))
    f, y = held[:, :3], held[:, 3]
    mid, wide = f.mean(0), np.maximum(f.std(0), 1e-9)
    w = _logistic(np.column_stack([np.ones(len(f)), (f - mid) / wide]), y)
    # the sample holds the classes in other shares than the table: put the true odds back
    w[0] += math.log(base / (1 - base)) - math.log(max(1.0, y.sum()) / max(1.0, (1 - y).sum()))
    slopes = w[1:] / wide
    weights = (float(w[0] - slopes @ mid), *map(float, slopes))
    return CompressionModel(good, bad, weights, level)


def score(docs: DataFrame, model: CompressionModel, *, id_col: str = "doc_id",
          text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per document: id_col, score (0 to 1), predicted (1 at or over the threshold)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = held.value.scorer()
        for part in text_slices(batches):
            s = np.array([scorer.score(t) for t in strings(part.column("text"))], float)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                names=["id", "score", "predicted"])

    src = pick(docs, id=id_col, text=text_col)
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: CompressionModel, *, text_col: str = "text",
              threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` (all its columns) whose score reaches the threshold."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        scorer = held.value.scorer()
        for batch in batches:
            keep = [scorer.score(t or "") >= threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    plain = docs.toDF(*[f"_in{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
