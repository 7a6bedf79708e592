"""Windows of subword ids against a plain loop over the library's ids."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from patchtrace.operators import subword

FILE = public_tokenizers.path("byte_bpe_50k.json")
ITEMS = "path string, n int, text string"


def _plain(texts, window=512, stride=256, bos=None, eos=None):
    """(path, number, start, end, ids) by the loop that the rule describes."""
    own = Tokenizer.from_file(FILE)
    out = []
    for path, _, t in texts:
        ids = ([bos] if bos is not None else []) + own.encode(t or "", add_special_tokens=False).ids + ([eos] if eos is not None else [])
        no = 0
        for start in range(0, max(1, len(ids)), stride):
            part = ids[start:start + window]
            if len(part) >= 2:
                out.append((path, no, start, start + len(part), part))
                no += 1
            if start + window >= len(ids):
                break
    return sorted(out)


def _rows():
    rng = random.Random(3)
    word = ["int", "return", "foo_bar", "é", "你好", "😀", "{", "}", "\n", "  ", "0x1F", "<|endoftext|>"]
    rows = [(f"f{i}", i, " ".join(rng.choice(word) for _ in range(rng.choice([0, 1, 2, 5, 300, 900])))) for i in range(60)]
    # one id a letter and blank: lengths around the window's edges
    rows += [(f"e{n}", n, " a" * n) for n in (1, 2, 511, 512, 513, 767, 768, 769, 1024, 1025)]
    return rows + [("null", None, None), ("empty", 0, ""), ("long", 1, "x = y; " * 60_000), ("f0", 0, "same key twice")]


RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("special", [{}, {"bos": 7, "eos": 50256}])
@pytest.mark.parametrize("make", [lambda **k: subword.file_tokenizer(FILE, **k),
                                  lambda **k: subword.rank_tokenizer(RANKS, public_tokenizers.PATTERN, **k)])
def test_windows_equal_a_plain_loop(spark, special, make):
    rows = [r for r in _rows() if "<|" not in (r[2] or "")]
    df = spark.createDataFrame(rows, ITEMS).withColumn("start", F.lit("clash")).withColumn("ids", F.lit(1)).repartition(3)
    got = subword.subword_windows(df, ["path"], make(**special))
    assert got.columns == ["path", "win_no", "start", "end", "ids"]
    assert sorted((r.path, r.win_no, r.start, r.end, list(r.ids)) for r in got.collect()) == _plain(rows, **special)


def test_special_strings_are_ordinary_text(spark):
    df = spark.createDataFrame([("a", 0, "x<|endoftext|>y")], ITEMS)
    (row,) = subword.subword_windows(df, ["path"], subword.file_tokenizer(FILE)).collect()
    assert 50256 not in row.ids and len(row.ids) > 4


def test_window_offsets():
    lengths = np.array([0, 1, 2, 4, 5, 6, 7])
    row, number, start, end = subword.window_offsets(lengths, window=4, stride=2)
    got = list(zip(row.tolist(), number.tolist(), start.tolist(), end.tolist(), strict=True))
    assert got == [(2, 0, 0, 2), (3, 0, 0, 4), (4, 0, 0, 4), (4, 1, 2, 5), (5, 0, 0, 4), (5, 1, 2, 6),
                   (6, 0, 0, 4), (6, 1, 2, 6), (6, 2, 4, 7)]
    with pytest.raises(ValueError):
        subword.subword_windows(None, [], None, stride=0)


def test_a_model_receives_ids(spark):
    """A stand-in model: the first id, the last id and the length."""
    def make():
        def encode(ids):
            assert all(x.dtype == np.int32 for x in ids) and len(ids) <= 4
            return np.array([[x[0], x[-1], len(x)] for x in ids], float)
        return encode

    rows = [r for r in _rows() if "<|" not in (r[2] or "") and r[0] != "f0"]
    df = spark.createDataFrame(rows, ITEMS)
    item = subword.subword_encoder(subword.file_tokenizer(FILE, bos=1, eos=2), subword.id_encoder(make, batch_size=4))
    got = {r.path: list(r.embedding) for r in item(df, ["path"]).collect()}
    want = {}
    for path, _, _, _, ids in _plain(rows, bos=1, eos=2):
        want.setdefault(path, []).append([ids[0], ids[-1], len(ids)])
    assert set(got) == set(want)
    assert all(np.allclose(got[p], np.mean(want[p], axis=0)) for p in want)
    assert got["empty"] == [1.0, 2.0, 2.0]


def test_empty_table(spark):
    df = spark.createDataFrame([], ITEMS)
    assert subword.subword_windows(df, ["path", "n"], subword.file_tokenizer(FILE)).count() == 0
