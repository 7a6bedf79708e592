"""Line dedup, spelling variants and centroid clustering against brute force, and on awkward input."""

from __future__ import annotations

import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from patchtrace.llm import (centroids, exact_dedup, html_extract, language_id, line_dedup, ngram_join, quality_rules,
                            spelling)

BLANKS = " \t\n\x0b\x0c\r"
CLASH = ["id", "TEXT", "key", "n", "word", "part", "pos", "h1", "cluster", "v", "rank", "apex"]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def clash(df):
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH) if c not in df.columns])


def settings(spark, **conf):
    """The session with other settings, and the old ones."""
    old = {}
    for k, v in conf.items():
        key = "spark.sql." + k.replace("__", ".")
        old[key] = spark.conf.get(key)
        spark.conf.set(key, str(v))
    return old


@pytest.fixture(params=[1, 5, 23])
def parts(spark, request):
    """Small batches and many partitions, so that every run crosses an edge somewhere."""
    old = settings(spark, shuffle__partitions=request.param, adaptive__coalescePartitions__enabled="false",
                   execution__arrow__maxRecordsPerBatch=7)
    yield request.param
    for k, v in old.items():
        spark.conf.set(k, v)


# --- lines ---------------------------------------------------------------------------------

def brute_lines(rows, min_chars=40, min_docs=5):
    who = collections.defaultdict(set)

    def key(line):
        return lower(line.strip(BLANKS))

    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                who[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = []
        for line in lines:
            ids = who.get(key(line), ())
            if len(ids) < min_docs or i == max(ids, key=lambda x: (x is not None, x)):
                keep.append(line)
        out.append((i, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=str)


def line_rows():
    rng = random.Random(1)
    pool = [f" Line number {i} that is quite long indeed, É yes 😀 \t" for i in range(12)]
    pool += ["short", "", "x" * 39, "Y" * 40, "y" * 40 + "\r", "Z" * 3000]
    rows = []
    for i in range(160):
        text = "\n".join(rng.choice(pool) for _ in range(rng.randrange(30)))
        rows.append((rng.choice([i, i, i - 1, None if i % 17 == 0 else i]), None if i % 31 == 0 else text))
    rows += rows[:5]
    rows += [(1000 + i, "only the very same line, in very many documents\n" * (1 + i % 3)) for i in range(90)]
    return rows + [(5000, ""), (5001, None), (5002, "\n\n"), (5003, (pool[0] + "\n") * 20_000)]


def test_line_dedup_against_brute_force(spark, parts):
    rows = line_rows()
    df = clash(spark.createDataFrame(rows, "doc_id long, text string"))
    got = line_dedup.kept_lines(df, line_dedup.keep_bitmaps(df))
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256", "text"]
    found = got.collect()
    assert sorted([tuple(r)[:4] for r in found], key=str) == brute_lines(rows)
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 for r in found)


def test_line_dedup_bitmaps_are_small_and_only_of_losers(spark):
    rows = line_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bitmaps = line_dedup.keep_bitmaps(df).collect()
    losers = {r[:4] for r in brute_lines(rows) if r[2]}
    assert 0 < len(bitmaps) <= len(losers)  # equal rows share one
    assert all(len(b.keep) <= 12 + b.n_last / 4 for b in bitmaps)
    long = max(bitmaps, key=lambda b: b.n_last)
    assert len(zlib.decompress(long.keep)) == -(-long.n_last // 8)


def test_line_dedup_other_ids_limits_and_empty(spark):
    rows = [(f"d{i}", "a b\nC\n a B ") for i in range(4)]
    df = spark.createDataFrame(rows, "doc string, body string")
    names = {"id_col": "doc", "text_col": "body"}
    got = line_dedup.kept_lines(df, line_dedup.keep_bitmaps(df, min_chars=3, min_docs=4, **names), **names)
    assert sorted((r.doc, r.n_dropped, r.text) for r in got.collect()) == [
        ("d0", 2, "C"), ("d1", 2, "C"), ("d2", 2, "C"), ("d3", 0, "a b\nC\n a B ")]
    empty = df.where("false")
    assert line_dedup.kept_lines(empty, line_dedup.keep_bitmaps(empty, **names), **names).count() == 0


def test_bits_round_trip():
    rng = np.random.default_rng(3)
    for n in (1, 7, 8, 9, 1000):
        gone = np.flatnonzero(rng.random(n) < 0.4)
        gone = gone if len(gone) else np.array([n - 1])
        want = np.ones(gone.max() + 1, bool)
        want[gone] = False
        assert (line_dedup.unpack_bits(line_dedup.pack_bits(gone), len(want)) == want).all()


# --- words ---------------------------------------------------------------------------------

def brute_vocabulary(rows, min_chars=7, min_count=2):
    count = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= min_chars:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= min_count}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) < len(b):
        a, b = b, a
    return any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def brute_variants(vocab):
    out, form = {}, {}
    for w, n in vocab.items():
        close = [v for v in vocab if near(w, v)]
        best = min(close, key=lambda v: (-vocab[v], v), default=None)
        form[w] = best if best is not None and vocab[best] >= 10 * n else None
        out[w] = [w, form[w], None, n, len(close), vocab[form[w]] if form[w] else None]
    for w in out:
        end = w
        while form[end]:
            end = form[end]
        out[w][2] = end
    return sorted((tuple(r) for r in out.values()), key=str)


def word_rows():
    rng = random.Random(2)
    stems = ["aaaaaaa", "aaaaaab", "banana" * 2, "wörterbuch", "mississippi", "ÀÉÎÕÜßàÿ", "letterpress", "committee"]
    letters = "abmisé"
    rows = []
    for i in range(400):
        words = []
        for _ in range(rng.randrange(1, 25)):
            w = rng.choice(stems[:rng.randrange(1, len(stems) + 1)])
            for _ in range(rng.choice([0, 0, 0, 0, 1, 1, 2])):
                at = rng.randrange(len(w) + 1)
                w = rng.choice([w[:at] + rng.choice(letters) + w[at:], w[:at] + w[at + 1:],
                                w[:at] + rng.choice(letters) + w[at + 1:]])
            words.append(rng.choice([w, w, w.upper(), w.capitalize()]))
        rows.append((rng.choice([i, i, None]), None if i % 50 == 0 else rng.choice([" ", ",", "1", "\n"]).join(words)))
    return rows + rows[:30] + [(9000, ""), (9001, "x" * 5000 + " " + "x" * 5001), (9002, "x" * 5000 + " " + "x" * 5001),
                               (9003, "z" * 3000 + "q"), (9004, "z" * 3000 + "q z" + "z" * 2999)]


def test_spelling_variants_against_brute_force(spark, parts):
    rows = word_rows()
    df = clash(spark.createDataFrame(rows, "doc_id long, text string"))
    got = spelling.spelling_variants(df)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute_variants(brute_vocabulary(rows))
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert sum(r[1] is not None for r in want) > 20 and any(r[1] not in (None, r[2]) for r in want)


def test_spelling_variants_ties_and_empty(spark):
    text = " ".join(["abcdefg"] * 2 + ["abcdefh"] * 20 + ["abcdef"] * 30 + ["abcdefgg"] * 20 + ["abcdxfg"] * 20)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = {r.word: (r.form, r.n_near) for r in spelling.spelling_variants(df, damage=None).collect()}
    assert got == {"abcdefg": ("abcdefgg", 3), "abcdefh": (None, 1), "abcdefgg": (None, 1), "abcdxfg": (None, 1)}
    for rows in ([], [(1, None)], [(1, "only once")]):
        assert spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0


def test_trie_numbers_name_prefixes():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(200)})

    class End:
        def __init__(self, **k):
            self.__dict__.update(k)

    cuts = sorted(rng.sample(range(1, len(words)), 12))
    chunks = [words[i:j] for i, j in zip([0, *cuts], [*cuts, len(words)], strict=True)]
    ends, batches = [], []
    for k, chunk in enumerate(chunks):
        b = pa.RecordBatch.from_pydict({"word": chunk, "part": pa.array([k] * len(chunk), pa.int32())})
        batches.append(b)
        ends += [End(**r) for x in spelling._ends([b]) for r in x.to_pylist()]
    joined = spelling.join_ends(ends)

    class Held:
        value = joined

    node, ranks = {}, []
    for b in batches:
        for (word, _), rank, nodes in spelling._walk(Held, [b], 1):
            ranks.append(rank)
            for d, number in enumerate(nodes, 1):
                assert node.setdefault(word[:d], number) == number
            shared = max(len(os.path.commonprefix((word, o))) for o in words if o != word)
            assert len(nodes) == shared
    assert ranks == list(range(len(words))) and len(set(node.values())) == len(node)


# --- vectors -------------------------------------------------------------------------------

def brute_clusters(rows, dim=64, k=16, rounds=3):
    kept = []
    for i, x in rows:
        if x is not None and len(x) == dim and all(c is not None and abs(c) < 1 << 20 for c in x):
            kept.append((i, [int(np.floor(64 * float(np.float32(c)))) for c in x]))
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centers = [v for _, v in order[:k]]

    def place(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centers))

    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v in kept:
            groups[place(v)[1]].append(v)
        centers = [[sum(col) // len(groups[j]) for col in zip(*groups[j], strict=True)] if groups[j] else c
                   for j, c in enumerate(centers)]
    out = [(i, *place(v)[::-1]) for i, v in kept]
    inertia = collections.Counter()
    for _, c, d in out:
        inertia[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), sha[c]) for i, c, d in out), key=str)


def vector_rows(n=220, dim=64):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(6, dim))
    rows = [(int(i), (centers[i % 6] + rng.normal(size=dim) * 0.4).astype(np.float32).tolist()) for i in range(n)]
    rows += [rows[3], rows[3], (None, rows[5][1]), (7, rows[9][1]), (n, [0.0] * dim), (n + 1, rows[4][1])]
    bad = [None, [], [1.0] * (dim - 1), [1.0] * (dim + 1), [float("nan")] + [0.0] * (dim - 1),
           [float("inf")] + [0.0] * (dim - 1), [None] + [0.0] * (dim - 1), [3e30] + [0.0] * (dim - 1)]
    return rows + [(900 + i, x) for i, x in enumerate(bad)]


@pytest.mark.parametrize("n_pivots", [1, 4, 8, 16])
def test_clusters_against_brute_force(spark, n_pivots):
    rows = vector_rows()
    df = clash(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = centroids.cluster(df, n_pivots=n_pivots)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_clusters(rows)


@pytest.mark.parametrize("rows", [[], vector_rows()[-8:], [(i, [1.5] * 64) for i in range(20)],
                                  [(i, [float(i % 3)] * 64) for i in range(20)], [(None, [0.25] * 64)]])
def test_clusters_few_equal_or_no_vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted((tuple(r) for r in centroids.cluster(df).collect()), key=str) == brute_clusters(rows)


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(6)
    heart = rng.integers(-60, 60, (16, 64))
    points = heart[rng.integers(0, 16, 500)] + rng.integers(-12, 12, (500, 64))
    s = centroids.Simplex.build(heart, 8)
    low, high = centroids.bounds(s.apex(s.distances(points)), s.apex(s.distances(heart)))
    true = ((points[:, None, :] - heart[None]) ** 2).sum(2)
    assert (low <= true).all() and (true <= high).all()
    assert (low <= high.min(1, keepdims=True)).mean() < 0.5  # most centroids need no exact distance
    flat = centroids.Simplex.build(np.zeros((5, 64), np.int64), 8)
    assert len(flat.pivots) == 1


# --- earlier operators, mended -----------------------------------------------------------------

def test_keep_first_keeps_every_text_of_shuffled_wide_input(spark):
    """A shuffle whose partitions Spark merges differently for different columns."""
    rng = random.Random(7)
    rows = [(i, f"text {rng.randrange(1500)} of many", "w" * rng.randrange(400), i % 3) for i in range(3000)]
    rows += [(i, t, "again", n) for i, t, _, n in rows[:50]]
    old = settings(spark, adaptive__advisoryPartitionSizeInBytes="20000", shuffle__partitions=40,
                   adaptive__coalescePartitions__minPartitionSize="1")
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string, wide string, n long").repartition("doc_id")
        kept = exact_dedup.keep_first(df)
        got = kept.collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert kept.columns == df.columns
    plain = collections.defaultdict(list)
    for i, t, *_ in rows:
        plain["".join(t.split())].append((-len(t), i))
    assert sorted(r.doc_id for r in got) == sorted(min(x)[1] for x in plain.values())
    assert len({r.text for r in got}) == len(got) == len(plain)


def test_ids_of_other_types(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [("b", base), ("a", base + " tail"), ("c", base.replace(" ", "  ")), ("zz", base), (None, base), ("x", "other text")]
    df = spark.createDataFrame(rows, "name string, body string")
    names = {"id_col": "name", "text_col": "body"}
    found = {r.name: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df, **names).collect()}
    assert found == {"b": ("c", 4, False), "c": ("c", 4, True), "zz": ("c", 4, False), None: ("c", 4, False),
                     "a": ("a", 1, True), "x": ("x", 1, True)}
    assert {r.name for r in exact_dedup.keep_first(df, **names).collect()} == {"a", "c", "x"}
    near_ids = {r.name: r.component_id for r in ngram_join.ngram_join(df, **names).collect()}
    assert near_ids == {"a": "a", "b": "a", "c": "a", "zz": "a", "x": "x", None: None}


def test_formulas_and_drawings_are_text():
    own = html_extract.Extractor(html_extract.learn())
    page = ("<body><article><h1>Head</h1><p>The sum <math><mi>x</mi><mo>+</mo><mn>1</mn></math> is known to us all here.</p>"
            "<p>A <svg><text>drawn word</text></svg> and an <object>object's own words</object> stay.</p></article></body>")
    assert own.extract(page) == "Head The sum x+1 is known to us all here. A drawn word and an object's own words stay."


def test_language_vocabulary_is_whole_and_long_runs_train(spark):
    import public_tokenizers
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    plain = {sp.id_to_piece(i) for i in range(sp.get_piece_size())
             if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
    pieces = language_id.read_pieces(model)
    assert set(pieces) == {x for x in plain if x == x.lower()} and max(map(len, pieces)) > 9
    rows = [(i, "是不是这样的人们在这里" * 20 if i % 2 else "ここではそれをすることができます" * 20, "zh" if i % 2 else "ja") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fitted = language_id.fit(df, model, learn_from=lambda c: c >= 10)
    assert len(fitted.pieces) == len(pieces)
    assert {r.doc_id: r.lang_pred for r in language_id.identify(df, fitted).collect()} == {i: x for i, _, x in rows}


def test_reference_words_of_any_length_and_script(spark):
    rows = [(f"{'werden ' * 30} international {'привет ' * 9} a1", "x")] * 3 + [("one two " * 20, "y"), ("null words", None)]
    ref = quality_rules.references(spark.createDataFrame(rows, "text string, lang string"), common_words=2)
    hasher = quality_rules.WordHasher(lower=True)
    assert ref.languages == ["x", "y"]
    assert ref.words[0].tolist() == hasher(pa.array(["werden", "привет"]))[0].tolist()
    assert np.allclose(ref.shares[0], [30 / 41, 9 / 41, 2 / 41])
    assert np.allclose(ref.shares[1], [0.5, 0.5, 0.0])
