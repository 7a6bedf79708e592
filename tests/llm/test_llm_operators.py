"""The ten operators against brute force, and on awkward input."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
import textwrap
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from patchtrace.llm import (bpe_automaton, exact_dedup, html_extract, language_id, license_scan, ngram_join, packing,
                            quality_classifier, quality_rules, sharding)
from patchtrace.llm.common import KeyTable, WordHasher, drop_listed

WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
BYTE_FILE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_FILE = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, or that differ from real ones in case only.
CLASH = ["id", "TEXT", "score", "kept", "keep_id", "row_no", "k", "n", "slot", "_spot", "_in0", "shard"]


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def messy_rows():
    rng = random.Random(4)
    long = words(rng, 60_000, 100_000)
    base = words(rng, 120)
    rows = [(1, base), (2, base), (2, base), (3, base.replace(" ", "  ")), (4, base + " tail"), (5, None), (6, ""),
            (7, "  \n\t"), (8, long), (9, long + " end"), (None, base), (None, None), (10, "one two"),
            (11, "one  two"), (12, "ONE two"), (13, "ÉÈ ß 你好 😀"), (14, "a" * 5000), (15, "\x00\x1c\x85 x")]
    return [(i, t, None if i == 3 else "en", "s", len(t or "")) for i, t in rows]


@pytest.fixture(scope="module")
def messy(spark):
    df = spark.createDataFrame(messy_rows(), SCHEMA)
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)])


@pytest.fixture(scope="module")
def nothing(messy):
    return messy.where("false")


def test_word_hasher_finds_words_and_keeps_rows_apart():
    texts = ["a b", None, "", " x\ty\nz ", "abab", "ab", "a", "b", "A,", "end.", "long" * 900_000 + " b"]
    hasher = WordHasher()
    keys, starts, stops, ends = hasher(pa.array(texts, pa.string()).slice(0))
    found = [hasher.data[a:b].tobytes().decode() for a, b in zip(starts, stops, strict=True)]
    assert found == [w for t in texts for w in (t or "").encode().split() for w in [w.decode()]]
    assert np.diff(ends).tolist() == [len((t or "").split()) for t in texts]
    assert len(set(keys.tolist())) == len(set(found))
    lower = WordHasher(lower=True)(pa.array(["Ab", "aB"]))[0]
    assert lower[0] == lower[1]
    h = WordHasher(split_tail=True)
    _, a, b, e = h(pa.array(["end. x, 3. ...", "y."]))
    assert [h.data[i:j].tobytes() for i, j in zip(a, b, strict=True)] == [b"end", b".", b"x", b",", b"3.", b"...", b"y", b"."]
    assert e.tolist() == [0, 6, 8]


def test_key_table_numbers_new_keys_in_order():
    t, seen = KeyTable(10), {}
    for part in ([5, 3, 5, 9], [3, 2, 2, 9, 1], [7]):
        row, new = t.rows(np.array(part, np.uint64))
        for i in new:
            seen[part[i]] = len(seen)
        assert row.tolist() == [seen[x] for x in part]


# 1 ---------------------------------------------------------------------------------------
def test_html_extract_finds_the_article():
    own = html_extract.Extractor(html_extract.learn())
    for page, text in [
        ("", ""), ("plain words only", "plain words only"), ("<script>x", ""), ("<article>x<!-- open", "x"),
        ("<nav><a href=/>Home</a></nav><article><h1>T</h1><p>a&amp;b  c<br>d<p>e <b>f</b>g</article><footer>z</footer>",
         "T a&b c d e fg"),
        ("<body><div id=sidebar>s s s</div><div id='content'><p>one</p><div class=ad>buy</div><form>f</form><ul><li>l1<li>l2"
         "</ul></div><div class='comments'><p>c c c c c c c c</p></div>", "one l1 l2"),
        ("<article><p>1 2 3</p><aside>no no no no no no</aside><p>4</p></article>", "1 2 3 4"),
        ("<script>var t='</p>';</script><div><p>Real text that is long enough.</p><p>With <a href=x>a link</a>.</p></div>",
         "Real text that is long enough. With a link."),
    ]:
        assert own.extract(page) == text, page


def test_html_extract_deep_pages():
    own = html_extract.Extractor(html_extract.learn())
    page = html_extract.parse("<div>x <b>y" * 20_000 + "</b>" * 5 + "<p>z</p></i></div>w")
    assert len(page.parents) == 40_002 and len(page.holders(40_001)) == 39_993
    assert page.shared([40_000, 3]) == [0, 1, 2, 3] and page.end(3) == 40_001
    assert own.extract("<div>x <b>y</b>" * 20_000).split() == ["x", "y"] * 20_000
    for k in range(2, 9):  # siblings, inline parts and unclosed elements: each word keeps its own holders
        page = html_extract.parse("<ul>" + "<li>a<b>c</b>" * k + "</ul><p>d")
        assert [len(page.holders(p.at)) for p in page.pieces if not p.tag] == [3, 4] * k + [2]


def test_html_extract_on_the_pages(spark):
    from tests.conftest import SF_MID
    pages = spark.read.parquet(f"{SF_MID}/pages.parquet")
    got = {r["page_id"]: r for r in html_extract.extract_pages(pages).collect()}
    for r in pages.collect():  # plain reading of what the article element holds
        body = re.search(r"<article>(.*?)(</article>|$)", r["html"] or "", re.S)
        plain = re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", body[1])) if body else ""
        import html
        want = " ".join(html.unescape(plain).split())
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_html_extract_awkward(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, "<p>x</p>"), (3, "u", "<p>" + "word " * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = html_extract.extract_pages(df)
    assert sorted(r["n_chars"] for r in got.collect()) == [0, 0, 1, 499_999]
    assert html_extract.extract_pages(df.where("false")).count() == 0


# 2 ---------------------------------------------------------------------------------------
def brute_probability(word, pieces, p, unknown):
    """Sum over every segmentation, by recursion."""
    if not word:
        return 1.0
    total = sum(p[x] * brute_probability(word[len(x):], pieces, p, unknown) for x in pieces if word.startswith(x))
    if not any(x == word[0] for x in pieces):
        total += unknown * brute_probability(word[1:], pieces, p, unknown)
    return total


def test_forward_sums_all_segmentations_and_counts_are_their_mean():
    pieces = [language_id.MARK, language_id.MARK + "a", "a", "b", "ab", "ba", "aba"]
    rng = np.random.default_rng(1)
    p = rng.dirichlet(np.ones(len(pieces)), 2).T
    lattice = language_id.Lattice(pieces)
    todo = ["".join(w) for n in range(1, 7) for w in itertools.product("abx", repeat=n)]
    full = np.vstack([p, np.zeros(2), np.full(2, language_id.UNKNOWN)])
    for rows, n, ids in lattice.chunks(todo):
        got = language_id.forward(n, ids, full)
        for i, r in enumerate(rows):
            for lang in range(2):
                want = brute_probability(language_id.MARK + todo[r], pieces, dict(zip(pieces, p[:, lang], strict=True)),
                                         language_id.UNKNOWN)
                assert math.isclose(got[i, lang], math.log(want), rel_tol=1e-9)
    # the pieces used for "aab" cover its four code points, whatever the segmentation
    c = language_id.expected_counts(["aab"], np.array([0]), np.array([3.0]), lattice, p)
    assert math.isclose(sum(c[i, 0] * len(x) for i, x in enumerate(pieces)), 12.0, rel_tol=1e-9)


def test_language_id_held_out_accuracy_and_awkward(spark, messy, nothing):
    from tests.conftest import SF_MID
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    model = language_id.fit(docs, PIECE_FILE, learn_from=lambda c: c % 4 != 0, rounds=2)
    got = language_id.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("doc_id % 4 = 0")
    assert got.where("lang = lang_pred").count() >= 0.98 * got.where("lang is not null").count()
    rows = language_id.identify(messy, model).collect()
    assert len(rows) == len(messy_rows())
    for r, (_, t, *_) in zip(rows, messy_rows(), strict=True):
        assert 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", t or ""))
    kept = language_id.keep_identified(messy, model, least=0.0)
    assert kept.columns == messy.columns
    assert kept.count() == sum(bool(re.search(r"[^\W\d_]", t or "")) for _, t, *_ in messy_rows())
    none = language_id.fit(nothing, PIECE_FILE)
    assert {r["lang_pred"] for r in language_id.identify(messy, none).collect()} == {"und"}
    assert language_id.identify(nothing, model).count() == 0


# 3 ---------------------------------------------------------------------------------------
def test_fingerprints_compose():
    rng = random.Random(2)
    texts = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 7, 8, 9, 64, 1000)]
    plain = exact_dedup.Fingerprinter(4096).texts(texts)
    assert (exact_dedup.Fingerprinter(8).texts(texts) == plain).all()
    for (p, r), shift in zip(exact_dedup.MODULI, (31, 0), strict=True):
        for t, fp in zip(texts, plain, strict=True):
            h = 0
            for b in t:
                h = (h * r + b + 1) % p
            assert h == (int(fp) >> shift) & ((1 << 31) - 1)


def test_fingerprint_parts_equal_whole_texts(spark):
    rng = random.Random(3)
    whole = {i: words(rng, 40 * i) for i in range(5)}
    parts = [(i, k, t[a:a + 37]) for i, t in whole.items() for k, a in enumerate(range(0, max(1, len(t)), 37))]
    rng.shuffle(parts)
    got = exact_dedup.fingerprint_parts(spark.createDataFrame(parts, "doc_id long, part int, text string"), chunk=16)
    own = exact_dedup.Fingerprinter()
    for r in got.collect():
        t = exact_dedup.normalise(whole[r["doc_id"]])
        assert (r["n_bytes"], r["fp"]) == (len(t), int(own.texts([t])[0]))


@pytest.mark.parametrize("moduli", [exact_dedup.MODULI, ((3, 2), (2, 1))])
def test_exact_dedup_is_exact_even_when_fingerprints_collide(spark, messy, nothing, moduli):
    rows = messy_rows()
    rng = random.Random(1)
    rows += [(100 + i, "".join(rng.choice("ab ") for _ in range(4)), "en", "s", 4) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    df = df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)])
    got = exact_dedup.exact_dedup(df, chunk=8, moduli=moduli).collect()
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[exact_dedup.normalise(t or "")].append((-len(t or ""), i is None, i or 0, i))
    assert len(got) == len(rows)
    by = collections.Counter()
    for r, (i, t, *_) in zip(sorted(got, key=lambda r: r["row_no"]), rows, strict=True):
        key = exact_dedup.normalise(t or "")
        assert (r["doc_id"], r["keep_id"], r["group_size"]) == (i, min(groups[key])[3], len(groups[key]))
        assert r["text_sha256"] == hashlib.sha256(key).hexdigest()
        by[key] += r["kept"]
    assert set(by.values()) == {1}
    assert exact_dedup.keep_first(df).count() == len(groups) and exact_dedup.keep_first(df).columns == df.columns
    assert exact_dedup.exact_dedup(nothing).count() == 0 and exact_dedup.keep_first(nothing).count() == 0


# 4 ---------------------------------------------------------------------------------------
def test_quality_classifier_tells_held_out_labels(spark, messy, nothing):
    rng = random.Random(6)
    good = [(i, words(rng, 80), 1) for i in range(300)]
    bad = [(300 + i, " ".join(w + rng.choice(["***", "$$$"]) for w in words(rng, 80).split()), 0) for i in range(100)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in good + bad] + [(None, 1), (1, None)], "doc_id long, quality int")
    model = quality_classifier.fit(docs, labels, learn_from=lambda c: c % 5 != 0)
    got = quality_classifier.score(docs, model).where("doc_id % 5 = 0").collect()
    assert np.mean([r["predicted"] == (r["doc_id"] < 300) for r in got]) > 0.97
    rows = quality_classifier.score(messy, model).collect()
    assert len(rows) == len(messy_rows()) and all(0 <= r["score"] <= 1 for r in rows)
    empty = {r["score"] for r, (_, t, *_) in zip(rows, messy_rows(), strict=True) if not t}
    assert len(empty) == 1
    kept = quality_classifier.keep_good(messy, model)
    assert kept.columns == messy.columns and kept.count() == sum(r["predicted"] for r in rows)
    blank = quality_classifier.fit(nothing, labels.where("false"))
    assert {r["score"] for r in quality_classifier.score(messy, blank).collect()} == {0.5}
    assert quality_classifier.score(nothing, model).count() == 0


def test_dictionaries_share_their_room_evenly():
    texts = [b"a" * 10, b"b" * 100, b"c" * 1000]
    out = quality_classifier._dictionary(texts, 300)
    assert len(out) == 300 and out.count(b"a") == 10 and out.count(b"b") == 100 and out.count(b"c") == 190


def test_quality_classifier_learns_from_whole_texts(spark):
    # what tells the classes apart stands behind an opening longer than an even share of the room
    rng = random.Random(8)

    def text(y, n):
        own = [f"{'good' if y else 'evil'}{k * 7919 % 1000}" for k in range(40)]
        return f"{rng.getrandbits(4 * n):0{n}x} " + " ".join(rng.choice(own) for _ in range(60))

    rows = [(i, text(i % 2, 40_000 if i % 50 in (2, 3) else 600), i % 2) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(3)
    model = quality_classifier.fit(docs.drop("quality"), docs.drop("text"), learn_from=lambda c: c % 10 > 1,
                                   dictionary_bytes=1 << 15)
    assert len(model.good) == len(model.bad) == 1 << 15 and b" good" in model.good and b" evil" in model.bad
    got = quality_classifier.score(docs, model, threshold=0.5).where("doc_id % 10 < 2").collect()
    assert len(got) == 80 and np.mean([r["predicted"] == r["doc_id"] % 2 for r in got]) > 0.95


def test_pieces_take_turns_and_cover_whole_texts():
    size = quality_classifier.PIECE
    rows = [(7, 5, 10), (8, 4, 2 * size + 1), (9, 0, size)]
    assert quality_classifier._turns(rows, 10 * size) == [(7, 0), (8, 1), (9, 0), (8, 2), (8, 0)]
    assert quality_classifier._turns(rows, 11) == [(7, 0), (8, 1)] and quality_classifier._turns([], 5) == []


# 5 ---------------------------------------------------------------------------------------
def test_lookup_table_is_filled_in_turns_and_moves_little():
    names = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(names, 101)
    # the definition, slot by slot
    order = [[(sharding._hash("offset " + s) % 101 + j * (sharding._hash("skip " + s) % 100 + 1)) % 101
              for j in range(101)] for s in names]
    want, turn = {}, itertools.cycle(range(7))
    while len(want) < 101:
        i = next(turn)
        want[next(x for x in order[i] if x not in want)] = i
    assert table.tolist() == [want[x] for x in range(101)]
    big = sharding.lookup_table(names)
    assert np.ptp(np.bincount(big)) <= 1
    less = sharding.lookup_table(names[:-1])
    assert (big[big < 6] != less[big < 6]).mean() < 0.1
    for wrong in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(wrong)
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 100)


def test_place_awkward(spark, messy, nothing, tmpdir_path):
    names = ["x", "y", "z"]
    got = sharding.place(messy, names).collect()
    table = sharding.lookup_table(names)
    assert len(got) == len(messy_rows())
    want = collections.Counter()
    for i, t, *_ in messy_rows():
        slot = sharding._hash(str(i) if i is not None else hashlib.md5((t or "").encode()).hexdigest()) % sharding.SLOTS
        want[i, slot, int(table[slot])] += 1
    assert collections.Counter((r["doc_id"], r["slot"], r["shard"]) for r in got) == want
    assert sharding.place(nothing, names).count() == 0
    plain = spark.createDataFrame(messy_rows(), SCHEMA)
    sharding.write_shards(plain, tmpdir_path + "/out", names)
    assert spark.read.parquet(tmpdir_path + "/out").count() == len(messy_rows())


# 6 ---------------------------------------------------------------------------------------
def test_tournament_tree_is_first_fit_decreasing():
    rng = random.Random(5)
    for _ in range(30):
        sizes = [rng.randint(1, 100) for _ in range(rng.randint(0, 60))]
        want: list[list[int]] = []
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            for b in want:
                if sum(sizes[j] for j in b) + sizes[i] <= 100:
                    b.append(i)
                    break
            else:
                want.append([i])
        assert packing.first_fit_decreasing(sizes, 100) == want


def test_pack_holds_every_token_once():
    rng = random.Random(8)
    for _ in range(50):
        sizes = [rng.randint(1, 300) for _ in range(rng.randint(0, 40))]
        out = packing.pack(sizes, 64)
        seen = collections.Counter((d, s + k) for q in out for d, s, n in q for k in range(n))
        assert seen == collections.Counter((d, k) for d, n in enumerate(sizes) for k in range(n))
        for q in out:
            n = sum(p[2] for p in q)
            assert n == 64 or n & (n - 1) == 0


def test_packing_ids_and_awkward(spark, messy, nothing):
    own = Tokenizer.from_file(WORD_FILE)
    rows = messy_rows() + [(50, "<|endoftext|> A<|ENDOFTEXT|>b, the.", "en", "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)])
    got = packing.pack_documents(df, WORD_FILE, group_tokens=1 << 14).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append(r)
    for q in by.values():
        at = 0
        for r in sorted(q, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    want = collections.Counter()
    for i, t, *_ in rows:
        ids = own.encode(t or "", add_special_tokens=False).ids + [1]
        want[i] += len(ids)
        mine = {(r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == i and r["doc_tokens"] == len(ids)}
        for s, n, crc in mine:
            if i not in (None, 2):
                assert zlib.crc32(np.array(ids[s:s + n], "<u4").tobytes()) == crc
    have = collections.Counter()
    for r in got:
        have[r["doc_id"]] += r["length"]
    assert have == want
    assert packing.pack_documents(nothing, WORD_FILE).count() == 0


# 7 ---------------------------------------------------------------------------------------
def test_license_scan_finds_notices_and_only_these(spark, messy, nothing):
    own = license_scan.Scanner()
    for name, (wording, _) in license_scan.TEMPLATES.items():
        text = "Some words before.\n" + wording + "\nand after it."
        m = own.scan(text)
        assert [(x.license, text[x.start:x.stop], x.missing, x.added) for x in m] == [(name, wording, 0, 0)], name
        wrapped = re.sub(r"((?:\S+ ){7})", r"\1\n", wording)
        if wrapped.count("\n") > 1:
            assert [x.license for x in own.scan("a b\n" + wrapped + "\nz z")] == [name]
    assert own.scan("My driving licence was renewed. The copyright office is closed.") == []
    assert own.scan("This work is licensed under the GNU General Public License, version 4.") == []
    got = license_scan.scan_documents(messy)
    assert got.count() == 0 and license_scan.scan_documents(nothing).count() == 0
    from tests.conftest import SF_MID
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    hits = license_scan.scan_documents(docs).collect()
    text = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    short = {w: n for n, (w, _) in license_scan.TEMPLATES.items()}
    want = {(i, short[line]) for i, t in text.items() for line in (t or "").split("\n") if line in short}
    assert {(r["doc_id"], r["license"]) for r in hits if r["exact"]} == want and want


@pytest.mark.parametrize("width", range(15, 101, 5))
def test_license_scan_at_any_width(width):
    own = license_scan.Scanner()
    for name, (wording, _) in (license_scan.TEMPLATES | license_scan.TAGS).items():
        lines = textwrap.fill(wording, width, break_long_words=False, break_on_hyphens=False)
        text = f"Prose before it.\n{lines}\nprose behind it"
        (m,) = own.scan(text)
        assert (m.license, m.missing) == (name, 0) and text[m.start:m.stop].startswith(lines[:15]), name
        marked = "\n".join("# " + x for x in lines.split("\n"))
        assert [(x.license, x.missing) for x in own.scan(marked)] == [(name, 0)], name


def best_alignment(own, template):
    """Greatest gain, by trying every stretch: three for each word in order, less the stretch's length."""
    best = 0
    for a in range(len(own)):
        row = [0] * (len(template) + 1)
        for b in range(a, len(own)):
            new = [0]
            for i, w in enumerate(template):
                new.append(max(new[i], row[i + 1], row[i] + (w == own[b])))
            row = new
            best = max(best, 3 * row[-1] - (b + 1 - a))
    return best


def test_license_scan_alignment_against_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        template = [rng.choice("abcde") for _ in range(rng.randint(1, 7))]
        own = [rng.choice("abcdefg") for _ in range(rng.randint(1, 16))]
        scanner = license_scan.Scanner({"T": (" ".join(template), ())})
        found = scanner.alignments(own, "T")
        for first, last, same in found:
            row = [0] * (len(template) + 1)
            for w in own[first:last + 1]:
                row = [0, *itertools.accumulate((max(row[i + 1], row[i] + (t == w)) for i, t in enumerate(template)), max)]
            assert row[-1] == same >= 0.8 * len(template)
        want = best_alignment(own, template)
        if want > 3 * 0.8 * len(template):  # so many words that it must hold enough of the template
            assert max(3 * same - (last + 1 - first) for first, last, same in found) == want


def test_license_scan_many_notices_and_cues():
    own = license_scan.Scanner()
    text = " ".join(["A license, a warranty and a copyright.", "Released under the MIT License."] * 3000)
    assert [(m.license, m.missing, m.added) for m in own.scan(text)] == [("MIT", 0, 0)] * 3000


@pytest.mark.parametrize("prose", [40, 200, 900, 5000])
def test_license_scan_whatever_stands_around(prose):
    own, rng = license_scan.Scanner(), random.Random(3)
    plain = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(prose))[:prose]
    for name, (wording, _) in license_scan.TEMPLATES.items():
        # the sentences of the same line are no part of the notice
        (m,) = own.scan(f"{plain}. {wording} {plain}.")
        assert (m.license, m.missing, m.added) == (name, 0, 0), name
        # without a sentence end the whole line is the block, and the prose is added words
        (m,) = own.scan(f"{plain} the {wording.rstrip('.')} and {plain}")
        assert m.license == name and m.missing <= 0.2 * len(own.words[name]) and m.added > 0, name
        # prose with a cue word takes nothing from the notice behind it
        found = own.scan(f"{plain} has a license. {wording} {plain}")
        assert [(x.license, x.missing, x.added) for x in found] == [(name, 0, 0)], name
    both = own.scan(f"{plain}. All rights reserved. Released under the MIT License. {plain}")
    assert [(x.license, x.missing, x.added) for x in both] == [("All-Rights-Reserved", 0, 0), ("MIT", 0, 0)]
    assert own.scan(f"{plain} a license with the {plain} and all {plain} released rights mit {plain} reserved") == []


# 8 ---------------------------------------------------------------------------------------
def brute_components(rows, num=75, den=100):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append((i, {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if i is not None and j is not None and a and den * len(a & b) >= num * len(a | b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return [(i, len(s), None if i is None and s else i if not s else find(i)) for i, s in sets]


@pytest.mark.parametrize("options", [{}, {"list_limit": 2}, {"counters": 1 << 16, "list_limit": 5}])
def test_ngram_join_against_all_pairs(spark, options):
    rng = random.Random(9)
    rows, shared = [], words(rng, 30)
    for g in range(25):
        base = words(rng, rng.randint(8, 70)).split()
        for _ in range(rng.randint(1, 14)):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = f"v{rng.randrange(5000)}"
            if rng.random() < 0.3:
                own = own[:rng.randint(3, len(own))]
            if rng.random() < 0.3:
                own += shared.split()
            rows.append((len(rows), " ".join(own)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(map(tuple, ngram_join.ngram_join(df, **options).collect()))
    assert got == sorted(brute_components(rows))


@pytest.mark.parametrize("options", [{}, {"list_limit": 2}])
def test_ngram_links_are_all_links(spark, options):
    rng = random.Random(12)
    rows = []
    for g in range(8):  # clusters whose members are mostly linked with each other, not just with one leader
        base = words(rng, 60).split()
        for _ in range(10):
            own = list(base)
            own[rng.randrange(len(own))] = f"v{rng.randrange(5000)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows) + i, t) for i, (_, t) in enumerate(rng.sample(rows, 15))] + [(500, ""), (501, None)]
    sets = {i: frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) for i, t in rows for w in [(t or "").split()]}
    rep = {s: min(i for i in sets if sets[i] == s) for s in sets.values() if s}
    linked = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
    want = {(*sorted((rep[a], rep[b])), len(a & b)) for a, b in itertools.combinations(rep, 2) if linked(a, b)}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    links, members = ngram_join.ngram_links(df, **options)
    got = [(r["rep"], r["rep2"], r["overlap"]) for r in links.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > len(rep)
    assert {(r["doc_id"], r["rep"]) for r in members.collect()} == {(i, rep[s]) for i, s in sets.items() if s}
    counts = {r["doc_id"]: r["n_links"] for r in ngram_join.link_counts(df, **options).collect()}
    assert counts == {i: sum(linked(s, t) for j, t in sets.items() if j != i and t) for i, s in sets.items() if s}


def test_ngram_join_awkward(spark, messy, nothing):
    got = collections.Counter(map(tuple, ngram_join.ngram_join(messy).collect()))
    assert got == collections.Counter(brute_components([(i, t) for i, t, *_ in messy_rows()]))
    kept = ngram_join.keep_smallest(messy)
    assert kept.columns == messy.columns
    want = [r for r in brute_components([(i, t) for i, t, *_ in messy_rows()]) if r[2] is None or r[0] == r[2]]
    assert kept.count() == len(want)
    assert ngram_join.ngram_join(nothing).count() == 0 and ngram_join.keep_smallest(nothing).count() == 0


def test_components_on_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201)]
    got = dict(map(tuple, ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}


# 9 ---------------------------------------------------------------------------------------
def plain_bpe(word, merges):
    """Every merge in order, everywhere, left to right."""
    out = list(word)
    for a, b in merges:
        new, i = [], 0
        while i < len(out):
            if i + 1 < len(out) and (out[i], out[i + 1]) == (a, b):
                new.append(a + b)
                i += 2
            else:
                new.append(out[i])
                i += 1
        out = new
    return out


def test_automaton_accepts_exactly_the_merged_sequences():
    rng = random.Random(11)
    for _ in range(25):
        tokens, merges = ["a", "b", "c"], []
        while len(merges) < 9:
            a, b = rng.choice(tokens), rng.choice(tokens)
            if a + b not in tokens:
                tokens.append(a + b)
                merges.append((a, b))
        number = {t: i for i, t in enumerate(tokens)}
        own = bpe_automaton.MergeAutomaton([t.encode() for t in tokens], {97: 0, 98: 1, 99: 2},
                                           [(number[a], number[b], number[a + b]) for a, b in merges])
        for n in range(1, 7):
            for w in map("".join, itertools.product("abc", repeat=n)):
                want = [number[t] for t in plain_bpe(w, merges)]
                assert own.encode(w.encode()) == want
                assert own.decode(want) == w.encode()
                # no other sequence of tokens that spells the word is accepted
                if n <= 4:
                    assert len(list(accepted(own, w.encode(), 0))) == 1


def accepted(own, rest, state):
    if not rest:
        yield ()
    for label, token in own.ids.items():
        if rest.startswith(label) and own.step(state, token):
            for more in accepted(own, rest[len(label):], own.target[token]):
                yield (token, *more)


def test_bpe_equals_the_library(spark, messy, nothing):
    lib = Tokenizer.from_file(BYTE_FILE)
    rng = random.Random(12)
    bits = ["a", "B", " ", "  ", "\n", "\t", "'s", "'ll", "1", "é", "ß", "你好", "😀", " ", " ", "\x1c", "\x85",
            "<|endoftext|>", "the.", " The,", "!!", "\r\n", "​", "\x00"]
    rows = messy_rows() + [(1000 + i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 30))), "en", "s", 0)
                           for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)])
    got = collections.Counter(map(tuple, bpe_automaton.digests(df, BYTE_FILE, public_tokenizers.PATTERN).collect()))
    want = collections.Counter()
    for i, t, *_ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
             hashlib.sha256(text.encode()).hexdigest()] += 1
    assert got == want
    back = bpe_automaton.encode_documents(df, BYTE_FILE, public_tokenizers.PATTERN).collect()
    assert [r["decoded"] for r in back] == [t or "" for _, t, *_ in rows]
    assert bpe_automaton.digests(nothing, BYTE_FILE, public_tokenizers.PATTERN).count() == 0


# 10 --------------------------------------------------------------------------------------
def plain_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    runs = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    hit = {i + k for i in range(len(w) - 4) if runs[tuple(w[i:i + 5])] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit),
            len(w) < 10 or 100 * len(hit) > 20 * len(w))


def test_quality_rules_counts_and_verdict(spark, messy, nothing):
    rng = random.Random(13)
    base = words(rng, 12)
    more = [base + "\n" + base, "\n".join(["x y z"] * 9), "a b c d e a b c d e f", "#" * 40 + " <b>", base * 3 + "  é\n\n"]
    rows = messy_rows() + [(60 + i, t, "en", "s", 0) for i, t in enumerate(more)]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)])
    got = quality_rules.quality_rules(df, quality_rules.references(df)).collect()
    for r, (i, t, *_) in zip(got, rows, strict=True):
        assert tuple(r)[:7] == (i, *plain_counts(t or ""))
        assert not (r["base_failed"] and r["kept"])
    none = quality_rules.references(nothing)
    assert none.languages == []
    assert all(r["kept"] != r["base_failed"] for r in quality_rules.quality_rules(df, none).collect())
    assert quality_rules.quality_rules(nothing, none).count() == 0


def test_js_distance_is_the_definition():
    p, q = np.array([[0.5, 0.5, 0.0], [0.0, 0.0, 1.0]]), np.array([0.25, 0.25, 0.5])

    def kl(a, b):
        return sum(x * math.log2(x / y) for x, y in zip(a, b, strict=True) if x)

    for row, d in zip(p, quality_rules.js_distance(p, q), strict=True):
        m = (row + q) / 2
        assert math.isclose(d, math.sqrt((kl(row, m) + kl(q, m)) / 2))
    assert quality_rules.js_distance(np.array([[1.0, 0.0]]), np.array([0.0, 1.0]))[0] == 1


def test_quality_rules_tell_labels(spark):
    from tests.conftest import SF_MID
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    got = quality_rules.quality_rules(docs, quality_rules.references(docs))
    seen = got.join(spark.read.parquet(f"{SF_MID}/labels.parquet"), "doc_id").where("not base_failed").toPandas()
    assert seen[seen.quality == 1].kept.mean() > 0.98
    assert seen[seen.quality == 0].kept.mean() < 0.3


def test_drop_listed_drops_exactly_these(spark):
    rows = spark.range(1000).withColumnRenamed("id", "key")
    left = drop_listed(rows, spark.range(0, 1000, 7).withColumnRenamed("id", "key"), "key")
    assert sorted(r["key"] for r in left.collect()) == [i for i in range(1000) if i % 7]
