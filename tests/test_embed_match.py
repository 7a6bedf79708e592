import numpy as np
import pytest
from pyspark.sql import functions as F

from patchtrace.operators import embed as E
from patchtrace.operators import match as M

SF_SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("L,expected", [(0, 0), (1, 0), (2, 1), (512, 1), (513, 2), (768, 2), (769, 3), (1025, 4)])
def test_window_count(spark, L, expected):
    assert spark.range(1).select(E.n_windows(F.lit(L)).alias("n")).first().n == expected


def _windows_py(L):
    out = []
    for s in range(0, L, 256):
        e = min(s + 512, L)
        if e - s < 2:
            continue
        out.append((s, e))
        if e == L:
            break
    return out


@pytest.mark.parametrize("n_words", [0, 1, 300, 510, 511, 700, 1300])
def test_windows_cover(spark, n_words):
    text = " ".join(f"w{i}" for i in range(n_words))
    df = spark.createDataFrame([(1, text)], "id long, text string")
    w = E.token_windows(df, ["id"]).orderBy("win_no").collect()
    assert [(r.start, r.end) for r in w] == _windows_py(n_words + 2)
    # every token is covered, windows overlap by the stride
    covered = set()
    for r in w:
        covered.update(range(r.start, r.end))
    assert covered == set(range(n_words + 2))


def test_three_pooling_paths_agree(spark):
    rows = [(i, " ".join(f"t{j % (i + 3)}" for j in range(i * 137))) for i in range(8)]
    df = spark.createDataFrame(rows, "id long, text string")
    fused = {r.id: r.embedding for r in E.embed_texts(df, ["id"]).collect()}
    exploded = {r.id: r.embedding for r in E.embed_texts_exploded(df, ["id"]).collect()}
    dense = {r.id: r.embedding for r in E.mean_pool(E.window_vectors(E.token_windows(df, ["id"]), ["id"]), ["id"]).collect()}
    assert fused.keys() == exploded.keys() == dense.keys()
    for k in fused:
        assert np.allclose(fused[k], exploded[k]) and np.allclose(fused[k], dense[k])
        assert len(fused[k]) == E.DIM


def test_arrow_pooling_equals_udf_pooling(spark):
    # null text, too short for a window, one window, several windows; small batches so
    # that Arrow slices with non-zero offsets reach the pooling step
    rows = [(0, None), (1, ""), (2, "x"), (3, "a b"), (4, " ".join(f"u{j}" for j in range(900)))]
    rows += [(i, " ".join(f"t{j % (i + 3)}" for j in range(i * 97))) for i in range(5, 40)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        for special in (True, False):
            arrow = {r.id: r.embedding for r in E.embed_texts(df, ["id"], special=special).collect()}
            udf = {r.id: r.embedding for r in E.embed_texts_udf(df.where("text IS NOT NULL"), ["id"],
                                                                special=special).collect()}
            assert arrow.keys() == udf.keys() and 0 not in arrow
            for k in arrow:
                assert arrow[k] == udf[k]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_zero_fallback(spark):
    df = spark.createDataFrame([(1, ""), (2, "x"), (3, "a b")], "id long, text string")
    v = E.embed_texts(df, ["id"], special=False)
    z = {r.id: r.embedding for r in E.with_zero_fallback(df, v, ["id"]).collect()}
    assert z[1] == [0.0] * E.DIM and z[2] == [0.0] * E.DIM
    assert sum(z[3]) == 2.0


def test_cosine_rules(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0, 2.0], [2.0, 4.0]), ([1.0, 0.0], [0.0, 1.0])],
                               "a array<double>, b array<double>")
    s = [r.s for r in df.select(M.cosine_expr("a", "b").alias("s")).collect()]
    assert s[0] == 0.0 and abs(s[1] - 1.0) < 1e-12 and s[2] == 0.0
    s2 = [r.s for r in df.select(M.cosine_expr("b", "a").alias("s")).collect()]
    assert s == s2


@pytest.mark.parametrize("block_bytes", [4 << 20, 4096])
def test_block_product_equals_brute_force(spark, block_bytes):
    v = (spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
         .select(F.col("vec_id").cast("string").alias("path"), "embedding", "label"))
    cve, proj = v.where("label = 0"), v.where("label <> 0")
    got = {(r.cve_function_path, r.project_function_path): r.similarity
           for r in M.clone_pairs(spark, cve, proj, 0.3, max_block_bytes=block_bytes).collect()}
    c = cve.toPandas()
    p = proj.toPandas()
    cm = np.vstack(c.embedding.map(np.asarray)).astype(float)
    pm = np.vstack(p.embedding.map(np.asarray)).astype(float)
    cm /= np.linalg.norm(cm, axis=1, keepdims=True)
    pm /= np.linalg.norm(pm, axis=1, keepdims=True)
    s = cm @ pm.T
    want = {(c.path[i], p.path[j]): s[i, j] for i, j in zip(*np.nonzero(s >= 0.3))}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def _brute(cve, proj, t):
    out = []
    for a, u in cve:
        for b, v in proj:
            if not u or not v:
                continue
            u2, v2 = np.array([np.nan if x is None else x for x in u]), np.array([np.nan if x is None else x for x in v])
            nu, nv = np.linalg.norm(u2), np.linalg.norm(v2)
            s = 0.0 if nu == 0 or nv == 0 else float(u2 @ v2 / (nu * nv))
            if not s < t:
                out.append((a, b, "nan" if np.isnan(s) else round(s, 9)))
    return sorted(out)


@pytest.mark.parametrize("t", [0.947, 0.7, 0.0, -0.5])
def test_match_on_hard_vectors(spark, t):
    # one hot cell of close vectors, copies, zero, NaN, null entries, null and empty vectors, repeated rows
    rng = np.random.default_rng(3)
    hot = rng.normal(size=8)
    vecs = [(hot + rng.normal(scale=0.15, size=8)).tolist() for _ in range(60)]
    vecs += [rng.normal(size=8).tolist() for _ in range(40)] + [hot.tolist()] * 30
    vecs += [[0.0] * 8, [-0.0] * 8, [float("nan")] + [1.0] * 7, [None] + [1.0] * 7, None, []]
    rows = [(f"v{i}", v) for i, v in enumerate(vecs)]
    cve, proj = rows[::3] + rows[-6:] + rows[:1], rows + rows[-5:-4] + rows[3:5]
    schema = "path string, embedding array<double>"
    got = M.clone_pairs(spark, spark.createDataFrame(cve, schema), spark.createDataFrame(proj, schema), t,
                        max_block_rows=7, max_cells=12).collect()
    got = sorted((a, b, "nan" if np.isnan(s) else round(s, 9)) for a, b, s in got)
    want = _brute(cve, proj, t)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert all(x == y or abs(x - y) < 1e-8 for (_, _, x), (_, _, y) in zip(got, want))


@pytest.mark.parametrize("t", [0.947, 0.8])
def test_match_over_split_cells(spark, t):
    # a third of all vectors in one narrow cluster, clusters around it, copies, odd vectors
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(6, 8))
    vecs = [(centres[0] + rng.normal(scale=0.25, size=8)).tolist() for _ in range(200)]
    vecs += [(centres[i % 6] + rng.normal(scale=0.4, size=8)).tolist() for i in range(400)]
    vecs += [centres[1].tolist()] * 20 + [[0.0] * 8, [float("nan")] + [1.0] * 7, [None] + [1.0] * 7, None, []]
    rows = [(f"v{i}", v) for i, v in enumerate(vecs)]
    cve, proj = rows[::7] + rows[-5:], rows
    schema = "path string, embedding array<double>"
    got = M.clone_pairs(spark, spark.createDataFrame(cve, schema), spark.createDataFrame(proj, schema), t,
                        max_block_rows=8, min_cells=2, max_cells=4, split_blocks=1, levels=3).collect()
    got = sorted((a, b, "nan" if np.isnan(s) else round(s, 9)) for a, b, s in got)
    want = _brute(cve, proj, t)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert all(x == y or abs(x - y) < 1e-8 for (_, _, x), (_, _, y) in zip(got, want))


def test_split_cells_keep_visits_flat(spark, tmpdir_path):
    """Rows of the product of a CVE vector's cells must not grow with the table when the cells are split."""
    rng = np.random.default_rng(5)
    schema = "cell long, vid binary, kind int, unit array<double>"

    def units(n):
        m = rng.normal(size=(n, 3))
        return m / np.linalg.norm(m, axis=1, keepdims=True)

    cve = [(0, f"c{i}".encode().ljust(16), 0, u.tolist()) for i, u in enumerate(units(40))]
    met = {}
    for n in (500, 8000):                        # 16 times as many
        proj = [(0, f"p{i}".encode().ljust(16), 0, u.tolist()) for i, u in enumerate(units(n))]
        p, np_, c, nc = M.split_cells(spark.createDataFrame(proj, schema), {0: n}, spark.createDataFrame(cve, schema), {0: 40},
                                      0.99, 20, 1024, 4, f"{tmpdir_path}/split{n}")
        assert sum(np_.values()) == n == p.count() and c.count() == sum(nc.values())
        per_cell = {r["cell"]: r["count"] for r in p.groupBy("cell").count().collect()}
        assert per_cell == np_ and max(per_cell.values()) < 400
        met[n] = sum(per_cell[r["cell"]] for r in c.select("cell").collect()) / 40 / n
    # share of the table that a CVE vector meets falls: its cells shrink with the table
    assert met[500] < 0.5 and met[8000] < met[500] / 3


def test_pooling_in_steps():
    """A batch of many tokens is pooled in steps of bounded size, with the vectors of a single step."""
    import pyarrow as pa

    from patchtrace.functions import vectors

    rng = np.random.default_rng(1)
    lens = [0, 700_000, 1, 2, 513, 300_000] + [30] * 9000
    ids = [rng.integers(0, 256, n, dtype=np.int32) for n in lens]
    flat = pa.array(np.concatenate(ids))
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lens]), pa.int32()), flat)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(lens))), lists], names=["k", "b"])
    out = list(vectors.pooled_bucket_batches(["k"], "b", 256, 512, 256)([batch.slice(0, 0), batch]))
    assert len(out) > 3 and max(b.num_rows for b in out) <= 4096
    got = {k: v for b in out for k, v in zip(b.column("k").to_pylist(), b.column("embedding").to_pylist(), strict=True)}
    assert set(got) == set(range(len(lens))) - {0, 2}
    for k in (1, 3, 4, 6, 9005):
        n = len(ids[k])
        starts = [0] if n <= 512 else range(0, (-(-(n - 512) // 256) + 1) * 256, 256)
        want = np.mean([np.bincount(ids[k][s:s + 512], minlength=256) for s in starts], axis=0)
        assert np.allclose(got[k], want)


def test_window_vectors_group_small_rows(spark):
    """Equal windows are added up, null keys are a key, and no plan has a column a bucket."""
    schema = "doc_id long, text string"
    docs = spark.createDataFrame([(1, "a b " * 400), (1, "a b " * 400), (None, "x"), (2, ""), (3, None)], schema)
    w = E.window_vectors(E.token_windows(docs, ["doc_id"]), ["doc_id"])
    assert "pivotfirst" not in w._jdf.queryExecution().toString().lower()
    got = {(r["doc_id"], r["win_no"]): sum(r["embedding"]) for r in w.collect()}
    assert got == {(1, 0): 1024.0, (1, 1): 1024.0, (1, 2): 2 * 290.0, (None, 0): 3.0, (2, 0): 2.0}
    mean = {r["doc_id"]: sum(r["embedding"]) for r in E.mean_pool(w, ["doc_id"]).collect()}
    assert mean[1] == pytest.approx((1024 + 1024 + 580) / 3) and mean[None] == 3.0


def test_a_lower_level_splits_again(spark, tmpdir_path):
    """Cells made of a hot cell get pivots that their own level did not use, so they become smaller."""
    rng = np.random.default_rng(9)
    schema = "cell long, vid binary, kind int, unit array<double>"
    m = rng.normal(size=(2000, 3))
    rows = [(0, f"p{i}".encode().ljust(16), 0, (u / np.linalg.norm(u)).tolist()) for i, u in enumerate(m)]
    sides = spark.createDataFrame(rows, schema), {0: 2000}, spark.createDataFrame(rows[:30], schema), {0: 30}
    cells = []
    for level in (1, 2):                         # the same numbers on both levels: one pivot in 100 vectors
        sides = M.split_cells(*sides, 0.9, 100, 1024, 1, f"{tmpdir_path}/level{level}")
        cells.append(len(sides[1]))
    assert sum(sides[1].values()) == 2000 and cells[1] > cells[0]


def test_a_vector_meets_few_blocks(spark):
    """Copies that the match shuffles: one of each vector for a block of the other side."""
    n, dim = 6000, 16
    rng = np.random.default_rng(2)
    rows = [(f"v{i}", u.tolist()) for i, u in enumerate(rng.normal(size=(n, dim)))]
    df = spark.createDataFrame(rows, "path string, embedding array<double>")
    seen, real = [], M.block_pairs

    def watch(project, n_project, cve, n_cve, threshold, rows):
        seen.extend((-(-n_cve[c] // rows)) * k + (-(-k // rows)) * n_cve[c] for c, k in n_project.items() if c in n_cve)
        return real(project, n_project, cve, n_cve, threshold, rows)

    M.block_pairs = watch
    try:
        found = M.clone_pairs(spark, df, df, 0.99, min_cells=1, max_cells=1).count()
    finally:
        M.block_pairs = real
    assert found == n and sum(seen) <= 3 * n


def test_match_of_empty_and_unlike_sides(spark):
    schema = "path string, embedding array<double>"
    one, none = spark.createDataFrame([("a", [1.0, 0.0])], schema), spark.createDataFrame([], schema)
    assert M.clone_pairs(spark, one, none).count() == M.clone_pairs(spark, none, one).count() == 0
    zeros = spark.createDataFrame([("z", [0.0, 0.0])], schema)
    assert M.clone_pairs(spark, one, zeros).count() == M.clone_pairs(spark, zeros, one).count() == 0
    with pytest.raises(ValueError):
        M.clone_pairs(spark, one, spark.createDataFrame([("b", [1.0, 0.0, 0.0])], schema))


def test_zeros_are_not_rounded_one_by_one(spark):
    from pyspark.sql import functions as F

    from patchtrace.plans.queries import _round_vec
    v = [0.0, -0.0, 0.1234565, -1.0000005, 1e-9, float("inf"), None]
    df = spark.createDataFrame([(v,), ([],), (None,)], "embedding array<double>")
    col = _round_vec()
    assert "CASE" in df.select(col)._jdf.queryExecution().analyzed().toString()
    want = [r[0] for r in df.select(F.transform("embedding", lambda x: F.round(x, 6))).collect()]
    assert [repr(r[0]) for r in df.select(col).collect()] == [repr(w) for w in want]


def _clustered(seed, n, dim=96):
    """Unit vectors around a hundred directions in a space of few dimensions."""
    rng, first = np.random.default_rng(seed), np.random.default_rng(0)
    centres = first.normal(size=(100, 8)) @ first.normal(size=(8, dim))
    m = centres[rng.integers(0, 100, n)] + rng.normal(size=(n, dim)) * rng.choice([0.1, 0.6], n)[:, None]
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def test_bounds_of_short_vectors_lose_no_pair():
    """A block's screen keeps every pair at the threshold and few others, without a product of all dimensions."""
    p, c = _clustered(1, 3000), _clustered(2, 1500)
    real, plain = M._plain_pairs, []
    M._plain_pairs = lambda *a: plain.append(1) or real(*a)
    try:
        screen = M._Screen(p, c[:700], 0.947)
        got = {(int(i), int(j) + at) for at in (0, 700) for ii, jj in screen.pairs(c[at:at + 700 + at]) for i, j in zip(ii, jj)}
    finally:
        M._plain_pairs = real
    want = set(zip(*map(lambda x: x.tolist(), np.nonzero(p @ c.T >= 0.947)), strict=True))
    assert not plain and len(want) > 1000 and want <= got and len(got) < 2 * len(want)
    # where the bounds would leave most pairs, the product of all dimensions is taken
    q = np.random.default_rng(3).normal(size=(400, 96))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    some = {(int(i), int(j)) for ii, jj in M._Screen(q, q, 0.2).pairs(q) for i, j in zip(ii, jj)}
    assert set(zip(*map(lambda x: x.tolist(), np.nonzero(q @ q.T >= 0.2)), strict=True)) <= some


@pytest.mark.parametrize("dim", [5, 96])
def test_packed_vectors_come_back(dim):
    import pyarrow as pa

    m = _clustered(4, 50, dim)
    for x in (m, np.where(m > 0.1, m, 0.0), np.zeros((3, dim))):
        for part in (x, x[:1]):
            entries, places = M._packed(M._list_array(part))
            assert np.array_equal(M._unpacked(entries.slice(0), places, dim), part)
    both = [pa.concat_arrays(a) for a in zip(M._packed(M._list_array(m)), M._packed(M._list_array(np.where(m > 0.3, m, 0.0))))]
    assert np.array_equal(M._unpacked(*both, dim), np.concatenate([m, np.where(m > 0.3, m, 0.0)]))


def test_pairs_are_written_as_they_are_found(spark, monkeypatch):
    """Copies, equal paths and null paths give all their pairs; nothing is joined to the pairs, and sides are shuffled once."""
    monkeypatch.setattr(M, "SCREEN_PAIRS", 1)
    p, c = _clustered(5, 300, 80), _clustered(6, 60, 80)
    proj = [(f"p{i}", u.tolist()) for i, u in enumerate(p)] + [("copy", p[0].tolist())] * 40 + [(None, p[1].tolist()), ("", p[2].tolist())]
    cve = [(f"c{i}", u.tolist()) for i, u in enumerate(c)] + [(f"k{i}", p[0].tolist()) for i in range(30)] + [(None, p[1].tolist())]
    schema = "path string, embedding array<double>"
    pairs = M.clone_pairs(spark, spark.createDataFrame(cve, schema), spark.createDataFrame(proj, schema), 0.947, max_block_rows=50)
    plan = pairs._jdf.queryExecution().toString()
    assert "Join" not in plan and plan.split("== Physical Plan ==")[1].count("Exchange") == 1

    def text(rows):
        return sorted((str(a), str(b), round(s, 9)) for a, b, s in rows)
    named = [[(str(path), u) for path, u in side] for side in (cve, proj)]
    assert text(pairs.collect()) == text(_brute(*named, 0.947))
    # pairs of copies come in batches of bounded size
    import pyarrow as pa
    rows = [pa.array([0] * 90), *[pa.array([0] * 90, pa.int32())] * 2, pa.array([0] * 40 + [1] * 50, pa.int32()),
            pa.array([b"x" * 16 + str(i).encode() for i in range(90)]), pa.array([2 << 2] * 90, pa.int32()), *M._packed(M._list_array(np.tile([0.6, 0.8], (90, 1))))]
    batch = pa.RecordBatch.from_arrays(rows, names=["cell", "a", "b", "side", "vid", "kind", "entries", "places"])
    out = list(M._score_blocks(0.9, most=64)([batch.slice(0, 7), batch.slice(7)]))
    assert max(b.num_rows for b in out) <= 64 and len({(x, y) for b in out for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}) == 2000
