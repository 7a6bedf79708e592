import os

from pyspark.sql import functions as F

from patchtrace.operators import spans as SP
from patchtrace.sources import files as FS
from patchtrace.sources import sinks


def test_scan_source_tree(spark, tmpdir_path):
    os.makedirs(os.path.join(tmpdir_path, "sub"))
    for name, body in [("a.c", b"int f(void) {}\n"), ("B.PY", b"def g():\n    pass\n"), ("n.txt", b"x"),
                       ("sub/c.rs", b"fn h() {}\n"), ("d.Rb", b"def x\nend\n"), ("e.c++", b"int y;\n")]:
        with open(os.path.join(tmpdir_path, name), "wb") as f:
            f.write(body)
    rec = sorted(os.path.basename(r.path) for r in FS.scan_source_tree(spark, tmpdir_path, True).collect())
    flat = sorted(os.path.basename(r.path) for r in FS.scan_source_tree(spark, tmpdir_path, False).collect())
    more = sorted(os.path.basename(r.path) for r in FS.scan_source_tree(spark, tmpdir_path, True, extra=True).collect())
    assert rec == ["B.PY", "a.c", "c.rs", "e.c++"]
    assert flat == ["B.PY", "a.c", "e.c++"]
    assert more == ["B.PY", "a.c", "c.rs", "d.Rb", "e.c++"]


def test_decode_policies(spark):
    rows = [("ok.c", "a\r\nb\rc".encode()), ("bad.c", b"x\xffy\r\n"), ("empty.c", b""),
            ("own.c", "\ufffd \ue000 \ue0001 \ue0000".encode() + b"\xff\xc3")]
    df = spark.createDataFrame(rows, "path string, content binary")
    ign = {r.path: r.text for r in FS.decoded_files(df, "ignore").collect()}
    skp = {r.path: r.text for r in FS.decoded_files(df, "skip").collect()}
    assert ign == {"ok.c": "a\nb\nc", "bad.c": "xy\n", "empty.c": "", "own.c": "\ufffd \ue000 \ue0001 \ue0000"}
    assert skp == {"ok.c": "a\nb\nc", "empty.c": ""}


DUMP = """(translation_unit [0, 0] - [9, 0]
  (function_definition [0, 0] - [4, 1]
    type: (primitive_type [0, 0] - [0, 3])
    body: (compound_statement [0, 10] - [4, 1]
      (function_definition [1, 2] - [2, 3]))))
  (declaration [5, 0] - [5, 6])
  (function_definition [6, 0] - [6, 12]))"""


def test_dump_spans_and_slices(spark):
    src = "int a(void){\n  int b(){\n  }\n  x;\n}\nint y;\nint c(){ 1 }\n"
    dumps = spark.createDataFrame([("f.c", DUMP), ("f.txt", DUMP)], "file_path string, dump string")
    sp = SP.dump_spans(dumps).orderBy("span_no").collect()
    assert [(r.start_row, r.start_col, r.end_row, r.end_col) for r in sp] == [(0, 0, 4, 1), (1, 2, 2, 3), (6, 0, 6, 12)]
    files = spark.createDataFrame([("f.c", src)], "file_path string, content string")
    sl = {r.span_no: r.contents for r in SP.slice_spans(SP.dump_spans(dumps), files).collect()}
    lines = src.split("\n")
    assert sl[0] == src[:src.index("}\nint y")] + "}"
    assert sl[1] == "int b(){\n  }"
    assert sl[2] == lines[6][:12]


def test_slices_equal_plain_lines(spark):
    text = "ab\ncde\n\nf"
    rows = [(sr, sc, er, ec) for sr in range(5) for er in range(sr, 5) for sc in (0, 1, 9) for ec in (0, 1, 2, 9)]
    sp = spark.createDataFrame([("f", i, *r) for i, r in enumerate(rows)],
                               "file_path string, span_no int, start_row int, start_col int, end_row int, end_col int")
    files = spark.createDataFrame([("f", text), ("g", None)], "file_path string, content string")
    lines, want = text.splitlines(keepends=True), {}
    for i, (sr, sc, er, ec) in enumerate(rows):
        if er < len(lines):
            want[i] = lines[sr][sc:ec] if sr == er else "".join([lines[sr][sc:], *lines[sr + 1:er], lines[er][:ec]])
    out = SP.slice_spans(sp, files)
    assert {r.span_no: r.contents for r in out.collect()} == want
    rec = SP.file_records(out).collect()
    assert len(rec) == 1 and [f.contents for f in rec[0].functions] == [want[i] for i in sorted(want)]
    assert rec[0].functions[0].start.asDict() == {"row": 0, "column": 0}


def test_bodies_under_their_names(spark, tmpdir_path):
    fns = spark.createDataFrame([("a", 0, "f", "x"), ("a", 1, "g", "y"), ("b", 0, "f", "z")], "path string, fn_no int, name string, body string")
    sinks.write_bodies(fns, tmpdir_path + "/bodies")
    assert {r.output_key: r.body for r in spark.read.parquet(tmpdir_path + "/bodies").collect()} == {"f0": "x", "g1": "y", "f2": "z"}


def test_latest_per_key(spark):
    recs = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "z"), (0, "b", "w"), (3, "b", "a")], "seq long, file_path string, v string")
    got = {r.file_path: (r.seq, r.v) for r in SP.latest_per_key(recs).collect()}
    assert got == {"a": (2, "y"), "b": (3, "z")}


def test_output_keys_are_a_dense_global_counter(spark):
    fns = spark.createDataFrame([(f"p{i // 7:03d}", i % 7, f"n{i}") for i in range(200)], "path string, fn_no int, name string")
    got = sorted((r.path, r.fn_no, r.counter, r.output_key) for r in sinks.output_keys(fns.repartition(5)).collect())
    assert [g[2] for g in got] == list(range(200))
    assert all(g[3].endswith(str(g[2])) for g in got)
    _ = F


def test_reference_shaped_vector_file(spark, tmpdir_path):
    import json
    from patchtrace.sources.vectors import read_vectors
    p = os.path.join(tmpdir_path, "cve_embeddings.json")
    with open(p, "w") as f:
        json.dump([{"path": "/x/a", "embedding": [0.5, 1.0]}, {"path": "/x/b", "embedding": [0.0, 0.0]}], f, indent=2)
    got = {r.path: r.embedding for r in read_vectors(spark, p, "json_array").collect()}
    assert got == {"/x/a": [0.5, 1.0], "/x/b": [0.0, 0.0]}
