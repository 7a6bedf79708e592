"""Functions of files given as blocks equal the row plan, for every block size."""

import random
import time

import pytest
from pyspark.sql import functions as F

from patchtrace.operators import blocks, extract, source_blocks

PIECES = ["int f(int a) {\n", "}\n", "  x = 1;\n", "/* open\n", "end */\n", "/*/\n", "// int g() {\n", "a(b,\n", "c)\n", "{\n",
          "static void h(std::vector<int> v = {},\n int b) {\n", "template <class T\n", "> T m(T t)\n{\n", "}  \n", "if (a) {\n",
          "fn q(a: u8) -> Vec<\n u8> {\n", "fn r<T>(x: T) {\n", "-> x;\n", "é = 'ü'; }\n", "\n", "} */ {\n", "f(\n", ");\n"]


def _files(n, seed):
    r = random.Random(seed)
    return [(f"d/{k}.{'rs' if k % 3 == 0 else 'java' if k % 3 == 1 else 'c'}",
             "rust" if k % 3 == 0 else "java" if k % 3 == 1 else "c",
             "".join(r.choice(PIECES) for _ in range(r.randrange(0, 40)))) for k in range(n)]


@pytest.mark.parametrize("size", [1, 25, 120, 5000])
def test_functions_of_blocks_equal_the_row_plan(spark, size):
    rows = _files(90, size) + [("n.c", "c", None), ("e.c", "c", ""), ("b.c", "c", "int f() {\n}"), ("o.c", "c", "/*")]
    files = spark.createDataFrame(rows, "path string, language string, content string")
    cut = blocks.text_blocks(files, ["path", "language"], "content", size)
    langs = ["c", "java", "rust"]
    got = source_blocks.brace_functions_of_blocks(cut, langs)
    want = extract.brace_functions(files, langs)
    a = sorted(tuple(x) for x in got.select(*extract.FUNCTION_COLUMNS).collect())
    b = sorted(tuple(x) for x in want.select(*extract.FUNCTION_COLUMNS).collect())
    assert len(b) > 40 and a == b


def test_comments_of_blocks_equal_the_row_plan(spark):
    r = random.Random(7)
    texts = ["".join(r.choice(["/*", "*/", "/", "*", "\n", "x", "//"]) for _ in range(r.randrange(30))) for _ in range(600)]
    files = spark.createDataFrame([(str(k), "c", t) for k, t in enumerate(texts)], "path string, language string, content string")
    stripped = source_blocks.strip_block_comments(blocks.text_blocks(files, ["path", "language"], "content", 1))
    got = {p: "".join(t for _, t in sorted(x)) for p, x in
           stripped.groupBy("path").agg(F.collect_list(F.struct("block_no", "text"))).collect()}
    want = dict(files.select("path", extract.strip_comments(F.col("content"))).collect())
    assert got == want


def test_ordinary_code_is_cut_into_many_chunks(spark):
    text = "".join(f"int f{k}(int a) {{\n  return g(a,\n {k});\n}}\n" for k in range(500))
    files = spark.createDataFrame([("a.c", "c", text)], "path string, language string, content string")
    cut = blocks.text_blocks(files, ["path", "language"], "content", 200)
    chunks = source_blocks.chunks_of_blocks(source_blocks.strip_block_comments(cut))
    longest, n = chunks.agg(F.max(F.length("content")), F.count("*")).first()
    assert n > 100 and longest <= 400


def test_a_block_without_marks_is_read_once(spark):
    """Looking for the last mark of a block takes time by its length, not by the square of it."""
    begun, text = time.time(), "word " * 60_000
    stripped = spark.createDataFrame([("a.c", "c", 0, text), ("a.c", "c", 1, ";\n}\n")],
                                     "path string, language string, block_no long, text string")
    chunks = source_blocks.chunks_of_blocks(stripped).collect()
    assert "".join(r["content"] for r in sorted(chunks, key=lambda r: r["chunk"])) == text + ";\n}\n"
    assert time.time() - begun < 20


def test_no_files(spark):
    none = spark.createDataFrame([], "path string, language string, block_no long, block string")
    assert source_blocks.brace_functions_of_blocks(none, ["c"]).count() == 0
