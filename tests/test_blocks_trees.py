"""Diffs as blocks against the row plan; projects, snapshots and deltas of source trees."""

import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from patchtrace.operators import blocks, diffs, extract
from patchtrace.sources import trees

LINES = ["diff --git a/x.c b/x.c", "diff --git a/y z.c b/y z.c", "diff --git short", "index 12..34", "@@ -1,2 +1,2 @@",
         "@@ -1 +1 @@ int f(void)", "@@@ -1 -1 +1 @@@", "+new", "-old", " same", "", "  ", "\\ No newline", "+++ b/x.c", "x" * 30, "\x1c"]


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(LINES), max_size=25), min_size=1, max_size=25), st.sampled_from([0, 1, 20, 64, 4096]))
def test_blocks_give_the_parts_of_the_row_plan(spark, docs, size):
    rows = [(i, "\n".join(lines)) for i, lines in enumerate(docs)] + [(-1, None), (-2, "\n \n")]
    df = spark.createDataFrame(rows, "id long, diff_text string")
    want = diffs.diff_parts(df, keep=["id"])
    cut = blocks.text_blocks(df, ["id"], "diff_text", size)
    got = blocks.diff_parts_of_blocks(cut, ["id"]).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # the blocks are the text
    back = cut.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "block"))),
                                                           lambda x: x["block"]), "\n").alias("t"))
    assert {r.id: r.t for r in back.collect()} == {i: t for i, t in rows if t is not None}


def test_one_large_diff_file_is_read_by_many_tasks(spark, tmpdir_path):
    one = "diff --git a/f%d.c b/f%d.c\nindex 1..2\n@@ -1,3 +1,3 @@ int f%d(void)\n a\xe9\n-b%d\n+c\n\\ No newline\n@@ -9 +9 @@\n" + "+long\n" * 40
    text = "\n\n" + "".join(one % (i, i, i, i) for i in range(400)) + "\n"
    path = os.path.join(tmpdir_path, "one.diff")
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7001")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        cut = blocks.read_blocks(spark, path, block_bytes=1500)
        assert cut.rdd.getNumPartitions() > 10
        cut = cut.checkpoint()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert cut.count() > 50 and cut.select("block_no").distinct().count() == cut.count()
    got = blocks.diff_parts_of_blocks(cut.withColumnRenamed("file", "src"), ["src"])
    want = diffs.diff_parts(spark.createDataFrame([("k", text)], "src string, diff_text string"), keep=["src"])
    cols = ["part_no", "file", "diff_part"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_projects_file_and_nested_roots(spark, tmpdir_path):
    tree = {"a/m.c": "int f(int x) { }\n", "a/vendor/z/n.C": "n", "a/vendor/k.txt": "no", "ab/q.py": "q", "b c/r.rs": "r", "out.c": "o"}
    for name, text in tree.items():
        full = os.path.join(tmpdir_path, name)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w") as f:
            f.write(text)
    listed = os.path.join(tmpdir_path, "projects.txt")
    with open(listed, "w") as f:
        f.write(f"# id root\n\nA {tmpdir_path}/a/\nZ\t{tmpdir_path}/a/vendor/z\nB  {tmpdir_path}/b c\nlost\n")
    projects = trees.read_projects_file(spark, listed)
    assert sorted(map(tuple, projects.collect())) == [("A", f"{tmpdir_path}/a"), ("B", f"{tmpdir_path}/b c"), ("Z", f"{tmpdir_path}/a/vendor/z")]
    found = trees.scan_projects(spark, projects)
    assert sorted((r.project_id, r.path.rsplit("/", 1)[1], bytes(r.content).decode()) for r in found.collect()) == [
        ("A", "m.c", tree["a/m.c"]), ("B", "r.rs", "r"), ("Z", "n.C", "n")]
    assert trees.outermost(["/a/b", "/a", "/ab", "/a/c/d", "/b"]) == ["/a", "/ab", "/b"]


def test_assign_projects_prefers_the_longest_root(spark):
    files = spark.createDataFrame([(p, i) for i, p in enumerate(["/x", "/p/a.c", "/p/q/b.c", "/pq/c.c", "/p/q", "rel/d.c"])], "path string, n int")
    roots = spark.createDataFrame([("/p", "one"), ("/p/q", "two"), ("/p", "zero"), ("rel", "r"), ("/", "all")], "root string, project_id string")
    got = {r.path: r.project_id for r in trees.assign_projects(files, roots).collect()}
    assert got == {"/x": "all", "/p/a.c": "one", "/p/q/b.c": "two", "/pq/c.c": "all", "/p/q": "one", "rel/d.c": "r"}


def test_tree_delta_and_what_follows(spark):
    old = [("same.c", "int a(int x) { }\n"), ("chg.c", "int b(int x) { }\n"), ("gone.c", "int c(int x) { }\n"),
           ("m1.c", "int d(int x) { }\n"), ("m2.c", "int d(int x) { }\n"), ("e1.c", None), ("e2.c", "")]
    new = [("same.c", "int a(int x) { }\n"), ("chg.c", "int z(int x) { }\n"), ("new.c", "int e(int x) { }\n"),
           ("to.c", "int d(int x) { }\n"), ("to2.c", "int d(int x) { }\n"), ("e1.c", "")]
    o, n = (spark.createDataFrame(x, "path string, content string") for x in (old, new))
    delta = trees.tree_delta(trees.snapshot(o, ["path"]), trees.snapshot(n, ["path"]), ["path"])
    assert {r.path: (r.status, r.from_path) for r in delta.collect()} == {
        "same.c": ("same", None), "chg.c": ("changed", None), "gone.c": ("removed", None), "new.c": ("added", None),
        "to.c": ("moved", "m1.c"), "to2.c": ("moved", "m1.c"), "m2.c": ("removed", None), "e1.c": ("same", None),
        "e2.c": ("removed", None)}
    # an inventory kept up to date by the delta equals a new one
    cols = ["path", "fn_no", "name", "body", "start_line"]
    held = extract.extract_functions(o).select(*cols)
    fresh = extract.extract_functions(trees.files_to_read(n, delta, ["path"])).select(*cols)
    now = trees.rows_that_stay(held, delta, ["path"]).unionByName(fresh)
    assert sorted(map(tuple, now.collect())) == sorted(map(tuple, extract.extract_functions(n).select(*cols).collect()))
    empty = trees.tree_delta(trees.snapshot(o.where("false"), ["path"]), trees.snapshot(n, ["path"]), ["path"])
    assert {r.status for r in empty.collect()} == {"added"}


@pytest.mark.parametrize("size", [0, 5])
def test_text_blocks_of_long_lines(spark, size):
    df = spark.createDataFrame([(1, "abcdefgh\n\nxy\n")], "id int, t string")
    got = [r.block for r in blocks.text_blocks(df, ["id"], "t", size).orderBy("block_no").collect()]
    assert "\n".join(got) == "abcdefgh\n\nxy\n" and got[0] == "abcdefgh"


def test_blocks_are_resolved_once(spark):
    """Parts in a block, pieces at the edges and numbers read what was written; each had cut the text again."""
    from patchtrace.operators import blocks
    text = "diff --git a/x.c b/x.c\n@@ -1 +1 @@\n-a\n+b\n@@ -9 +9 @@\n c\n-d"
    diffs = spark.createDataFrame([("r", "h", text)], "repo_url string, commit_hash string, diff_text string")
    parts = blocks.diff_parts_of_blocks(blocks.text_blocks(diffs, ["repo_url", "commit_hash"], "diff_text", block_chars=16),
                                        ["repo_url", "commit_hash"])
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert "diff-blocks" in plan and "regexp_extract_all" not in plan
    assert [(r.part_no, r.file, r.diff_part) for r in parts.orderBy("part_no").collect()] == [
        (0, "x.c", "@@ -1 +1 @@\n-a\n+b"), (1, "x.c", "@@ -9 +9 @@\n c\n-d")]
