"""Diff mining on hand-written diffs covering the edge cases of the part rules."""

import pytest

from patchtrace.operators import diffs

BASIC = """diff --git a/src/x.c b/src/x.c
index 1111111..2222222 100644
--- a/src/x.c
+++ b/src/x.c
@@ -1,3 +1,3 @@ int main(void)
 a
-b
+c
@@ -10,2 +10,2 @@
 d
-e"""

CASES = {
    "basic": (BASIC, [("src/x.c", "@@ -1,3 +1,3 @@ int main(void)\n a\n-b\n+c", "int main(void)\na\nb"),
                      ("src/x.c", "@@ -10,2 +10,2 @@\n d\n-e", "d\ne")]),
    "pure_addition": ("diff --git a/n.c b/n.c\nnew file mode 100644\n@@ -0,0 +1 @@\n+x",
                      [("n.c", "@@ -0,0 +1 @@\n+x", "")]),
    "header_context_only": ("diff --git a/f b/f\n@@ -1 +1 @@ ctx", [("f", "@@ -1 +1 @@ ctx", "ctx")]),
    "empty_hunk": ("diff --git a/f b/f\n@@ -1 +1 @@", []),
    "binary": ("diff --git a/f.png b/f.png\nBinary files a/f.png and b/f.png differ", []),
    "rename_only": ("diff --git a/a b/b\nsimilarity index 100%\nrename from a\nrename to b", []),
    "empty": ("", []),
    "path_with_space": ("diff --git a/my file.c b/my file.c\n@@ -1 +1 @@\n-x", [("le.c", "@@ -1 +1 @@\n-x", "x")]),
    "triple_at": ("diff --git a/f b/f\n@@@ -1 -1 +1 @@@\n  x", [("f", "@@@ -1 -1 +1 @@@\n  x", "@\n x")]),
    "index_in_hunk": ("diff --git a/f b/f\n@@ -1 +1 @@\n-a\nindex abc\n+b", [("f", "@@ -1 +1 @@\n-a\nindex abc\n+b", "a")]),
    "no_newline_marker": ("diff --git a/f b/f\n@@ -1 +1 @@\n-a\n\\ No newline at end of file",
                          [("f", "@@ -1 +1 @@\n-a\n\\ No newline at end of file", "a\n\\ No newline at end of file")]),
    "trailing_blank_context": ("diff --git a/f b/f\n@@ -1,2 +1,2 @@\n-a\n+b\n \n", [("f", "@@ -1,2 +1,2 @@\n-a\n+b", "a")]),
    "short_diff_line_keeps_path": ("diff --git a/f b/f\n@@ -1 +1 @@\n-a\ndiff --git x\n@@ -2 +2 @@\n-b",
                                   [("f", "@@ -1 +1 @@\n-a", "a"), ("f", "@@ -2 +2 @@\n-b", "b")]),
    "blank_line_in_hunk": ("diff --git a/f b/f\n@@ -1,3 +1,3 @@\n-a\n\n-b", [("f", "@@ -1,3 +1,3 @@\n-a\n\n-b", "a\n\nb")]),
    "preamble_without_file": ("From abc\n@@ -1 +1 @@\n-a\ndiff --git a/f b/f\n@@ -1 +1 @@\n-b", [("f", "@@ -1 +1 @@\n-b", "b")]),
    "minus_header_lines_in_hunk": ("diff --git a/f b/f\n@@ -1 +1 @@\n--- x\n+++ y", [("f", "@@ -1 +1 @@\n--- x\n+++ y", "-- x")]),
}


@pytest.fixture(scope="module")
def parts(spark):
    rows = [(k, v[0]) for k, v in CASES.items()]
    df = spark.createDataFrame(rows, "case string, diff_text string")
    p = diffs.with_old_version(diffs.diff_parts(df, keep=["case"]))
    out = {}
    for r in p.collect():
        out.setdefault(r.case, []).append((r.part_no, r.file, r.diff_part, r.old_version))
    return {k: [t[1:] for t in sorted(v)] for k, v in out.items()}


@pytest.mark.parametrize("case", list(CASES))
def test_parts(parts, case):
    assert parts.get(case, []) == CASES[case][1]


def test_part_numbers_are_dense(spark):
    df = spark.createDataFrame([("c", BASIC + "\n" + BASIC)], "case string, diff_text string")
    nos = sorted(r.part_no for r in diffs.diff_parts(df, keep=["case"]).collect())
    assert nos == [0, 1, 2, 3]


def test_line_counts_and_no_plus_in_old(spark):
    df = spark.createDataFrame([("c", BASIC)], "case string, diff_text string")
    p = diffs.with_old_version(diffs.with_line_counts(diffs.diff_parts(df, keep=["case"]))).orderBy("part_no").collect()
    assert [(r.n_added, r.n_removed, r.n_context, r.n_other) for r in p] == [(1, 1, 1, 0), (0, 1, 1, 0)]
    assert all("c" not in r.old_version.split("\n") for r in p)
