"""Function inventory: hand snippets per language and property checks of the brace
plan and the line plan against a plain-Python scan of the same rules."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from patchtrace.functions.text import S
from pyspark.sql import functions as F

from patchtrace.operators import extract as X


def _run(spark, files, extra=False):
    df = spark.createDataFrame(files, "path string, content string")
    return X.extract_functions(df, extra=extra, repartition=False).orderBy("path", "fn_no").collect()


C_SRC = """#include <stdio.h>
// helper comment with { brace
static int add(int a, int b)
{
    if (a) {
        return a + b;
    }
    else if (b) {
        return b;
    }
    return 0;
}

/* block
   comment { */
void broken(void) {
    int x;
"""


def test_c_functions(spark):
    fns = _run(spark, [("src/a.c", C_SRC)])
    names = [f.name for f in fns]
    assert names == ["add", "if"]           # else-if quirk kept; unbalanced `broken` dropped
    add = fns[0]
    assert add.signature == "int add(int a, int b)"
    assert add.body.startswith("static int add(int a, int b)\n{") and add.body.endswith("return 0;\n}")
    # the match starts at the newline before the blank (comment-stripped) line: quirk Q8
    assert (add.start_line, add.end_line) == (1, 12)
    assert all(f.language == "c" for f in fns)


def test_java_rust_python(spark):
    java = "class A {\n  public static List<String> run(int a) throws IOException, X {\n    return null;\n  }\n}\n"
    rust = "pub async fn load<T: Clone>(p: T) -> Result<T, E> {\n    Ok(p)\n}\nfn tiny() {}\n"
    py = ("import os\n\ndef top(a, b) -> int:\n    x = 1\n    # note\n\n    def inner():\n        pass\n"
          "    return x\n\n# trailing comment\nclass K:\n    def m(self):\n        return 1\n")
    fns = _run(spark, [("A.java", java), ("lib.RS", rust), ("m.py", py)])
    by = {(f.path, f.name): f for f in fns}
    assert by[("A.java", "run")].signature == "List<String> run(int a)"
    assert by[("lib.RS", "load")].signature == "fn load(p: T)"
    assert ("lib.RS", "tiny") in by
    top = by[("m.py", "top")]
    assert top.signature == "def top(a, b) -> int:"
    # comment lines never end a def, even at column 0
    assert (top.start_line, top.end_line) == (3, 11)
    assert top.body == ("def top(a, b) -> int:\n    x = 1\n    # note\n\n    def inner():\n        pass\n    return x\n"
                        "\n# trailing comment")
    assert ("m.py", "inner") not in by              # nested defs are not emitted
    assert by[("m.py", "m")].end_line == 15


def test_extra_languages(spark):
    cs = "class C {\n    [Obsolete]\n    public static int Top(int a)\n    {\n        return a;\n    }\n}\n"
    js = "export async function load(x) {\n  if (x) { y(); }\n}\nconst f = function() {};\n"
    rb = "class K\n  def run(a)\n    a\n  end\n  def self.ok?\n  end\nend\n"
    fns = _run(spark, [("a.cs", cs), ("b.mjs", js), ("c.rb", rb)], extra=True)
    got = sorted((f.path, f.name, f.start_line, f.end_line) for f in fns)
    assert ("a.cs", "Top", 1, 6) in got      # brace rules count from the preceding newline
    assert ("b.mjs", "load", 1, 3) in got
    assert ("c.rb", "run", 2, 4) in got and ("c.rb", "self.ok?", 5, 6) in got


def test_language_labels(spark):
    df = spark.createDataFrame([("a/b.C",), ("x.h++",), ("y.pyx",), (".bashrc",), ("d/.hidden.c",), ("z.txt",), ("w",)], "path string")
    got = {r.path: r.l for r in df.select("path", X.language_label("path").alias("l")).collect()}
    assert got == {"a/b.C": "c", "x.h++": "cpp", "y.pyx": "python", ".bashrc": None, "d/.hidden.c": "c",
                   "z.txt": None, "w": None}


# --- property checks -------------------------------------------------------------

PY_DEF = X.PY_DEF.replace(S, r"\s").replace(r"[\p{L}\p{N}_]", r"\w")


def brace_scan(code, lang="c"):
    """Plain-Python statement of the brace rule: each header match, body to the brace
    that brings the depth back to zero, unbalanced dropped."""
    code = re.sub(r"/\*.*?\*/", "", re.sub(r"//[^\n]*", "", code), flags=re.S)
    header, name_group = X.BRACE_RULES[lang][0].replace(S, r"\s").replace(S[1:-1], r"\s"), X.BRACE_RULES[lang][1]
    out = []
    for m in re.finditer(header, code):
        depth, i = 1, m.end()
        while i < len(code) and depth:
            depth += {"{": 1, "}": -1}.get(code[i], 0)
            i += 1
        if depth == 0:
            out.append((m.group(name_group), code[:m.start()].count("\n") + 1, code[:i].count("\n") + 1,
                        code[m.start():i].strip()))
    return out


def line_scan(content):
    """Plain-Python statement of the def rule (indent-bounded block, nested skipped)."""
    lines, out, i = content.split("\n"), [], 0
    while i < len(lines):
        m = re.match(PY_DEF, lines[i])
        if not m:
            i += 1
            continue
        ind, j = len(m.group(1)), i + 1
        while j < len(lines):
            s = lines[j].strip()
            if s and not s.startswith("#") and len(lines[j]) - len(lines[j].lstrip()) <= ind:
                break
            j += 1
        out.append((m.group(3), i + 1, j, "\n".join(lines[i:j])))
        i = j
    return out


C_TOKENS = ["int f(void) ", "static ", "char *g(int a) ", "{", "}", "\n", " ", "x;", "else if (a) ",
            "// c {\n", "/* c } */", "void h(x)\n", "return;"]
PY_TOKENS = ["def f(a):", "def g() -> int:", "x = 1", "# c", "", "pass"]


SCAN_TOKENS = {
    "c": C_TOKENS,
    "java": ["public int f(int a) ", "static List<String> g() throws A, B ", "{", "}", "\n", " ", "x;", "int h();\n",
             "class K ", "// c {\n", "/* } */", "else if (a) "],
    "rust": ["fn f(a: i32) ", "pub fn g<T>(x: T) ", "-> Result<T, E> ", "trait T ", "fn a(&self) -> i32;", "impl T for X ",
             "{", "}", "\n", " ", "x;", "// {\n", "unsafe "],
}
SUFFIX = {"c": ".c", "java": ".java", "rust": ".rs"}


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.data())
def test_brace_plan_matches_scan(spark, data):
    files, want = [], []
    for lang, toks in SCAN_TOKENS.items():
        docs = data.draw(st.lists(st.lists(st.sampled_from(toks), max_size=40), min_size=1, max_size=12))
        for i, d in enumerate(docs):
            files.append((f"f{i}{SUFFIX[lang]}", "".join(d)))
            want += [(files[-1][0], *t) for t in brace_scan(files[-1][1], lang)]
    got = sorted((f.path, f.name, f.start_line, f.end_line, f.body) for f in _run(spark, files))
    assert got == sorted(want)


def test_rust_return_type_across_a_closing_brace(spark):
    code = "trait T { fn a(&self) -> i32; }\nimpl T for X {\n  fn b() {}\n}\n" + "\ntrait U {\n fn c(&self) -> i32; }\nimpl U {\n}\n"
    got = [(f.name, f.start_line, f.end_line, f.body) for f in _run(spark, [("t.rs", code)])]
    assert got == brace_scan(code, "rust") and "c" in [g[0] for g in got]


BRACED_TOKENS = {
    "c": [*C_TOKENS, "\nvoid f(std::vector<int> v = {}) ", "\nint g(A a = {1, {2}},\n B b) ", "\nint h(A a = { ", ") "],
    "java": [*SCAN_TOKENS["java"], "\npublic void f(@A({1, 2}) int a) ", "\nint g(@B({ "],
    "rust": [*SCAN_TOKENS["rust"], "\nfn f(Point { x, y }: Point) ", "\npub fn g<const N: usize = { 3 }>(a: A) -> B ", "\nfn h(} "],
}


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.data())
def test_brace_plan_matches_scan_with_braces_in_headers(spark, data):
    files, want = [], []
    for lang, toks in BRACED_TOKENS.items():
        docs = data.draw(st.lists(st.lists(st.sampled_from(toks), max_size=40), min_size=1, max_size=12))
        for i, d in enumerate(docs):
            files.append((f"f{i}{SUFFIX[lang]}", "".join(d)))
            want += [(files[-1][0], *t) for t in brace_scan(files[-1][1], lang)]
    got = sorted((f.path, f.name, f.start_line, f.end_line, f.body) for f in _run(spark, files))
    assert got == sorted(want)


def test_headers_that_hold_braces(spark):
    files = [("a.cpp", "int x;\nvoid f(std::vector<int> v = {}) {\n  g();\n}\nint h() { }\n"),
             ("b.rs", "fn f(Point { x, y }: Point) {\n  x\n}\n"),
             ("c.js", "x();\nfunction f({a, b}, {c} = {}) {\n  return a;\n}\nfunction g() {}\n")]
    got = [(f.path, f.name, f.signature, f.start_line, f.end_line, f.body) for f in _run(spark, files, extra=True)]
    assert got == [
        ("a.cpp", "f", "void f(std::vector<int> v = {})", 1, 4, "void f(std::vector<int> v = {}) {\n  g();\n}"),
        ("a.cpp", "h", "int h()", 4, 5, "int h() { }"),
        ("b.rs", "f", "fn f(Point { x, y }: Point)", 1, 3, "fn f(Point { x, y }: Point) {\n  x\n}"),
        ("c.js", "f", "function f({a, b}, {c} = {})", 1, 4, "function f({a, b}, {c} = {}) {\n  return a;\n}"),
        ("c.js", "g", "function g()", 4, 5, "function g() {}")]


def test_spans_without_bodies_and_chosen_languages(spark):
    files = spark.createDataFrame([("a.c", C_SRC), ("b.py", "def f():\n    pass\n"), ("c.rs", "fn t() {}\n"), ("d.c", None)],
                                  "path string, content string")
    full = X.extract_functions(files)
    assert sorted(X.extract_functions(files, bodies=False).collect()) == sorted(full.drop("body").collect())
    only = X.extract_functions(files, languages=["rust"])
    assert only.collect() == full.where("language = 'rust'").collect() and only.count() == 1
    assert X.extract_functions(files, languages=["cobol"]).count() == 0


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.tuples(st.integers(0, 3), st.sampled_from(PY_TOKENS)), max_size=30), min_size=1, max_size=16))
def test_line_plan_matches_scan(spark, docs):
    files = [(f"f{i}.py", "\n".join("  " * d + t for d, t in lines)) for i, lines in enumerate(docs)]
    got = sorted((f.path, f.name, f.start_line, f.end_line, f.body) for f in _run(spark, files))
    want = sorted((p, *t) for p, c in files for t in line_scan(c))
    assert got == want


def test_projects_that_share_a_path_stay_apart(spark):
    c = "int a1(int x)\n{\n  return %d;\n}\n"
    py = "def f():\n    return %d\n\ndef g(x):\n    return x\n"
    rows = [(f"p{i}", p, t % i) for i in (1, 2) for p, t in (("src/main.c", c), ("setup.py", py))]
    files = spark.createDataFrame(rows, "project_id string, path string, content string")
    for repartition in (True, False):
        out = X.extract_functions(files, repartition=repartition)
        got = sorted((r.project_id, r.path, r.fn_no, r.body) for r in out.collect())
        want = []
        for i in (1, 2):
            alone = X.extract_functions(files.where(F.col("project_id") == f"p{i}").drop("project_id"))
            want += [(f"p{i}", r.path, r.fn_no, r.body) for r in alone.collect()]
        assert got == sorted(want) and len(got) == 6
        assert {(r.project_id, r.path, len(r.functions)) for r in X.nested_by_file(out).collect()} == {
            (p, f, n) for p in ("p1", "p2") for f, n in (("src/main.c", 1), ("setup.py", 2))}
        counts = {r.language: (r.n_files, r.n_files_with_functions, r.n_functions)
                  for r in X.inventory_counts(files, out).collect()}
        assert counts == {"c": (2, 2, 2), "python": (2, 2, 4)}


def test_headers_are_cut_once(spark):
    files = spark.createDataFrame([("a.c", C_SRC)], "path string, content string")
    rows = X._brace_rows(X.label_files(files), X.BRACE_LANGUAGES)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    # one match list and one cut a language, not one for each generated row
    assert plan.count("regexp_extract_all(") == len(X.BRACE_LANGUAGES)
    assert "size(" not in plan.split("Generate", 1)[1]


def test_spans_take_no_window_over_braces_or_lines(spark):
    """A file is one row of small arrays on its way; braces and lines were rows of their own, sorted twice."""
    files = spark.createDataFrame([("p", "a.c", "int f(int a)\n{ if (a) { b; } }\n"), ("p", "b.py", "def f(x):\n    y\n\ndef g(x): z\n")],
                                  "project_id string, path string, content string")
    for bodies in (False, True):
        spans = X.extract_functions(files, bodies=bodies)
        plan = spans._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Join" not in plan
        got = {(r.path, r.name, r.start_line, r.end_line, r.start_pos, r.end_pos) for r in spans.collect()}
        assert got == {("a.c", "f", 1, 2, 0, 30), ("b.py", "f", 1, 3, 0, 16), ("b.py", "g", 4, 5, 17, 29)}


def test_words_of_headers_may_hold_the_mark_between_them(spark):
    files = spark.createDataFrame([("a.c", "int f(char a\x01b, int c) {\n}\nchar *g(int d) { }\n"), ("b.rs", "fn h(a: \x01i) { }\n")],
                                  "path string, content string")
    got = {(r.name, r.signature, r.body) for r in X.extract_functions(files).collect()}
    assert got == {("f", "int f(char a\x01b, int c)", "int f(char a\x01b, int c) {\n}"), ("g", "char * g(int d)", "char *g(int d) { }"),
                   ("h", "fn h(a: \x01i)", "fn h(a: \x01i) { }")}


def test_matching_in_steps_equals_one_step(monkeypatch):
    import pyarrow as pa

    from patchtrace.functions import spanning
    k = 7
    # a piece up to a header's brace, then the rest with the closing one
    cols = [pa.array([x] * k) for x in ([2], [1, 1], ["f", None], ["s", None], [5, 0], [0, 0], [0, 0], [6, 3], [0, 1], [1, 0])]
    match = spanning.brace_spans().func
    whole = match(*cols)
    monkeypatch.setattr(spanning, "STEP_MARKS", 3)
    assert match(*cols).to_pylist() == whole.to_pylist() == [[{
        "start_pos": 1, "end_pos": 9, "start_line": 1, "end_line": 2, "name": "f", "signature": "s", "_from": 0, "_n": 2}]] * k
