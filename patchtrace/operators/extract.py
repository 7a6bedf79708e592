"""Function inventory over a source corpus.

Set-based re-expression of the reference's per-file regex + brace loop:

*Brace plan* (C, C++, Java, Rust; also our C# and JavaScript headers). The comment-
stripped text is cut at its header matches, in the row that holds the text; the reference's
scan, too, resumes right after a match, whatever braces a parameter list holds. A header
ends at a ``{``. A file becomes one row of small arrays, without text: length and newlines up to
each brace, and the headers. The arrays of a path are grouped, and a vectorised step
(``functions.spanning``) gives each brace its end offset, depth and newline count. Braces of one depth
level alternate open/close, so the closing brace of an opening one is simply the next
brace of its level; no match means unbalanced and the candidate is dropped, as in the reference.

*Line plan* (Python). One number of each kind per line: length, indent, significance. The end of a
``def`` is the next significant line whose indent is at most the def's, found for all defs of one
indent by one binary search over the lines of at most that indent. A def is kept iff no earlier def
of the file reaches past it (running ``max``), which equals the reference's "resume the scan at the
end of the function". Our Ruby rule keeps one small row per line and windows over them.

Bodies: they are cut as slices of the text's own pieces or lines, so the cost is linear in the
text plus the bodies. Texts are hash-partitioned by file once, and are grouped with their marks there.
Without bodies no text is shuffled at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchtrace.functions.spanning import brace_spans, line_spans
from patchtrace.functions.text import S, W, count_char, py_lstrip, py_strip

# Fixed values of the reference: suffix -> language of the regex extractor.
LANGUAGE_SUFFIXES = {
    "c": [".c", ".h"],
    "cpp": [".cpp", ".cc", ".cxx", ".c++", ".hpp", ".hh", ".hxx", ".h++"],
    "python": [".py", ".pyx"],
    "java": [".java"],
    "rust": [".rs"],
}
# Our own heuristic rules for the syntax-tree tool's extra languages (re-aimed).
EXTRA_LANGUAGE_SUFFIXES = {
    "csharp": [".cs"],
    "javascript": [".js", ".mjs", ".cjs", ".jsx"],
    "ruby": [".rb"],
}

# Fixed values of the reference: header patterns of the regex extractor, written in
# the Java/RE2 common dialect (Python's Unicode \s is the class S).
C_HEADER = (
    f"(?:^|\\n){S}*"
    f"(?:(?:static|extern|inline|virtual|explicit|const|constexpr|template{S}*<[^>]*>){S}+)*"
    f"([a-zA-Z_][a-zA-Z0-9_]*(?:{S}*\\*{S}*|{S}*&{S}*|{S}+))"
    f"([a-zA-Z_][a-zA-Z0-9_]*){S}*"
    f"(\\([^)]*\\)){S}*"
    f"(?:const{S}*)?(?:override{S}*)?(?:final{S}*)?(?:noexcept{S}*)?"
    f"(?:throw{S}*\\([^)]*\\){S}*)?{S}*\\{{"
)
JAVA_HEADER = (
    f"(?:^|\\n){S}*"
    f"(?:(?:public|private|protected|static|final|abstract|synchronized|native|strictfp){S}+)*"
    f"([a-zA-Z_][a-zA-Z0-9_<>\\[\\]]*(?:{S}*\\*{S}*|{S}+))"
    f"([a-zA-Z_][a-zA-Z0-9_]*){S}*"
    f"(\\([^)]*\\)){S}*"
    f"(?:throws{S}+[a-zA-Z0-9_,{S[1:-1]}]+)?{S}*\\{{"
)
RUST_HEADER = (
    f"(?:^|\\n){S}*"
    f"(?:(?:pub|const|unsafe|extern|async){S}+)*"
    f"fn{S}+([a-zA-Z_][a-zA-Z0-9_]*){S}*"
    f"(?:<[^>]*>)?{S}*"
    f"(\\([^)]*\\)){S}*"
    f"(?:->{S}*[^{{]+)?{S}*\\{{"
)
PY_DEF = f"^({S}*)(def{S}+({W}+){S}*\\([^)]*\\){S}*(?:->{S}*[^:]+)?{S}*:)"

# Our own rules (not the reference's): C# methods, JavaScript function declarations,
# Ruby methods.
CS_HEADER = (
    f"(?:^|\\n){S}*"
    f"(?:\\[[^\\]\\n]*\\]{S}*)*"
    f"(?:(?:public|private|protected|internal|static|virtual|override|abstract|sealed|async|extern|unsafe|new|partial){S}+)+"
    f"([a-zA-Z_][a-zA-Z0-9_<>,.?\\[\\]]*{S}+)"
    f"([a-zA-Z_][a-zA-Z0-9_]*){S}*(?:<[^>]*>)?{S}*"
    f"(\\([^)]*\\)){S}*\\{{"
)
JS_HEADER = (
    f"(?:^|\\n){S}*"
    f"(?:export{S}+(?:default{S}+)?)?(?:async{S}+)?"
    f"(function{S}*\\*?{S}*)([a-zA-Z_$][a-zA-Z0-9_$]*){S}*"
    f"(\\([^)]*\\)){S}*\\{{"
)
RUBY_DEF = f"^({S}*)def{S}+((?:self\\.)?[a-zA-Z_][a-zA-Z0-9_]*[?!=]?)"
RUBY_END = f"^({S}*)end(?:[^a-zA-Z0-9_]|$)"

BRACE_RULES = {
    # language: (header pattern, name group, type/keyword group, params group, signature style)
    "c": (C_HEADER, 2, 1, 3, "typed"),
    "cpp": (C_HEADER, 2, 1, 3, "typed"),
    "java": (JAVA_HEADER, 2, 1, 3, "typed"),
    "rust": (RUST_HEADER, 1, 0, 2, "rust"),
    "csharp": (CS_HEADER, 2, 1, 3, "typed"),
    "javascript": (JS_HEADER, 2, 1, 3, "typed"),
}

FUNCTION_COLUMNS = ["path", "fn_no", "name", "signature", "body", "start_line", "end_line", "language",
                    "start_pos", "end_pos"]


def _typed(df: DataFrame) -> DataFrame:
    types = {"fn_no": "int", "start_line": "int", "end_line": "int", "start_pos": "long", "end_pos": "long"}
    return df.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c)
                       for c in FUNCTION_COLUMNS if c in df.columns])


def suffix(path: str = "path") -> Column:
    """Lower-cased final suffix of the file name (``Path.suffix.lower()``)."""
    return F.lower(F.regexp_extract(F.col(path), r"[^/](\.[^./]+)$", 1))


def _label(sfx: Column, table: dict[str, list[str]]) -> Column:
    out = None
    for lang, exts in table.items():
        cond = sfx.isin(exts)
        out = F.when(cond, F.lit(lang)) if out is None else out.when(cond, F.lit(lang))
    return out.otherwise(F.lit(None).cast("string"))


def language_label(path: str = "path", extra: bool = False) -> Column:
    """language by lower-cased suffix; null = not a supported file."""
    table = dict(LANGUAGE_SUFFIXES, **(EXTRA_LANGUAGE_SUFFIXES if extra else {}))
    return _label(suffix(path), table)


def strip_comments(c: Column) -> Column:
    """``//`` to end of line first, then ``/* ... */`` (lazy, across lines)."""
    return F.regexp_replace(F.regexp_replace(c, r"//[^\n]*", ""), r"(?s)/\*.*?\*/", "")


def label_files(files: DataFrame, extra: bool = False) -> DataFrame:
    return files.withColumn("language", language_label("path", extra)).where(F.col("language").isNotNull())


def partition_files(files: DataFrame) -> DataFrame:
    """Hash-partition the file table by its key; the size of the parts is left to AQE."""
    return files.repartition("path")


def _by_language(languages: list[str], make) -> Column:
    """One CASE over the language column; only the file's own rule is evaluated."""
    out = None
    for lang in languages:
        cond = F.col("language") == lang
        out = F.when(cond, make(lang)) if out is None else out.when(cond, make(lang))
    return out


def _assemble(spans: DataFrame, texts: DataFrame, pieces: Column, body: Column, bodies: bool) -> DataFrame:
    """Number the spans of each file and cut their bodies.

    ``spans`` has the columns of the result without ``fn_no`` and ``body``, and the piece
    numbers ``_from`` and ``_n``; ``texts`` has (path, language, content). ``pieces`` is the
    array the content is cut into, once per file, and ``body`` the body made of ``_p``, a
    span's slice of it.
    """
    fields = ["start_pos", "end_pos", "start_line", "end_line", "name", "signature", "_from", "_n", "_skip"]
    per_file = spans.groupBy("path", *([] if bodies else ["language"])).agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("_fns"))
    if not bodies:
        return per_file.select("path", "language", F.posexplode("_fns").alias("fn_no", "_f")).select(
            "path", "language", "fn_no", "_f.*").transform(_typed)
    # the language comes from the text side: both sides then read the same columns of the
    # partitioned table, so its exchange is reused
    j = per_file.join(texts.select("path", "language", "content").hint("merge"), "path")
    j = j.select("path", "language", "_fns", pieces.alias("_pieces"))
    j = j.select("path", "language", "_pieces", F.posexplode("_fns").alias("fn_no", "_f"))
    j = j.select("path", "language", "fn_no", "_f.*", F.slice("_pieces", F.col("_f._from") + 1, F.col("_f._n")).alias("_p"))
    return j.withColumn("body", body).transform(_typed)


def _grouped(files: DataFrame, marks: Column, bodies: bool) -> DataFrame:
    """One row per path: the marks of its rows, their texts too if ``bodies``. Rows are grouped as small arrays."""
    held = [marks.alias("marks")] + ([F.col("content")] if bodies else [])
    return files.groupBy("path", "language").agg(F.collect_list(F.struct(*held)).alias("_f"))


def _numbered(per_file: DataFrame, spans: Column, pieces: Column, body: Column, bodies: bool) -> DataFrame:
    """Number the spans of each file and cut their bodies from each of its texts (see ``_assemble``)."""
    key = ["path", "language"]
    if not bodies:
        j = per_file.select(*key, F.array_sort(spans).alias("_fns"))
        return j.select(*key, F.posexplode("_fns").alias("fn_no", "_f")).select(*key, "fn_no", "_f.*").transform(_typed)
    j = per_file.select(*key, F.col("_f.content").alias("_texts"), F.array_sort(spans).alias("_fns"))
    j = j.where(F.size("_fns") > 0).select(*key, "_fns", F.explode("_texts").alias("content"))
    j = j.select(*key, "_fns", pieces.alias("_pieces")).select(*key, "_pieces", F.posexplode("_fns").alias("fn_no", "_f"))
    j = j.select(*key, "fn_no", "_f.*", F.slice("_pieces", F.col("_f._from") + 1, F.col("_f._n")).alias("_p"))
    return j.withColumn("body", body).transform(_typed)


def _at_braces(c: str = "content") -> Column:
    return F.split(F.col(c), "(?<=[{}])", -1)


def _brace_marks(code: DataFrame, languages: list[str], keep: list[str]) -> DataFrame:
    """path, language, ``keep``... and ``_m``: a file's pieces, each up to a header's brace, and its braces, without
    text: see ``spanning.brace_spans``."""
    headers = _by_language(languages, lambda lg: F.regexp_extract_all("content", F.lit(BRACE_RULES[lg][0]), 0))
    between = _by_language(languages, lambda lg: F.split("content", BRACE_RULES[lg][0], -1))
    cut = code.select("path", "language", *keep, _at_braces().alias("_s"), F.arrays_zip(between, headers).alias("_z"))

    def words(lang):
        _, name, kind, params, _ = BRACE_RULES[lang]
        return f"${name}\x01{f'${kind}' if kind else 'fn'}\x01${params}"

    def read(z):
        # one match gives a header's words: names and kinds hold no \x01
        header = z.getField("1")
        found = _by_language(languages, lambda lg: F.regexp_replace(header, F.lit(BRACE_RULES[lg][0]), F.lit(words(lg))))
        return F.struct(z.getField("0").alias("before"), header.alias("header"), F.split(found, "\x01", 3).alias("w"),
                        F.coalesce(count_char(header, "{") + count_char(header, "}"), F.lit(0)).alias("inside"))

    def piece(z):
        before, header, w = z["before"], z["header"], z["w"]
        return F.struct((count_char(before, "{") + count_char(before, "}") + z["inside"]).alias("count"), F.get(w, F.lit(0)).alias("name"),
                        py_strip(F.concat(py_strip(F.get(w, F.lit(1))), F.lit(" "), F.get(w, F.lit(0)), F.get(w, F.lit(2)))).alias("signature"),
                        F.coalesce(F.length(header), F.lit(0)).alias("length"),
                        F.coalesce(count_char(header, "\n"), F.lit(0)).alias("breaks"), (z["inside"] - 1).alias("inner"))

    def empty(c):
        return F.coalesce(c, F.array().cast("array<int>"))

    # what follows the last brace counts for nothing
    seg = F.slice("_s", F.lit(1), F.size("_s") - 1)
    pieces = F.transform(F.transform(F.filter("_z", lambda z: z.getField("0").isNotNull()), read), piece)
    nothing = F.array().cast("array<struct<count:int,name:string,signature:string,length:int,breaks:int,inner:int>>")
    return cut.select("path", "language", *keep, F.struct(
        F.coalesce(pieces, nothing).alias("pieces"), empty(F.transform(seg, F.length)).alias("n"),
        empty(F.transform(seg, lambda x: count_char(x, "\n"))).alias("nl"),
        empty(F.transform(seg, lambda x: x.endswith("{").cast("int"))).alias("opens")).alias("_m"))


def _brace_rows(code: DataFrame, languages: list[str]) -> DataFrame:
    """One row per brace of each file, without text: length and newlines since the
    previous brace and, for one that ends a header, that header."""
    headers = _by_language(languages, lambda lg: F.regexp_extract_all("content", F.lit(BRACE_RULES[lg][0]), 0))
    between = _by_language(languages, lambda lg: F.split("content", BRACE_RULES[lg][0], -1))
    # the text is its first piece, first header, second piece, ... and last piece; both arrays are
    # made once, as one generated array (the outer form: no second evaluation for a size filter)
    pieces = code.select("path", "language", F.posexplode_outer(F.arrays_zip(between, headers)).alias("k", "_z"))
    pieces = pieces.select("path", "language", "k", F.col("_z").getField("0").alias("_before"),
                           F.col("_z").getField("1").alias("_m")).where("_before is not null")

    def group(which):
        def make(lang):
            idx = BRACE_RULES[lang][which]
            return F.regexp_extract("_m", BRACE_RULES[lang][0], idx) if idx else F.lit("fn")
        return F.when(F.col("_m").isNotNull(), _by_language(languages, make))

    heads = pieces.select("path", "language", "k", F.concat("_before", F.coalesce("_m", F.lit(""))).alias("piece"),
                          group(1).alias("name"), group(2).alias("_kind"), group(3).alias("_params"),
                          F.length("_m").alias("_len"), count_char("_m", "\n").alias("_nl"),
                          (count_char("_m", "{") + count_char("_m", "}") - 1).alias("_inner"))
    heads = heads.withColumn("signature", py_strip(F.concat(py_strip(F.col("_kind")), F.lit(" "), F.col("name"), F.col("_params"))))
    segs = heads.select("path", "language", "k", "name", "signature", "_len", "_nl", "_inner",
                        F.split(F.col("piece"), "(?<=[{}])", -1).alias("_s"))
    rows = segs.select("path", "language", "k", "name", "signature", "_len", "_nl", "_inner",
                       (F.size("_s") - 2).alias("_last"), F.posexplode_outer("_s").alias("j", "seg"))
    is_open = F.col("seg").endswith("{")
    rows = rows.where(is_open | F.col("seg").endswith("}"))
    return rows.select("path", "language", "k", "j", is_open.alias("is_open"), F.length("seg").alias("n"),
                       count_char("seg", "\n").alias("nl"),
                       *[F.when(F.col("j") == F.col("_last"), F.col(c)).alias(c) for c in ("name", "signature", "_len", "_nl", "_inner")])


def brace_functions(files: DataFrame, languages: list[str], stripped: bool = False, bodies: bool = True) -> DataFrame:
    """F3-F5 (+ our C#/JS): functions of brace languages, bodies cut from the
    comment-stripped text. ``files`` has (path, language, content); with ``stripped``
    the content is already comment-stripped."""
    text = F.col("content") if stripped else strip_comments(F.col("content"))
    code = files.where(F.col("language").isin(languages)).select("path", "language", text.alias("content"))
    per_file = _grouped(_brace_marks(code, languages, ["content"] if bodies else []), F.col("_m"), bodies)
    pieces, flat = F.flatten("_f.marks.pieces"), [F.flatten(f"_f.marks.{c}") for c in ("n", "nl", "opens")]
    spans = brace_spans()(F.transform("_f", lambda x: F.size(x["marks"]["pieces"])),
                          *[pieces.getField(c) for c in ("count", "name", "signature", "length", "breaks", "inner")], *flat)
    body = py_strip(F.right(F.array_join("_p", ""), (F.col("end_pos") - F.col("start_pos")).cast("int")))
    return _numbered(per_file, spans, _at_braces(), body, bodies)


def _line_table(files: DataFrame, *marks: Column) -> DataFrame:
    """One row per line without its text: number, offset, length, indent, significance and ``marks``."""
    # the line count is the size of the split array, taken in the row (no window)
    arr = files.select("path", "language", F.length("content").alias("n_chars"), F.split(F.col("content"), "\n", -1).alias("_a"))
    lines = arr.select("path", "language", "n_chars", F.size("_a").alias("n_lines"), F.posexplode("_a").alias("ln", "line"))
    stripped = py_strip(F.col("line"))
    rows = lines.select("path", "language", "n_chars", "n_lines", "ln", F.length("line").alias("n"),
                        ((stripped != "") & ~stripped.startswith("#")).alias("sig"),
                        (F.length("line") - F.length(py_lstrip(F.col("line")))).alias("indent"), *marks)
    w = Window.partitionBy("path").orderBy("ln").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("off", F.sum(F.col("n") + 1).over(w) - F.col("n") - 1)


def python_functions(files: DataFrame, bodies: bool = True) -> DataFrame:
    """top-level-in-scan Python defs; a def ends before the first later significant
    line indented at most as far as the def; nested defs are not emitted."""
    texts = files.where(F.col("language") == "python").select("path", "language", "content")
    keep = ["content"] if bodies else []
    arr = texts.select("path", "language", *keep, F.coalesce(F.length("content"), F.lit(0)).alias("_n"),
                       F.coalesce(F.split("content", "\n", -1), F.array().cast("array<string>")).alias("_a"))
    # a line's own text is taken once, whatever is made of it
    arr = arr.withColumn("_l", F.transform("_a", lambda x: F.struct(F.length(x).alias("n"), py_lstrip(x).alias("t"))))
    is_def = F.filter(F.transform("_a", lambda x, i: F.struct(i.cast("int").alias("line"), x.alias("x"))),
                      lambda d: py_lstrip(d["x"]).startswith("def"))
    defs = F.filter(F.transform(is_def, lambda d: F.struct(
        d["line"].alias("line"), F.regexp_extract(d["x"], PY_DEF, 3).alias("name"),
        F.regexp_extract(d["x"], PY_DEF, 2).alias("signature"))), lambda d: d["signature"] != "")
    marks = arr.select("path", "language", *keep, F.struct(
        F.col("_n").alias("chars"), F.size("_a").alias("lines"), F.col("_l.n").alias("n"),
        F.transform("_l", lambda x: x["n"] - F.length(x["t"])).alias("indent"),
        F.transform("_l", lambda x: ((x["t"] != "") & ~x["t"].startswith("#")).cast("int")).alias("sig"),
        F.transform(defs, lambda d: F.struct(d["line"].alias("line"), d["name"].alias("name"),
                                             py_strip(d["signature"]).alias("signature"))).alias("defs")).alias("_m"))
    per_file = _grouped(marks, F.col("_m"), bodies)
    found = F.flatten("_f.marks.defs")
    spans = line_spans()(F.col("_f.marks.chars"), F.col("_f.marks.lines"), *[F.flatten(f"_f.marks.{c}") for c in ("n", "indent", "sig")],
                         F.transform("_f", lambda x: F.size(x["marks"]["defs"])),
                         *[found.getField(c) for c in ("line", "name", "signature")])
    return _numbered(per_file, spans, F.split(F.col("content"), "\n", -1), F.array_join("_p", "\n"), bodies)


def ruby_functions(files: DataFrame, bodies: bool = True) -> DataFrame:
    """F10 Ruby (our rule): ``def`` up to the next ``end`` line at the same indent;
    nested methods are emitted too (the syntax tree reports every method node)."""
    texts = files.where(F.col("language") == "ruby").select("path", "language", "content")
    is_def = F.col("line").rlike(RUBY_DEF)
    lines = _line_table(texts, is_def.alias("is_def"), F.col("line").rlike(RUBY_END).alias("is_end"),
                        F.when(is_def, F.regexp_extract("line", RUBY_DEF, 2)).alias("name"),
                        F.when(is_def, py_strip(F.col("line"))).alias("signature"))
    marks = lines.where("is_def OR is_end")
    v = (Window.partitionBy("path", "indent").orderBy(F.col("ln").desc())
         .rowsBetween(Window.unboundedPreceding, -1))
    marks = marks.select("*", F.last(F.when(~F.col("is_def"), F.col("ln")), ignorenulls=True).over(v).alias("end_ln"),
                         F.last(F.when(~F.col("is_def"), F.col("off") + F.col("n")), ignorenulls=True).over(v).alias("end_off"))
    spans = marks.where("is_def AND end_ln IS NOT NULL").select(
        "path", "language", "name", "signature",
        (F.col("off") + F.col("indent")).alias("start_pos"), F.col("end_off").alias("end_pos"),
        (F.col("ln") + 1).alias("start_line"), (F.col("end_ln") + 1).alias("end_line"),
        F.col("ln").alias("_from"), (F.col("end_ln") - F.col("ln") + 1).alias("_n"), F.col("indent").alias("_skip"))
    body = F.array_join("_p", "\n")
    return _assemble(spans, texts, F.split(F.col("content"), "\n", -1), F.substring(body, F.col("_skip") + 1, F.length(body)), bodies)


BRACE_LANGUAGES = ["c", "cpp", "java", "rust"]
EXTRA_BRACE_LANGUAGES = ["csharp", "javascript"]


def extract_functions(files: DataFrame, extra: bool = False, repartition: bool = True,
                      languages: list[str] | None = None, bodies: bool = True) -> DataFrame:
    """All functions of a ``([project_id,] path, content)`` corpus (other columns are ignored).

    With a ``project_id`` a file is known by project and path, which then is the key of
    every shuffle, window and join, and the result carries both columns. ``languages``
    keeps these languages only and plans nothing for the others. ``bodies=False`` leaves
    the body column out, and then no text is shuffled.

    Brace-language files are comment-stripped before the one shuffle by path, so the
    strip runs once per file and only the stripped text travels."""
    brace = BRACE_LANGUAGES + (EXTRA_BRACE_LANGUAGES if extra else [])
    known = brace + ["python"] + (["ruby"] if extra else [])
    wanted = known if languages is None else [x for x in known if x in languages]
    projects = "project_id" in files.columns
    f = label_files(files.select(*_file_key(files), "content"), extra)
    if projects:
        f = f.select(F.struct("project_id", "path").alias("path"), "language", "content")

    def family(langs, strip):
        g = f.where(F.col("language").isin(langs))
        g = g.select("path", "language", strip_comments(F.col("content")).alias("content")) if strip else g
        return partition_files(g) if repartition and bodies else g

    parts = []
    if not wanted:
        f, wanted = f.where("false"), brace
    some = [x for x in brace if x in wanted]
    if some:
        parts.append(brace_functions(family(some, True), some, stripped=True, bodies=bodies))
    if "python" in wanted:
        parts.append(python_functions(family(["python"], False), bodies))
    if "ruby" in wanted:
        parts.append(ruby_functions(family(["ruby"], False), bodies))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    if projects:
        rest = [c for c in out.columns if c != "path"]
        out = out.select(F.col("path.project_id").alias("project_id"), F.col("path.path").alias("path"), *rest)
    return out


def _file_key(df: DataFrame) -> list[str]:
    return ["project_id", "path"] if "project_id" in df.columns else ["path"]


def nested_by_file(functions: DataFrame) -> DataFrame:
    """The functions of each file as one ordered array (the JSON output shape)."""
    rec = F.struct("fn_no", "name", "signature", "body", "start_line", "end_line", "language")
    return (functions.groupBy(*_file_key(functions))
                     .agg(F.array_sort(F.collect_list(rec)).alias("functions")))


def inventory_counts(files: DataFrame, functions: DataFrame, extra: bool = False) -> DataFrame:
    """per language, supported files found, files with at least one function,
    and functions found."""
    key = [c for c in _file_key(files) if c in functions.columns]
    f = label_files(files.select(*key), extra)
    per_file = functions.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    j = f.join(per_file, key, "left")
    return (j.groupBy("language")
             .agg(F.count(F.lit(1)).alias("n_files"),
                  F.count("_n").alias("n_files_with_functions"),
                  F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("n_functions")))
