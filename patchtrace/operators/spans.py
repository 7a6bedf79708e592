"""Syntax-tree tool outputs: spans from parse dumps (F11), slices by span (F12) and
latest record per file (F13).

The parser itself is a per-file external program and is not re-run here; its text
dumps are an input table ``(file_path, dump)``. Everything after the parser is a Spark job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchtrace.functions.text import S

# Fixed values of the reference: file suffix -> syntax node kind of a function.
SUFFIX_NODE_KIND = {
    ".c": "function_definition", ".h": "function_definition", ".cc": "function_definition",
    ".cpp": "function_definition", ".hpp": "function_definition", ".cxx": "function_definition",
    ".hxx": "function_definition", ".cs": "method_declaration", ".java": "method_declaration",
    ".js": "function_declaration", ".mjs": "function_declaration", ".cjs": "function_declaration",
    ".jsx": "function_declaration", ".py": "function_definition", ".rb": "method",
    ".rs": "function_item",
}


def node_pattern(kind: str) -> str:
    """The dump pattern of one node kind: ``(kind [r, c] - [r, c]``."""
    return f"\\({kind}{S}+\\[([0-9]+),{S}*([0-9]+)\\]{S}*-{S}*\\[([0-9]+),{S}*([0-9]+)\\](?s:.*?)\\)"


def file_suffix(path: str = "file_path") -> Column:
    """``os.path.splitext`` suffix, lower-cased (one rule for both tools, Q18)."""
    return F.lower(F.regexp_extract(F.col(path), r"[^/](\.[^./]+)$", 1))


def node_kind(path: str = "file_path") -> Column:
    sfx = file_suffix(path)
    out = None
    for s, k in SUFFIX_NODE_KIND.items():
        out = F.when(sfx == s, F.lit(k)) if out is None else out.when(sfx == s, F.lit(k))
    return out


def dump_spans(dumps: DataFrame, path: str = "file_path", dump: str = "dump") -> DataFrame:
    """every function node of the file's kind, nested ones included, in dump order.

    One extract per kind present in ``SUFFIX_NODE_KIND``; each row only evaluates its
    own kind."""
    kinds = sorted(set(SUFFIX_NODE_KIND.values()))
    d = dumps.withColumn("_kind", node_kind(path)).where(F.col("_kind").isNotNull())
    found = None
    for k in kinds:
        e = F.when(F.col("_kind") == k, F.regexp_extract_all(F.col(dump), F.lit(node_pattern(k)), 0))
        found = e if found is None else F.coalesce(found, e)
    d = d.select(path, F.posexplode(found).alias("span_no", "_node"))
    num = r"\[([0-9]+),[^0-9]*([0-9]+)\][^\[]*\[([0-9]+),[^0-9]*([0-9]+)\]"
    return d.select(path, "span_no",
                    F.regexp_extract("_node", num, 1).cast("int").alias("start_row"),
                    F.regexp_extract("_node", num, 2).cast("int").alias("start_col"),
                    F.regexp_extract("_node", num, 3).cast("int").alias("end_row"),
                    F.regexp_extract("_node", num, 4).cast("int").alias("end_col"))


def slice_spans(spans: DataFrame, files: DataFrame, path: str = "file_path", content: str = "content") -> DataFrame:
    """text between (start_row, start_col) and (end_row, end_col), 0-based, end
    exclusive, columns counted in characters and clamped to their line (line breaks
    belong to their line, as with ``readlines``). Spans that name a row the file does not
    have are left out.

    The spans of a file are gathered in one row and joined once with its text, which is
    cut into lines once; each span is a slice of them."""
    fields = ["span_no", "start_row", "start_col", "end_row", "end_col"]
    per_file = spans.groupBy(path).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_spans"))
    j = per_file.join(files.select(path, content), path)
    j = j.select(path, "_spans", F.split(F.col(content), "\n", -1).alias("_lines"))
    j = j.select(path, "_lines", F.size("_lines").alias("_rows"), F.explode("_spans").alias("_s")).select(path, "_lines", "_rows", "_s.*")
    j = j.where((F.col("start_row") < F.col("_rows")) & (F.col("end_row") < F.col("_rows")))
    j = j.select(path, *fields, "_rows", F.slice("_lines", F.col("start_row") + 1,
                                                 F.greatest(F.col("end_row") - F.col("start_row") + 1, F.lit(0))).alias("_p"))
    first, last = F.length(F.get("_p", F.lit(0))), F.length(F.get("_p", F.size("_p") - 1))
    text = F.concat(F.array_join("_p", "\n"), F.when(F.col("end_row") < F.col("_rows") - 1, "\n").otherwise(""))
    a = F.least(F.col("start_col"), first + 1)
    b = F.length(F.array_join("_p", "\n")) - last + F.least(F.col("end_col"), last + 1)
    return j.select(path, *fields, F.when((F.size("_p") > 0) & (b > a), F.substring(text, a + 1, b - a)).otherwise(F.lit("")).alias("contents"))


def file_records(slices: DataFrame, path: str = "file_path") -> DataFrame:
    """One record per file, {file_path, functions: [{start, end, contents}]} in span order."""
    def at(row, col):
        return F.struct(F.col(row).alias("row"), F.col(col).alias("column"))
    rec = F.struct("span_no", at("start_row", "start_col").alias("start"), at("end_row", "end_col").alias("end"), "contents")
    g = slices.groupBy(path).agg(F.array_sort(F.collect_list(rec)).alias("_r"))
    return g.select(F.col(path).alias("file_path"),
                    F.transform("_r", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"),
                                                         x["contents"].alias("contents"))).alias("functions"))


def latest_per_key(records: DataFrame, key: str = "file_path", seq: str = "seq") -> DataFrame:
    """a later record for a key replaces the earlier one; of equally late records the
    greatest (columns compared in order) stays.

    ``max_by`` is a partial aggregate: each task reduces its own rows per key before the
    shuffle, so a key holding a large share of the records costs one row per task."""
    cols = [c for c in records.columns if c != key]
    best = F.max_by(F.struct(*cols), F.struct(F.col(seq), *[c for c in cols if c != seq]))
    return records.groupBy(key).agg(best.alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])
