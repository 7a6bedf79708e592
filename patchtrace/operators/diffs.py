"""Diff mining: cut commit diffs into parts and rebuild the pre-fix code.

The reference walks the lines of one diff with a state machine. Here the state is
read off the text itself, inside the row, so the whole operator is narrow (no shuffle,
no window): a diff row is split at the lines that open a file section whose header
names a path ("path groups"); each group is split at the lines that open a section
(``diff --git`` or ``@@``); sections opened by ``@@`` are hunks. A commit of any size
stays in the task that read it, and no group of lines is gathered across rows.

* the diff is stripped at both ends, then split on '\\n';
* a ``diff --git`` line with at least four whitespace fields sets the path to the
  fourth field minus its first two characters; shorter ones keep the previous path;
* a ``@@`` line opens a hunk; text after its second ``@@`` (stripped) is a first
  context line; the hunk holds every following line up to the next section start,
  except lines that begin with ``index``;
* a hunk becomes a part when the path is non-empty and the hunk holds a line;
* the old version drops ``+`` lines, strips one character from ``-`` and `` `` lines
  and keeps every other line whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchtrace.functions.text import NS, S, WS, py_split_ws, py_strip

# whitespace without the line break, for patterns that must stay on one line
S_NO_NL = "[" + WS.replace(r"\n", "") + "]"
# a `diff --git` line that has at least four whitespace-separated fields
PATH_LINE = f"diff --git{NS}*(?:{S_NO_NL}+{NS}+){{2}}"
GROUP_SPLIT = f"\\n(?={PATH_LINE})"
SECTION_SPLIT = "\\n(?=diff --git|@@)"

DIFF_KEYS = ["repo_url", "commit_hash"]


def _group_path(g: Column) -> Column:
    first = F.substring_index(g, "\n", 1)
    field4 = F.get(py_split_ws(first), 3)
    return F.when(g.rlike("^" + PATH_LINE), F.substring(field4, F.lit(3), F.length(field4)))


def _hunk_lines(seg: Column) -> Column:
    """Lines of the section after its header that belong to the hunk."""
    lines = F.split(seg, "\n", -1)
    return F.filter(F.slice(lines, F.lit(2), F.size(lines)), lambda x: ~x.startswith("index"))


def _header_context(seg: Column) -> Column:
    header = F.substring_index(seg, "\n", 1)
    third = F.get(F.split(header, "@@", -1), 2)
    return F.coalesce(py_strip(third), F.lit(""))


def diff_parts(diffs: DataFrame, text: str = "diff_text", keep: list[str] | None = None) -> DataFrame:
    """One row per part: part_no, file, diff_part (+ ``keep`` columns).

    ``part_no`` is the 0-based index of the part in its diff, in diff order.
    """
    keep = DIFF_KEYS if keep is None else keep
    t = py_strip(F.col(text))
    groups = F.split(t, GROUP_SPLIT, -1)
    # the path is read once per file section, then given to each of its hunks
    files = F.transform(groups, lambda g: F.struct(_group_path(g).alias("file"),
                                                   F.split(g, SECTION_SPLIT, -1).alias("segs")))
    items = F.flatten(F.transform(files, lambda f: F.transform(
        f["segs"], lambda s: F.struct(f["file"].alias("file"), s.alias("seg")))))
    hunks = F.filter(items, lambda x: x["seg"].startswith("@@")
                     & x["file"].isNotNull() & (x["file"] != "")
                     & ((_header_context(x["seg"]) != "") | (F.size(_hunk_lines(x["seg"])) > 0)))
    return (diffs.select(*keep, F.posexplode(hunks).alias("part_no", "h"))
                 .select(*keep, "part_no", F.col("h.file").alias("file"), F.col("h.seg").alias("diff_part")))


def with_old_version(parts: DataFrame, part: str = "diff_part") -> DataFrame:
    """D3 + D5: add ``old_version``, the pre-change text of the hunk."""
    seg = F.col(part)
    ctx = _header_context(seg)
    kept = F.filter(_hunk_lines(seg), lambda x: ~x.startswith("+"))
    old = F.transform(kept, lambda x: F.when(x.startswith("-") | x.startswith(" "), F.substring(x, F.lit(2), F.length(x)))
                      .otherwise(x))
    lines = F.when(ctx != "", F.concat(F.array(ctx), old)).otherwise(old)
    return parts.withColumn("old_version", F.array_join(lines, "\n"))


def with_line_counts(parts: DataFrame, part: str = "diff_part") -> DataFrame:
    """The +/-/context/other split of each hunk's lines, as counts."""
    body = _hunk_lines(F.col(part))
    return (parts
            .withColumn("n_added", F.size(F.filter(body, lambda x: x.startswith("+"))))
            .withColumn("n_removed", F.size(F.filter(body, lambda x: x.startswith("-"))))
            .withColumn("n_context", F.size(F.filter(body, lambda x: x.startswith(" "))))
            .withColumn("n_other", F.size(F.filter(body, lambda x: ~(x.startswith("+") | x.startswith("-")
                                                                     | x.startswith(" "))))))


def fragment_id(part_no: str = "part_no", file: str = "file") -> Column:
    """S8 name of a part: ``part_<i>_<path with / replaced by _>``."""
    return F.concat(F.lit("part_"), F.col(part_no).cast("string"), F.lit("_"),
                    F.replace(F.col(file), F.lit("/"), F.lit("_")))


def hunk_sides(part: str = "diff_part") -> Column:
    """A hunk's lines as one struct: ``removed`` and ``added`` ones without their sign, and those
    ``around`` that stay, the header's context first."""
    def without_sign(lines: Column, sign: str) -> Column:
        return F.transform(F.filter(lines, lambda x: x.startswith(sign)), lambda x: F.substring(x, F.lit(2), F.length(x)))

    def sides(lines: Column) -> Column:
        stay = F.filter(lines, lambda x: ~(x.startswith("+") | x.startswith("-")))
        return F.struct(without_sign(lines, "-").alias("removed"), without_sign(lines, "+").alias("added"),
                        F.concat(F.array(_header_context(F.col(part))), stay).alias("around"))

    # the lines are cut once, whatever is made of them
    return F.get(F.transform(F.array(_hunk_lines(F.col(part))), sides), F.lit(0))
