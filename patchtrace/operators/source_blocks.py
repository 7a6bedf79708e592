"""Brace-language functions of source files of any size: prefix scans over blocks.

``extract.brace_functions`` strips a file's comments and finds its headers in one row, and sorts
the braces of a file in one task. Here a file is many rows, numbered blocks of whole lines
(``blocks.text_blocks`` or ``blocks.read_blocks``), and three small scans say what a block begins in:

1. *comments*: a block maps "outside / inside ``/* */``" to the state behind it; it sets the state,
   keeps it or (``/*/``) swaps it, so the state before a block is the last one set, swapped as often
   as blocks since then say. An opening without an end is no comment, as in the row plan.
2. *safe ends*: no header match goes on over a line end behind ``;``, ``{`` or ``}`` unless a
   parenthesis, an angle bracket or a Rust arrow is open there; which of them are open before a block is
   the last such mark before it. Blocks are cut at their first and last safe end: what lies between
   is a chunk of its own, the pieces at the edges are shuffled and joined to chunks.
3. *braces*: a chunk's change of depth, length and newlines are summed over the chunks before. A brace's
   partner is the next brace of its level in the chunk; only the first and last brace of each level of a
   chunk look for theirs across chunks.

Bodies are slices of the chunks, joined where a function lies in several. Same rows as
``extract.brace_functions``; tested against it for many block sizes. Null texts have no blocks and no
functions; a file without functions gives no row. A text without any safe end is one chunk.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from patchtrace.functions.text import count_char, py_strip
from patchtrace.operators.extract import _brace_rows, _typed

ALL_COMMENTS = r"(?s)/\*.*?\*/"
#: Marks that open or close what a header match may go on in, by language; the arrow is Rust's only.
ROUND, ARROW = r"[()]", r"->|\{"
ANGLE = {"c": "template|>", "cpp": "template|>", "rust": "[<>]", "csharp": "[<>]"}
_OPEN = {"(", "<", "template", "->"}
_SAFE = r"[;{}](?=[ \t\r]*\n)"
_TO_THE_END = (1 << 31) - 1


#: The key of a file (a path has one language); ``blocks.text_blocks`` with this key deals the texts out as the joins below need them.
FILE = ["path", "language"]


def _before(by: str):
    return Window.partitionBy(*FILE).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)


def strip_block_comments(blocks: DataFrame) -> DataFrame:
    """F2 over blocks: (path, language, block_no, text); the texts of a file joined are its stripped text."""
    src = blocks.select("path", "language", "block_no", F.regexp_replace("block", r"//[^\n]*", "").alias("_line"))
    closed = F.col("_line").contains("*/")
    rest = F.regexp_extract("_line", r"(?s)\*/(.*)", 1)

    def opens(c: Column) -> Column:
        return F.regexp_replace(c, ALL_COMMENTS, "").contains("/*")

    effect = src.select(*FILE, "block_no", closed.alias("_closed"), opens(F.col("_line")).alias("_to0"),
                        (~closed | opens(rest)).alias("_to1"))
    swap = (F.col("_to0") & ~F.col("_to1")).cast("int")
    whole = Window.partitionBy(*FILE)
    upto = whole.orderBy("block_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    effect = effect.select("*", F.sum(swap).over(upto).alias("_swaps"), swap.alias("_swap"))
    known = F.when(F.col("_to0") == F.col("_to1"), F.struct(F.col("_to0").alias("v"), F.col("_swaps").alias("n")))
    effect = effect.select("*", F.last(known, ignorenulls=True).over(_before("block_no")).alias("_set"))
    swapped = (F.col("_swaps") - F.col("_swap") - F.coalesce("_set.n", F.lit(0))) % 2 == 1
    effect = effect.withColumn("_in", F.coalesce("_set.v", F.lit(False)) != swapped)
    effect = effect.withColumn("_out", F.when(F.col("_in"), F.col("_to1")).otherwise(F.col("_to0")))
    opened = F.when(F.col("_out") & (~F.col("_in") | F.col("_closed")), F.col("block_no"))
    effect = effect.select("*", F.max(F.struct("block_no", "_out")).over(whole).alias("_end"),
                           F.max(opened).over(whole).alias("_at"))
    # the block whose opening has no end, and those behind it, keep their text
    endless = F.when(F.col("_end._out"), F.col("_at"))
    effect = effect.select(*FILE, "block_no", "_in", "_out", (F.col("block_no") < F.col("_end.block_no")).alias("_more"),
                           F.coalesce(F.col("block_no") > endless, F.lit(False)).alias("_behind"),
                           F.coalesce(F.col("block_no") >= endless, F.lit(False)).alias("_kept"))
    j = src.join(effect, [*FILE, "block_no"])
    live = F.regexp_replace(F.when(F.col("_in"), rest).otherwise(F.col("_line")), ALL_COMMENTS, "")
    text = (F.when(F.col("_behind"), F.col("_line")).when(F.col("_out") & ~F.col("_kept"), F.substring_index(live, "/*", 1))
            .otherwise(live))
    end = F.when(F.col("_more") & (~F.col("_out") | F.col("_kept")), F.lit("\n")).otherwise(F.lit(""))
    return j.select("path", "language", "block_no", F.concat(text, end).alias("text"))


def _marks(language: str) -> list[str]:
    return [m for m in (ROUND, ANGLE.get(language), ARROW if language == "rust" else None) if m]


def safe_ends(language: str, text: str, last_marks: list[str]) -> tuple[int, int] | None:
    """Places of the first and last safe line end of a block, given the last mark of each kind before it."""
    marks = _marks(language)
    kinds = [re.compile(m) for m in marks]
    is_open = [m in _OPEN for m in last_marks[:len(marks)]]
    first = last = None
    for m in re.finditer("|".join([*marks, _SAFE]), text):
        token = m.group()
        for k, kind in enumerate(kinds):
            if kind.fullmatch(token):
                is_open[k] = token in _OPEN
        if token == "->":
            is_open[1] = False  # its second character closes an angle bracket
        if token in ";{}" and not any(is_open):
            end = m.end()
            while end < len(text) and text[end] in " \t\r":
                end += 1
            if end < len(text) and text[end] == "\n":
                first, last = end if first is None else first, end
    return None if first is None else (first, last)


_ENDS = StructType([StructField("first", IntegerType()), StructField("last", IntegerType())])


@F.pandas_udf(_ENDS)
def _ends(language: pd.Series, text: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series) -> pd.DataFrame:
    found = [safe_ends(lg, t, m) or (None, None) for lg, t, *m in zip(language, text, a, b, c, strict=True)]
    return pd.DataFrame(found, columns=["first", "last"]).astype("Int32")


def _last_mark(marks: str) -> Column:
    # tried from the start of the text only: a text without a mark is read once, not from each of its places
    return F.nullif(F.regexp_extract("text", f"(?s)^.*({marks})", 1), F.lit(""))


def chunks_of_blocks(stripped: DataFrame) -> DataFrame:
    """(path, language, chunk, content): the texts of a file joined, cut at safe ends only."""
    angle = [F.when(F.col("language") == lg, _last_mark(m)) for lg, m in ANGLE.items()]
    marks = [_last_mark(ROUND), F.coalesce(*angle),
             F.when(F.col("language") == "rust", _last_mark(ARROW))]
    seen = stripped.select(*FILE, "block_no", *[m.alias(f"_m{i}") for i, m in enumerate(marks)])
    w = _before("block_no")
    seen = seen.select(*FILE, "block_no", F.lag("block_no").over(Window.partitionBy(*FILE).orderBy("block_no")).isNull().alias("_top"),
                       *[F.coalesce(F.last(f"_m{i}", ignorenulls=True).over(w), F.lit("")).alias(f"_m{i}") for i in range(3)])
    j = stripped.join(seen, [*FILE, "block_no"])
    j = j.select("path", "language", "block_no", "text", "_top", _ends("language", "text", "_m0", "_m1", "_m2").alias("_c"))
    first = F.when(F.col("_top"), F.lit(0)).otherwise(F.col("_c.first"))
    j = j.select("path", "language", "block_no", "text", first.alias("_a"),
                 F.coalesce("_c.last", first).alias("_b")).checkpoint()

    middle = j.where("_a < _b").select("path", "language", (F.col("block_no") * 2).alias("chunk"),
                                       F.expr("substring(text, _a + 1, _b - _a)").alias("content"))
    # only the pieces at the edges are shuffled
    opener = j.select(*FILE, "block_no", F.last(F.when(F.col("_a").isNotNull(), F.col("block_no")), ignorenulls=True)
                      .over(_before("block_no")).alias("_of"))
    edges = j.select(*FILE, "block_no", F.expr("if(_a is null, text, left(text, _a))").alias("_head"),
                     F.expr("if(_a is null, '', substring(text, _b + 1))").alias("_tail"))
    sides = F.array(F.struct(F.col("_of").alias("of"), F.col("_head").alias("t")),
                    F.struct(F.col("block_no").alias("of"), F.col("_tail").alias("t")))
    pieces = (edges.where("_head <> '' or _tail <> ''").join(opener, [*FILE, "block_no"])
              .select(*FILE, "block_no", F.explode(sides).alias("_x")).where("_x.of is not null and _x.t <> ''"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("block_no", "_x.t"))), lambda x: x["t"])
    joints = pieces.groupBy("path", "language", (F.col("_x.of") * 2 + 1).alias("chunk")).agg(
        F.array_join(in_order, "").alias("content"))
    return middle.unionByName(joints).checkpoint()


def brace_functions_of_blocks(blocks: DataFrame, languages: list[str], bodies: bool = True) -> DataFrame:
    """F3-F5 (+ C#, JS): the columns of ``extract.brace_functions`` for files given as blocks
    (path, language, block_no, block), texts not yet stripped of comments."""
    src = blocks.where(F.col("language").isin(languages)).where("block is not null")
    chunks = chunks_of_blocks(strip_block_comments(src))
    code = chunks.select(F.struct("path", "chunk").alias("path"), "language", "content")

    inside = Window.partitionBy("path").orderBy("k", "j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.when(F.col("is_open"), 1).otherwise(-1)
    rows = _brace_rows(code, languages).select(
        "*", F.sum("n").over(inside).alias("e"), F.sum(step).over(inside).alias("d"), F.sum("nl").over(inside).alias("cnl"),
        (F.count(F.lit(1)).over(inside) - 1).alias("i")).drop("n", "nl", "k", "j")
    rows = rows.select(F.col("path.path").alias("path"), F.col("path.chunk").alias("chunk"),
                       *[c for c in rows.columns if c != "path"]).checkpoint()

    # what a chunk adds to a reader that passes it, summed over the chunks before
    size = chunks.select(*FILE, "chunk", F.length("content").alias("_len_c"), count_char("content", "\n").alias("_nl_c"))
    turn = rows.groupBy(*FILE, "chunk").agg(F.sum(step).alias("_d_c"))
    size = size.join(turn, [*FILE, "chunk"], "left")
    sums = [F.coalesce(F.sum(c).over(_before("chunk")), F.lit(0)).alias(a)
            for c, a in (("_len_c", "_off"), ("_nl_c", "_lines"), ("_d_c", "_depth"))]
    base = size.select(*FILE, "chunk", "_len_c", *sums).select("*", (F.col("_off") + F.col("_len_c")).alias("_until"))
    r = rows.join(base, [*FILE, "chunk"])
    depth = F.col("d") + F.col("_depth") + F.when(F.col("is_open"), 0).otherwise(1)
    r = r.select("path", "chunk", "language", "name", "signature", "_len", "_nl", "_inner", "is_open", "i", "_until",
                 (F.col("e") + F.col("_off")).alias("e"), (F.col("cnl") + F.col("_lines")).alias("cnl"), depth.alias("lvl"))

    brace = F.struct("is_open", "e", "cnl", "chunk", "i")
    level = Window.partitionBy(*FILE, "chunk", "lvl").orderBy("i")
    r = r.select("*", F.lead(brace).over(level).alias("_to"), F.lag("i").over(level).isNull().alias("_first"))
    across = Window.partitionBy(*FILE, "lvl").orderBy("chunk", "i")
    edge = r.where(F.col("_first") | F.col("_to").isNull()).withColumn("_then", F.lead(brace).over(across))
    pairs = r.where("_to is not null").unionByName(
        edge.where("_to is null").select(*[c for c in r.columns if c != "_to"], F.col("_then").alias("_to")))
    spans = pairs.where("is_open and name is not null and _to is not null and not _to.is_open").select(
        "path", "language", "name", "signature", (F.col("e") - F.col("_len")).alias("start_pos"),
        F.col("_to.e").alias("end_pos"), (F.col("cnl") - F.col("_nl") + 1).alias("start_line"),
        (F.col("_to.cnl") + 1).alias("end_line"), "chunk", F.col("_to.chunk").alias("_chunk2"),
        (F.col("i") - F.col("_inner")).alias("_from"), F.col("_to.i").alias("_i2"), "_until")

    # numbers: the place in the chunk where the header is, and the functions of the chunks before
    held = spans.groupBy(*FILE, "chunk").agg(F.count(F.lit(1)).alias("_n"))
    held = held.select(*FILE, "chunk", F.coalesce(F.sum("_n").over(_before("chunk")), F.lit(0)).alias("_base"))
    place = F.row_number().over(Window.partitionBy(*FILE, "chunk").orderBy("start_pos")) - 1
    spans = spans.withColumn("_place", place).join(held, [*FILE, "chunk"]).withColumn("fn_no", F.col("_base") + F.col("_place"))
    if not bodies:
        return _typed(spans)

    # a function's stretch of each chunk that it lies in, cut as a slice of the chunk's pieces between braces
    out = ["language", "name", "signature", "start_pos", "end_pos", "start_line", "end_line", "fn_no"]
    at = F.explode(F.sequence(F.col("chunk"), F.col("_chunk2")))
    reach = spans.select("path", *out, F.col("chunk").alias("_c1"), "_chunk2", "_from", "_i2", "_until", at.alias("chunk"))
    starts, ends = F.col("chunk") == F.col("_c1"), F.col("chunk") == F.col("_chunk2")
    begin = F.when(starts, F.col("_from")).otherwise(0)
    take = F.when(starts, F.least("_until", "end_pos") - F.col("start_pos")).otherwise(_TO_THE_END)
    cut = F.struct(*out, (F.col("_c1") == F.col("_chunk2")).alias("one"), begin.cast("int").alias("a"),
                   F.when(ends, F.col("_i2") + 1 - begin).otherwise(_TO_THE_END).cast("int").alias("n"),
                   take.cast("int").alias("take"))
    per_chunk = reach.groupBy("path", "chunk").agg(F.collect_list(cut).alias("_f"))
    j = chunks.select("path", "chunk", "content").join(per_chunk, ["path", "chunk"])
    j = j.select("path", "chunk", "_f", F.split("content", "(?<=[{}])", -1).alias("_p"))
    j = j.select("path", "chunk", "_p", F.explode("_f").alias("_x"))
    text = F.right(F.array_join(F.slice("_p", F.col("_x.a") + 1, F.col("_x.n")), ""), F.col("_x.take"))
    cuts = j.select("path", "chunk", *[F.col(f"_x.{c}").alias(c) for c in [*out, "one"]], text.alias("_t"))
    whole = cuts.where("one").select("path", *out, F.col("_t").alias("body"))
    stretches = F.transform(F.array_sort(F.collect_list(F.struct("chunk", "_t"))), lambda x: x["_t"])
    several = cuts.where("not one").groupBy("path", *out).agg(F.array_join(stretches, "").alias("body"))
    return whole.unionByName(several).withColumn("body", py_strip(F.col("body"))).transform(_typed)
