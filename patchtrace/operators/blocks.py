"""Diff mining over texts of any size: a distributed prefix scan.

``diffs.diff_parts`` keeps a diff in its row, which is right until one diff is a large part of
all work. Here a text is many rows, numbered blocks of whole lines, and every block is read by
whichever task holds it:

1. *summary*: what a block does to a reader that passes it: the last path it sets, the last
   section it opens, whether its first line goes on with the section before;
2. *scan*: running ``last`` / ``lead`` over the summaries of a text (some hundred bytes for a block) give each
   block the path and the section that it begins in;
3. *resolve*: sections that begin and end in one block become parts in its row; only sections that
   cross an edge are shuffled, piece by piece, and joined;
4. *numbers*: a part's number is its place in its block plus the parts of the blocks before.

A text is shuffled once, by key and block number; summaries, numbers and the pieces at the edges
join the blocks where they lie.

Same rules and results as ``diff_parts``; tested against it for all block sizes. Null texts
have no blocks and no parts; the key columns must tell the texts apart and may not be null.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patchtrace.functions.text import NS, S
from patchtrace.operators.diffs import GROUP_SPLIT, SECTION_SPLIT, _group_path, _header_context, _hunk_lines
from patchtrace.session import shared_path
from patchtrace.sources.files import decode_ignore

BLOCK_CHARS = 1 << 16


def text_blocks(texts: DataFrame, key: list[str], text: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """key..., block_no, block: each text cut at line ends into blocks of at most ``block_chars``
    characters, a longer line alone. The blocks joined by line breaks are the text. They are
    dealt out by key and number, since one row may have made most of them."""
    piece = f"(?s)(.{{0,{block_chars}}}|[^\n]*)\n"
    cut = F.regexp_extract_all(F.concat(F.col(text), F.lit("\n")), F.lit(piece), 1)
    return (texts.select(*key, F.posexplode(cut).alias("block_no", "block"))
            .withColumn("block_no", F.col("block_no").cast("long")).repartition(*key, "block_no"))


def read_blocks(spark: SparkSession, path: str, block_bytes: int = BLOCK_CHARS) -> DataFrame:
    """Text files as blocks: (file, block_no, block), whole lines of at most ``block_bytes`` together.

    The text source cuts a file into splits, so a file of any size is read by many tasks, and
    lines are put together where they are read. ``block_no`` grows with the text (twice the block's place, near enough).
    Undecodable bytes are left out (``files.decode_ignore``)."""
    lines = (spark.read.option("lineSep", "\n").text(path)
             .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                     F.col("value").cast("binary").alias("raw")))

    def gather(batches):
        import pyarrow as pa

        def block():
            return pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([number], pa.int64()),
                                               pa.array([b"\n".join(held)], pa.binary())], names=["file", "block_no", "raw"])

        at, number, held, size, before = None, 0, [], 0, 0
        for b in batches:
            for file, start, raw in zip(*[b.column(c).to_pylist() for c in ("file", "start", "raw")], strict=True):
                if held and ((file, start) != at or size + len(raw) > block_bytes):
                    yield block()
                    before, held, size = before + size, [], 0
                if (file, start) != at:
                    # a line at the very end of a split is that split's: its block comes before the next split's first
                    at, before, number = (file, start), 0, 2 * start + 1
                elif not held:
                    number = 2 * (start + before)
                held.append(raw)
                size += len(raw) + 1
        if held:
            yield block()

    blocks = lines.mapInArrow(gather, "file string, block_no long, raw binary")
    return blocks.select("file", "block_no", decode_ignore(F.col("raw")).alias("block"))


def _stripped(blocks: DataFrame, key: list[str]) -> DataFrame:
    """The blocks of each text without the white space that ``str.strip`` takes off the whole."""
    whole = Window.partitionBy(*key)
    filled = F.when(F.col("block").rlike(NS), F.col("block_no"))
    ends = blocks.select(*key, "block_no", filled.alias("_f")).select(
        *key, "block_no", F.min("_f").over(whole).alias("_lo"), F.max("_f").over(whole).alias("_hi"))
    b = blocks.join(ends, [*key, "block_no"]).where(F.col("block_no").between(F.col("_lo"), F.col("_hi")))
    left = F.when(F.col("block_no") == F.col("_lo"), F.regexp_replace("block", f"^{S}+", "")).otherwise(F.col("block"))
    b = b.withColumn("block", left)
    right = F.when(F.col("block_no") == F.col("_hi"), F.regexp_replace("block", f"{S}+$", "")).otherwise(F.col("block"))
    return b.withColumn("block", right).select(*key, "block_no", "block")


def _is_start(seg: Column) -> Column:
    return seg.startswith("diff --git") | seg.startswith("@@")


def _sections(block: Column) -> Column:
    """The block's stretches in order: path set by their file section in this block, text, opens a section."""
    groups = F.transform(F.split(block, GROUP_SPLIT, -1),
                         lambda g: F.struct(_group_path(g).alias("path"), F.split(g, SECTION_SPLIT, -1).alias("segs")))
    return F.flatten(F.transform(groups, lambda g: F.transform(
        g["segs"], lambda s: F.struct(g["path"].alias("path"), s.alias("seg"), _is_start(s).alias("start")))))


def diff_parts_of_blocks(blocks: DataFrame, key: list[str], block_no: str = "block_no", block: str = "block") -> DataFrame:
    """Key..., part_no, file, diff_part of texts given as blocks."""
    src = _stripped(blocks.select(*key, F.col(block_no).alias("block_no"), F.col(block).alias("block")), key)
    cut = src.select(*key, "block_no", _sections(F.col("block")).alias("_s"))

    # 1, 2: summaries and their scan; no text but the paths
    last = F.element_at("_s", -1)
    n_starts = F.size(F.filter("_s", lambda x: x["start"]))
    summary = cut.select(*key, "block_no", last["path"].alias("_set"), (n_starts > 0).alias("_opens"),
                         (~F.element_at("_s", 1)["start"]).alias("_goes_on"))
    order = Window.partitionBy(*key).orderBy("block_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    opened = F.when(F.col("_opens"), F.col("block_no"))
    scanned = summary.select(
        *key, "block_no", F.last("_set", ignorenulls=True).over(before).alias("_path"),
        F.last(opened, ignorenulls=True).over(before).alias("_open"),
        F.coalesce(F.lead("_goes_on").over(order), F.lit(False)).alias("_crosses"))

    # 3: a block's first stretch may go on from an earlier block, its last may go on into the next
    j = cut.join(scanned, [*key, "block_no"])

    def stretch(x, i):
        split = ~x["start"] | ((i == F.size("_s") - 1) & F.col("_crosses"))
        return F.struct(F.when(x["start"], F.col("block_no")).otherwise(F.col("_open")).alias("b"), split.alias("split"),
                        F.when(x["start"], F.coalesce(x["path"], F.col("_path"))).alias("file"), x["seg"].alias("seg"))

    def valid(file, seg):
        return (seg.startswith("@@") & file.isNotNull() & (file != "")
                & ((_header_context(seg) != "") | (F.size(_hunk_lines(seg)) > 0)))

    stretches = F.transform("_s", stretch)
    own = F.filter(stretches, lambda x: ~x["split"] & valid(x["file"], x["seg"]))
    # lines before any section belong to none
    at_edge = F.filter(stretches, lambda x: x["split"] & x["b"].isNotNull())
    resolved = j.select(*key, "block_no", own.alias("_w"), at_edge.alias("_e")).withColumn("_n", F.size("_w"))
    # written once: the numbers, the pieces at the edges and the parts inside the blocks all read it
    at = shared_path(blocks.sparkSession, "diff-blocks", uuid.uuid4().hex)
    resolved.write.parquet(at)
    resolved = blocks.sparkSession.read.schema(resolved.schema).parquet(at)
    whole, edges = resolved.select(*key, "block_no", "_w"), resolved.select(*key, "block_no", "_e", "_n")
    # only the pieces at the edges are grouped
    pieces = edges.select(*key, "block_no", F.explode("_e").alias("_x")).select(*key, "block_no", "_x.*")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("block_no", "seg"))), lambda x: x["seg"])
    joined = (pieces.groupBy(*key, F.col("b").alias("block_no"))
              .agg(F.max("file").alias("file"), F.array_join(in_order, "\n").alias("seg"))
              .where(valid(F.col("file"), F.col("seg"))))

    # 4: a block's parts are its own, then the one that it opens and a later block ends
    counts = edges.select(*key, "block_no", "_n").join(joined.select(*key, "block_no", F.lit(1).alias("_one")), [*key, "block_no"], "left")
    base = counts.select(*key, "block_no", "_n", F.coalesce(F.sum(F.col("_n") + F.coalesce("_one", F.lit(0))).over(before),
                                                            F.lit(0)).alias("_base"))
    inside = (whole.join(base, [*key, "block_no"]).select(*key, "_base", F.posexplode_outer("_w").alias("_i", "_x"))
              .where("_i is not null").select(*key, (F.col("_base") + F.col("_i")).alias("part_no"), "_x.file", "_x.seg"))
    across = joined.join(base, [*key, "block_no"]).select(*key, (F.col("_base") + F.col("_n")).alias("part_no"), "file", "seg")
    return inside.unionByName(across).select(*key, F.col("part_no").cast("int").alias("part_no"), "file",
                                             F.col("seg").alias("diff_part"))
