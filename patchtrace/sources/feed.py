"""CVE feed scan (S1) and the link file sink/re-scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patchtrace.functions.text import py_split_ws

# Fixed value of the reference: entries are separated by a line of 39 '='.
ENTRY_SEPARATOR = "=" * 39
_SEP_RE = "={39}"


def split_feed(feeds: DataFrame, text: str = "text", feed: str = "feed_id") -> DataFrame:
    """Split feed texts into entries (text before the first separator is an entry too).

    One row per feed text in, one row per entry out; narrow (no shuffle).
    """
    return feeds.select(F.col(feed), F.posexplode(F.split(F.col(text), _SEP_RE, -1)).alias("entry_no", "entry"))


def read_cve_feed(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """S1 from files: (feed_id, entry_no, entry), cut into splits inside each file.

    The text source cuts files at the separator, wherever a split begins, and hands the bytes of
    an entry through unchanged, so each entry is decoded by itself (Latin-1 by default; it must be an
    encoding in which the separator is 39 ASCII bytes). ``entry_no`` is dense in file order: entries are
    numbered within their split, and the number of entries before a split comes from a count per split.

    A run of more than 39 ``=`` is cut from its left end. Where a split could begin inside such a run
    the text source might cut it elsewhere, so files that hold one are read whole instead.
    What follows the last separator is an entry if it holds anything; an empty file has no entry. A
    UTF-8 byte order mark at the start of a file is left out.
    """
    # an entry that is empty or begins with the separator's character stands behind a longer run
    at = F.col("_metadata.file_path").alias("feed_id"), F.col("_metadata.file_block_start").alias("_split")
    raw = (spark.read.option("lineSep", ENTRY_SEPARATOR).text(path)
           .select(*at, F.monotonically_increasing_id().alias("_at"), F.col("value").cast("binary").alias("_raw")))
    entry = F.decode("_raw", encoding)
    odd = F.col("_raw").startswith(F.lit(b"=")) | (F.length("_raw") == 0)
    per_split = raw.groupBy("feed_id", "_split").agg(F.count(F.lit(1)).alias("_n"), F.max(odd).alias("_odd"))
    before = Window.partitionBy("feed_id").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    # one row a split: a file's splits are few
    offsets = per_split.select("feed_id", "_split", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                               F.max("_odd").over(Window.partitionBy("feed_id")).alias("_odd"))
    inside = Window.partitionBy("feed_id", "_split").orderBy("_at")
    cut = (raw.withColumn("_in", F.row_number().over(inside) - 1).join(offsets.where("not _odd"), ["feed_id", "_split"])
           .select("feed_id", (F.col("_before") + F.col("_in")).alias("entry_no"), entry.alias("entry")))
    whole_files = [r["feed_id"] for r in offsets.where("_odd").select("feed_id").distinct().collect()]
    if not whole_files:
        return cut
    whole = (spark.read.format("binaryFile").load(whole_files)
             .select(F.col("path").alias("feed_id"), F.decode(F.col("content"), encoding).alias("text")))
    rest = split_feed(whole).select("feed_id", F.col("entry_no").cast("long").alias("entry_no"), "entry",
                                    F.max("entry_no").over(Window.partitionBy("feed_id")).alias("_last"))
    ended = (F.col("entry_no") == F.col("_last")) & (F.col("entry") == "")
    return cut.unionByName(rest.where(~ended).drop("_last"))


def write_cve_feed(entries: DataFrame, path: str, entry: str = "entry", encoding: str = "ISO-8859-1") -> None:
    """Feed files in ``encoding``, a separator behind each entry (the inverse of ``read_cve_feed``).

    Characters outside the encoding have no form in such a file: the job fails on them."""
    (entries.select(F.encode(F.col(entry), encoding).cast("string").alias("value"))
     .write.mode("overwrite").option("lineSep", ENTRY_SEPARATOR).text(path))


def write_link_file(links: DataFrame, path: str) -> None:
    """S7 sink: one ``<cve_id> <link>`` line per pair, sorted by (link, cve_id)."""
    (links.orderBy("link", "cve_id")
          .select(F.concat_ws(" ", "cve_id", "link").alias("value"))
          .write.mode("overwrite").text(path))


def read_link_file(spark: SparkSession, path: str) -> DataFrame:
    """S7 re-scan: whitespace split of each line into (cve_id, link), by name (Q1 fixed)."""
    parts = py_split_ws(F.col("value"))
    return (spark.read.text(path)
            .select(parts.getItem(0).alias("cve_id"), parts.getItem(1).alias("link")))
