"""Source-tree scan (S2) and text decode policies (S3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchtrace.operators.extract import EXTRA_LANGUAGE_SUFFIXES, LANGUAGE_SUFFIXES, language_label, suffix

_REPLACEMENT_CHAR = "�"


def supported_suffixes(extra: dict[str, list[str]] | None = None) -> list[str]:
    table = dict(LANGUAGE_SUFFIXES, **(extra or {}))
    return sorted({s for exts in table.values() for s in exts})


def suffix_glob(suffixes: list[str]) -> str:
    """A file-name pattern of these suffixes in any case, for ``pathGlobFilter``."""
    def any_case(x: str) -> str:
        return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in x)
    return "*{" + ",".join(any_case(x) for x in suffixes) + "}"


def scan_source_tree(spark: SparkSession, root: str, recursive: bool = True,
                     path_glob: str | None = None, extra: bool = False) -> DataFrame:
    """(path, content binary, length) of the supported files below ``root``.

    ``recursive`` walks sub-folders (``recursiveFileLookup``); otherwise only the files
    directly in ``root``. ``extra`` adds the syntax-tree tool's languages. The suffix test
    ignores case (both tools, Q18 unified) and is a name pattern of the listing, so other
    files are never read; the listing is done by Spark's file index, in parallel for
    large trees.
    """
    table = EXTRA_LANGUAGE_SUFFIXES if extra else None
    r = (spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
         .option("pathGlobFilter", path_glob or suffix_glob(supported_suffixes(table))))
    return filter_supported(r.load(root), extra=extra)


def filter_supported(listing: DataFrame, path: str = "path", extra: bool = False) -> DataFrame:
    return listing.where(suffix(path).isin(supported_suffixes(EXTRA_LANGUAGE_SUFFIXES if extra else None)))


def flat_listing(paths: DataFrame, root: str, path: str = "path") -> Column:
    """True for paths directly inside ``root`` (the non-recursive listing)."""
    return F.col(path).rlike("^" + root.rstrip("/").replace(".", "\\.") + "/[^/]+$")


def _normalise_newlines(c: Column) -> Column:
    # Python's text mode: \r\n and lone \r become \n
    return F.regexp_replace(c, "\r\n?", "\n")


def decode_ignore(content: Column) -> Column:
    """S3, extractor policy: UTF-8 with undecodable bytes dropped.

    ``make_valid_utf8`` marks bad bytes with U+FFFD, which are then removed. U+FFFD
    characters of the file itself are escaped before and put back after (escape character
    U+E000, itself escaped)."""
    esc = "\ue000"
    s = F.replace(content.cast("string"), F.lit(esc), F.lit(esc + "0"))
    s = F.make_valid_utf8(F.replace(s, F.lit(_REPLACEMENT_CHAR), F.lit(esc + "1")))
    s = F.replace(s, F.lit(_REPLACEMENT_CHAR), F.lit(""))
    s = F.replace(F.replace(s, F.lit(esc + "1"), F.lit(_REPLACEMENT_CHAR)), F.lit(esc + "0"), F.lit(esc))
    return _normalise_newlines(s)


def is_decodable(content: Column) -> Column:
    """S3, embedder policy: a file that is not valid UTF-8 is skipped."""
    return F.is_valid_utf8(content.cast("string"))


def decode_strict(content: Column) -> Column:
    return _normalise_newlines(content.cast("string"))


def decoded_files(files: DataFrame, policy: str = "ignore", content: str = "content") -> DataFrame:
    """Binary files -> (path, text) under the named policy ("ignore" or "skip")."""
    if policy == "ignore":
        return files.withColumn("text", decode_ignore(F.col(content)))
    if policy == "skip":
        return files.where(is_decodable(F.col(content))).withColumn("text", decode_strict(F.col(content)))
    raise ValueError(f"unknown decode policy {policy!r}")


def labelled(files: DataFrame) -> DataFrame:
    return files.withColumn("language", language_label("path"))
