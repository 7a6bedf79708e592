"""Source trees of many projects (M5 + S2) and what changed in them (F1/S2 + I1).

*Projects file*: one line for each project, its id and its root folder. All roots are scanned in one
job; a file belongs to the project with the longest root that it lies below, so a project inside
another one's folder keeps its own files.

*Snapshot*: (key..., path, digest) of every file. Two snapshots are compared by a full outer join on the
file; what is new in one place and gone from another with the same content has moved. The delta
picks the files that an inventory or an index has to read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchtrace.functions.text import py_split_ws, py_strip
from patchtrace.sources.files import suffix_glob, supported_suffixes


def read_projects_file(spark: SparkSession, path: str) -> DataFrame:
    """(project_id, root): lines ``<project id> <root folder>``; blank lines and ``#`` lines are left out.

    The root is the rest of the line, so it may hold blanks; slashes at its end don't matter."""
    line = py_strip(F.col("value"))
    rows = spark.read.text(path).select(line.alias("line")).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    name = F.get(py_split_ws(F.col("line")), 0)
    root = py_strip(F.substring(F.col("line"), F.length(name) + 1, F.length("line")))
    return rows.select(name.alias("project_id"), F.regexp_replace(root, "(?<=.)/+$", "").alias("root")).where("root <> ''")


def _folders_above(path: Column) -> Column:
    """Every folder that holds ``path``: ``/a/b/c`` -> ``/``, ``/a``, ``/a/b``."""
    parts = F.split(path, "/", -1)
    upto = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
                       lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.transform(upto, lambda p: F.when(p == "", "/").otherwise(p))


def assign_projects(files: DataFrame, projects: DataFrame, path: str = "path") -> DataFrame:
    """Add ``project_id`` to files: the project whose root is the longest one above the file.

    An equi-join of each file's folders with the roots, on the paths alone; the files' other columns are joined
    back by path. Files below no root are left out. A root that is named twice belongs to the
    smallest project id."""
    roots = projects.groupBy("root").agg(F.min("project_id").alias("project_id"))
    names = files.select(F.col(path).alias("_path")).distinct()
    above = names.select("_path", F.explode(_folders_above(F.col("_path"))).alias("root"))
    owner = (above.join(roots, "root").groupBy("_path")
             .agg(F.max_by("project_id", F.length("root")).alias("project_id")))
    own = files.drop("project_id")
    return own.join(owner, own[path] == owner["_path"]).drop("_path")


def outermost(roots: list[str]) -> list[str]:
    """The roots that lie below no other one."""
    out: list[str] = []
    for r in sorted(set(roots), key=lambda x: (x.rstrip("/") + "/")):
        if not out or not (r.rstrip("/") + "/").startswith(out[-1].rstrip("/") + "/"):
            out.append(r)
    return out


def scan_projects(spark: SparkSession, projects: DataFrame, extra: bool = False) -> DataFrame:
    """(project_id, path, content binary, length) of the supported files of all projects, in one scan.

    The list of roots is read by the driver (it is a configuration, one short line for each project); Spark lists and
    reads the folders. Paths are as Spark names them; roots are compared without scheme and host."""
    from pyspark.sql.functions import regexp_replace

    roots = [r["root"] for r in projects.select("root").distinct().collect()]
    found = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", suffix_glob(supported_suffixes(None if not extra else _extra()))).load(outermost(roots)))
    plain = "^[a-zA-Z][a-zA-Z0-9+.-]*:(?://[^/]*)?"
    local = projects.withColumn("root", regexp_replace("root", plain, ""))
    keyed = found.select(regexp_replace("path", plain, "").alias("_local"), "path", "content", "length")
    return assign_projects(keyed, local, "_local").select("project_id", "path", "content", "length")


def _extra() -> dict[str, list[str]]:
    from patchtrace.operators.extract import EXTRA_LANGUAGE_SUFFIXES
    return EXTRA_LANGUAGE_SUFFIXES


def snapshot(files: DataFrame, key: list[str], content: str = "content") -> DataFrame:
    """(key..., digest): one row for each file; null content has the digest of no bytes."""
    return files.select(*key, F.sha2(F.coalesce(F.col(content).cast("binary"), F.lit(b"")), 256).alias("digest"))


def tree_delta(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """What became of each file between two snapshots: key..., status, digest, old_digest, from_....

    ``status`` is added, changed, removed, moved or same. An added file whose content a removed one had is
    moved; its ``from_`` columns name that file, the smallest key if several were removed. A removed file has
    no row of its own if it is some moved file's origin. Copies of one content are never paired with each other:
    the origin is one aggregate for each digest, so a content that very many files share does no harm."""
    o, n = old.select(*key, F.col("digest").alias("old_digest")), new.select(*key, "digest")
    j = o.join(n, key, "full_outer")
    status = (F.when(F.col("old_digest").isNull(), "added").when(F.col("digest").isNull(), "removed")
              .when(F.col("digest") != F.col("old_digest"), "changed").otherwise("same"))
    j = j.withColumn("status", status)
    origin = (j.where("status = 'removed'").groupBy(F.col("old_digest").alias("digest"))
              .agg(F.min(F.struct(*key)).alias("_from")))
    origin = origin.join(j.where("status = 'added'").select("digest").distinct(), "digest", "left_semi")
    at = j.withColumn("_d", F.coalesce("digest", "old_digest")).join(origin.withColumnRenamed("digest", "_d"), "_d", "left")
    is_origin = (F.col("status") == "removed") & F.col("_from").isNotNull() & (F.col("_from") == F.struct(*key))
    moved = (F.col("status") == "added") & F.col("_from").isNotNull()
    at = at.where(~F.coalesce(is_origin, F.lit(False)))
    return at.select(*key, F.when(moved, "moved").otherwise(F.col("status")).alias("status"), "digest", "old_digest",
                     *[F.when(moved, F.col(f"_from.{k}")).alias(f"from_{k}") for k in key])


def files_to_read(files: DataFrame, delta: DataFrame, key: list[str]) -> DataFrame:
    """The files that must be read again: added and changed ones (a moved file's content is known)."""
    todo = delta.where(F.col("status").isin("added", "changed")).select(*key)
    return files.join(todo, key, "left_semi")


def rows_that_stay(rows: DataFrame, delta: DataFrame, key: list[str]) -> DataFrame:
    """Rows made from the old files (functions, vectors) that still hold, under the files' new names.

    Rows of changed and removed files go, those of moved files get their new key."""
    kept = delta.where(F.col("status") == "same").select(*key, *[F.col(k).alias(f"_new_{k}") for k in key])
    moved = delta.where(F.col("status") == "moved").select(*[F.col(f"from_{k}").alias(k) for k in key],
                                                           *[F.col(k).alias(f"_new_{k}") for k in key])
    rest = [c for c in rows.columns if c not in key]
    names = [F.col(f"_new_{k}").alias(k) for k in key]
    return rows.join(kept.unionByName(moved), key).select(*names, *rest)
