"""Code-shaped inputs derived from the given ``documents`` table.

The given tables hold prose. The CVE feed, commit diffs and source files the operators
need are derived from ``documents`` by SQL expressions that run unchanged in Spark and
in DuckDB, so the Spark job and the SQL oracle read the same rows. Every derived table
has one row per document (whole tables, whole texts), so its size grows with the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a scan that has fewer splits than the cluster has task slots.

    The given tables are single-row-group files (one split each), which would run
    every narrow stage in one task. On large multi-file inputs this is a no-op."""
    target = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(target) if df.rdd.getNumPartitions() < target else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


# F-cve: cve_feed(entry_no bigint, entry string)
CVE_FEED_SELECT = [
    "doc_id AS entry_no",
    """'Name: CVE-' || CAST(2012 + doc_id % 5 AS string) || '-' || CAST(1000 + doc_id AS string) || chr(10) ||
  'Reference: ' || CASE
    WHEN doc_id % 3 = 0 THEN 'https://example.com/advisory/' || CAST(doc_id AS string)
    WHEN doc_id % 7 = 1 THEN 'https://github.com/' || source || '/lib/tree/commit/' || substr(md5(text), 1, 12)
    ELSE 'https://github.com/' || source || '/lib' || CAST(doc_id % 11 AS string) || '/commit/' || substr(md5(CAST(doc_id AS string)), 1, 12)
      || ' (also https://github.com/' || source || '/core/commit/' || md5(source) || ')' END || chr(10) ||
  'See also CVE-1999-0001' AS entry""",
]
CVE_FEED_WHERE = None

# F-diff: commit_diffs(repo_url string, commit_hash string, diff_text string)
COMMIT_DIFFS_SELECT = [
    "'https://github.com/' || source || '/lib' || CAST(doc_id % 11 AS string) AS repo_url",
    "substr(md5(CAST(doc_id AS string)), 1, 12) AS commit_hash",
    """'diff --git a/src/m' || CAST(doc_id AS string) || '.c b/src/m' || CAST(doc_id AS string) || '.c' || chr(10) ||
  'index 26d3d6d..6ccab78 100644' || chr(10) || '--- a/src/m.c' || chr(10) || '+++ b/src/m.c' || chr(10) ||
  '@@ -1,9 +1,9 @@ int ctx' || CAST(doc_id AS string) || '(void)' || chr(10) || ' ' ||
  replace(replace(replace(replace(text, chr(10), chr(10) || '@@ -20,3 +20,4 @@' || chr(10) || ' '),
    '. ', '.' || chr(10) || '+'), ', ', ',' || chr(10) || '-'), ' the ', chr(10) || ' ') || chr(10) ||
  'diff --git a/doc/n.md b/doc/n.md' || chr(10) || '@@ -0,0 +1 @@' || chr(10) || '+note' || chr(10) ||
  chr(92) || ' No newline at end of file' AS diff_text""",
]
COMMIT_DIFFS_WHERE = None

# F-src: source_files(project_id string, path string, content string)
SOURCE_FILES_SELECT = [
    "'proj' || CAST(doc_id % 4 AS string) AS project_id",
    "'src/f' || CAST(doc_id AS string) || CASE doc_id % 5 WHEN 0 THEN '.c' WHEN 1 THEN '.HPP' WHEN 2 THEN '.java' WHEN 3 THEN '.rs' ELSE '.py' END AS path",
    """CASE doc_id % 5
    WHEN 3 THEN 'pub fn top(a: i32) -> i32 {' || chr(10) || replace(replace(text, '. ', '; }' || chr(10) || 'fn g<T>(p: T) { if x {} '), ', ', ' // c' || chr(10)) || chr(10) || '}' || chr(10)
    WHEN 4 THEN 'def top(a, b):' || chr(10) || '    ' || replace(replace(text, chr(10), chr(10) || '    '), '. ', chr(10) || 'def g(x) -> int:' || chr(10) || '        def h(): ') || chr(10)
    ELSE 'static int top(int a)' || chr(10) || '{' || chr(10) || replace(replace(text, '. ', '; }' || chr(10) || chr(10) || 'void g(char *p) { if (x) { y } '), ', ', ' /* c' || chr(10) || ' */ ') || chr(10) || '}' || chr(10)
  END AS content""",
]
SOURCE_FILES_WHERE = None

_FIXTURES = {
    "cve_feed": (CVE_FEED_SELECT, CVE_FEED_WHERE),
    "commit_diffs": (COMMIT_DIFFS_SELECT, COMMIT_DIFFS_WHERE),
    "source_files": (SOURCE_FILES_SELECT, SOURCE_FILES_WHERE),
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The derived table ``name`` as a lazy DataFrame over ``documents``."""
    sel, where = _FIXTURES[name]
    docs = table(spark, sf_dir, "documents")
    if where:
        docs = docs.where(where)
    return docs.selectExpr(*sel)


def fixture_sql(name: str) -> str:
    """The same derived table as an SQL SELECT over the view ``documents``."""
    sel, where = _FIXTURES[name]
    q = "SELECT " + ",\n  ".join(sel) + "\nFROM documents"
    if where:
        q += f"\nWHERE {where}"
    return q


def with_fixtures(sql: str, *names: str) -> str:
    """Prefix ``sql`` (which may start with its own WITH) by the fixture CTEs."""
    ctes = ",\n".join(f"{n} AS (\n{fixture_sql(n)}\n)" for n in names)
    body = sql.strip()
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"

# F-src2 (ours): source_files_more(project_id, path, content) in C#, JavaScript and Ruby,
# for the syntax-tree tool's extra languages.
SOURCE_FILES_MORE_SELECT = [
    "'proj' || CAST(doc_id % 4 AS string) AS project_id",
    "'web/g' || CAST(doc_id AS string) || CASE doc_id % 3 WHEN 0 THEN '.cs' WHEN 1 THEN '.js' ELSE '.rb' END AS path",
    """CASE doc_id % 3
    WHEN 0 THEN 'public class C' || CAST(doc_id AS string) || chr(10) || '{' || chr(10) || '    public static int Top(int a)' || chr(10) || '    {' || chr(10) || '        ' || replace(text, '. ', ';' || chr(10) || '    }' || chr(10) || '    private void G(string p) { if (x) { y(); } ') || chr(10) || '    }' || chr(10) || '}' || chr(10)
    WHEN 1 THEN 'function top(a, b) {' || chr(10) || '  ' || replace(text, '. ', ';' || chr(10) || '}' || chr(10) || 'export async function g(x) { if (x) { y(); } ') || chr(10) || '}' || chr(10)
    ELSE 'def top(a, b)' || chr(10) || '  ' || replace(replace(text, chr(10), chr(10) || '  '), '. ', chr(10) || 'end' || chr(10) || 'def g(x)' || chr(10) || '  ') || chr(10) || 'end' || chr(10)
  END AS content""",
]
_FIXTURES["source_files_more"] = (SOURCE_FILES_MORE_SELECT, None)

# F-ren (ours): rename_diffs(repo_url, commit_hash, diff_text), one change a document that
# renames identifiers or looks as if it did; the names come from the text.
_N = "'v' || substr(md5(text), 1, 6)"
_M = "'w' || substr(md5(text), 7, 6)"
_HUNK = "'diff --git a/src/r.c b/src/r.c' || chr(10) || '@@ -1,4 +1,4 @@ int run(int a)' || chr(10) || ' {' || chr(10)"
_USES = "chr(10) || '-  use(' || {0} || ', 1);' || chr(10) || '+  int ' || {1} || ' = get(a);' || chr(10) || '+  use(' || {1} || ', 1);'"
RENAME_DIFFS_SELECT = [
    "'https://github.com/' || source || '/ren' AS repo_url",
    "substr(md5(CAST(doc_id AS string)), 1, 12) AS commit_hash",
    f"""{_HUNK} || CASE doc_id % 9
    WHEN 0 THEN '-  int ' || {_N} || ' = get(a);' || {_USES.format(_N, _M)}
    WHEN 1 THEN '-  int ' || {_N} || ' = get(a);' || {_USES.format(_N, _M)} || chr(10) || '   done(' || {_N} || ');'
    WHEN 2 THEN '-  int p, q = ' || {_N} || ';' || chr(10) || '+  int p, p = ' || {_M} || ';'
    WHEN 3 THEN '-  int b = ' || {_N} || '(a);' || chr(10) || '+  int b = ' || {_M} || '(a);'
    WHEN 4 THEN '-  x.' || {_N} || ' = 1;' || chr(10) || '+  x.' || {_M} || ' = 1;'
    WHEN 5 THEN '-  char *s = "int ' || {_N} || '";' || chr(10) || '+  char *s = "int ' || {_M} || '";'
    WHEN 6 THEN '-  if (a > ' || {_N} || ') stop();' || chr(10) || '+  if (a > ' || {_M} || ') stop();'
    WHEN 7 THEN '-  int ' || {_N} || ' = a + 1;' || chr(10) || '+  int ' || {_M} || ' = a - 1;'
    ELSE '-  let ' || {_N} || ' = 1; let other = ' || {_N} || ';' || chr(10) || '+  let ' || {_M} || ' = 1;' || chr(10) || '+  let another = ' || {_M} || ';' END || chr(10) || ' }}' AS diff_text""",
]
_FIXTURES["rename_diffs"] = (RENAME_DIFFS_SELECT, None)
