"""Query registry: one Spark query and one oracle SQL text per operator key.

Every query reads the given tables (or data Spark derives from them) over whole tables
and whole texts. Oracle SQL is written for DuckDB over the same parquet views; keys
without an oracle are checked on row counts only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patchtrace.operators import match
from patchtrace.plans.fixtures import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql.strip()
        return fn
    return deco


# ---------------------------------------------------------------------------------
# Clone match on the given ``embeddings`` table. Label 0 plays the CVE side, every
# other label the project side (a role split by attribute, the whole table is read).
# The reference's 0.947 yields no pair on these vectors (max cosine < 0.6), so the
# embeddings queries use 0.3; 0.947 is exercised on the pipeline queries.
# ---------------------------------------------------------------------------------
EMB_THRESHOLD = 0.3


def _vectors(spark, sf_dir):
    return (table(spark, sf_dir, "embeddings")
            .select(F.col("vec_id").cast("string").alias("path"), "embedding", "label"))


def _emb_pairs(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return match.clone_pairs(spark, v.where("label = 0"), v.where("label <> 0"),
                             threshold=EMB_THRESHOLD)


_EMB_VIEW = """e AS (SELECT CAST(vec_id AS VARCHAR) AS path, label,
                 CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""
_COS = """CASE WHEN list_dot_product(a.v, a.v) = 0 OR list_dot_product(b.v, b.v) = 0 THEN 0.0
       ELSE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) END"""
_EMB_PAIRS_SQL = f"""pairs AS (
  SELECT * FROM (SELECT a.path AS cve_function_path, b.path AS project_function_path, {_COS} AS similarity
                 FROM e a JOIN e b ON a.label = 0 AND b.label <> 0) WHERE similarity >= {EMB_THRESHOLD})"""


@register("vectors_scan", f"""
WITH {_EMB_VIEW}
SELECT path, CAST(len(v) AS INTEGER) AS dim, round(sqrt(list_dot_product(v, v)), 6) AS norm FROM e""")
def q_vectors_scan(spark, sf_dir):
    """Vectors as (path, embedding); reports dimension and norm per vector."""
    v = _vectors(spark, sf_dir)
    sq = F.aggregate("embedding", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x)
    return v.select("path", F.size("embedding").alias("dim"), F.round(F.sqrt(sq), 6).alias("norm"))


@register("pair_cosine", f"""
WITH {_EMB_VIEW}
SELECT a.path AS a_path, b.path AS b_path, round({_COS}, 4) AS similarity
FROM e a JOIN e b ON CAST(b.path AS BIGINT) = CAST(a.path AS BIGINT) + 1""")
def q_pair_cosine(spark, sf_dir):
    """M1 over the pair list (vec_id, vec_id + 1): an equi-join, no all-pairs."""
    v = _vectors(spark, sf_dir)
    a = v.select(F.col("path").alias("a_path"), F.col("embedding").alias("a"),
                 (F.col("path").cast("long") + 1).alias("_next"))
    b = v.select(F.col("path").alias("b_path"), F.col("embedding").alias("b"),
                 F.col("path").cast("long").alias("_id"))
    j = a.join(b, a["_next"] == b["_id"])
    return match.pair_cosine(j, "a", "b").select("a_path", "b_path", F.round("similarity", 4).alias("similarity"))


@register("clone_pairs", f"""
WITH {_EMB_VIEW}, {_EMB_PAIRS_SQL}
SELECT cve_function_path, project_function_path, round(similarity, 4) AS similarity FROM pairs""")
def q_clone_pairs(spark, sf_dir):
    """M2: block product of the CVE side against the project side at t = 0.3."""
    return match.rounded(_emb_pairs(spark, sf_dir))


@register("clone_counts", f"""
WITH {_EMB_VIEW}, {_EMB_PAIRS_SQL}
SELECT cve_function_path, count(*) AS n_clones FROM pairs GROUP BY cve_function_path""")
def q_clone_counts(spark, sf_dir):
    """M3: kept pairs per CVE vector."""
    return match.clone_counts(_emb_pairs(spark, sf_dir))


@register("project_reports", f"""
WITH {_EMB_VIEW}, {_EMB_PAIRS_SQL}
SELECT 'label' || CAST(e.label AS VARCHAR) AS project_id, count(*) AS n_pairs,
       count(DISTINCT cve_function_path) AS n_cve_functions,
       count(DISTINCT project_function_path) AS n_project_functions,
       round(max(similarity), 4) AS max_similarity
FROM pairs JOIN e ON e.path = pairs.project_function_path GROUP BY e.label""")
def q_project_reports(spark, sf_dir):
    """M5: per-project report in one job; label plays the project id."""
    v = _vectors(spark, sf_dir)
    proj = v.select("path", F.concat(F.lit("label"), F.col("label").cast("string")).alias("project_id"))
    r = match.project_reports(_emb_pairs(spark, sf_dir), proj)
    return r.withColumn("max_similarity", F.round("max_similarity", 4))


# ---------------------------------------------------------------------------------
# CVE mining over the derived feed F-cve (one entry per document).
# ---------------------------------------------------------------------------------
import uuid  # noqa: E402

from patchtrace.operators import cve  # noqa: E402
from patchtrace.plans.fixtures import CVE_FEED_SELECT, fixture, with_fixtures  # noqa: E402
from patchtrace.session import shared_path  # noqa: E402
from patchtrace.sources import feed as feedsrc  # noqa: E402

FEED_GROUP = 64  # entries per derived feed text (bounded group size)

_CVE_CTES = f"""firsts AS (
  SELECT * FROM (SELECT entry_no, entry, regexp_extract(entry, '{cve.CVE_ID_PATTERN}', 0) AS cve_id FROM cve_feed)
  WHERE cve_id <> ''),
links AS (SELECT entry_no, cve_id, unnest(regexp_extract_all(entry, '{cve.COMMIT_LINK_PATTERN}', 0)) AS link FROM firsts),
ylinks AS (SELECT * FROM links WHERE substr(cve_id, 5, 4) >= '{cve.FIRST_YEAR}' AND substr(cve_id, 5, 4) <= '{cve.LAST_YEAR}'),
clinks AS (SELECT DISTINCT link, cve_id FROM links),
keys AS (SELECT link, cve_id, 'https://github.com/' || regexp_extract(link, '{cve.COMMIT_KEY_PATTERN}', 1) AS repo_url,
                regexp_extract(link, '{cve.COMMIT_KEY_PATTERN}', 2) AS commit_hash
         FROM clinks WHERE regexp_extract(link, '{cve.COMMIT_KEY_PATTERN}', 1) <> '')"""


def _cve_sql(select: str) -> str:
    return with_fixtures(f"WITH {_CVE_CTES}\n{select}", "cve_feed", "commit_diffs")


def _links(spark, sf_dir):
    return cve.commit_links(cve.first_cve_id(fixture(spark, sf_dir, "cve_feed")))


def _commit_keys(spark, sf_dir):
    return cve.commit_keys(cve.cve_links(_links(spark, sf_dir)))


@register("cve_feed_entries", with_fixtures(f"""
WITH feeds AS (SELECT entry_no // {FEED_GROUP} AS feed_id,
                      string_agg(entry, '{feedsrc.ENTRY_SEPARATOR}' ORDER BY entry_no) AS text
               FROM cve_feed GROUP BY 1)
SELECT feed_id, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS entry_no, unnest(parts) AS entry
FROM (SELECT feed_id, string_split(text, '{feedsrc.ENTRY_SEPARATOR}') AS parts FROM feeds)""", "cve_feed"))
def q_cve_feed_entries(spark, sf_dir):
    """Feed texts (F-cve entries joined by the separator, 64 per feed) split again."""
    f = fixture(spark, sf_dir, "cve_feed")
    feeds = (f.groupBy(F.expr(f"entry_no div {FEED_GROUP}").alias("feed_id"))
              .agg(F.concat_ws(feedsrc.ENTRY_SEPARATOR,
                               F.transform(F.array_sort(F.collect_list(F.struct("entry_no", "entry"))),
                                           lambda x: x["entry"])).alias("text")))
    return feedsrc.split_feed(feeds)


_FEED_TEXT = r"regexp_replace(text, '[^\x01-\x{FF}]|={39}', '?'{g})"


@register("cve_feed_file", with_fixtures(f"""
SELECT f.entry_no, length(e) AS n_chars, md5(e) AS entry_md5, true AS dense
FROM (SELECT f.entry_no, f.entry || chr(10) || {_FEED_TEXT.replace("{g}", ", 'g'")} || chr(10) AS e
      FROM cve_feed f JOIN documents d ON d.doc_id = f.entry_no) f""", "cve_feed"))
def q_cve_feed_file(spark, sf_dir):
    """S1 from files: long entries written as Latin-1 feed files, read back split inside each
    file; ``dense`` says that the numbers in an entry's file run from 0 without a gap."""
    out = shared_path(spark, "feed", uuid.uuid4().hex)
    entry = F.expr(CVE_FEED_SELECT[1].removesuffix(" AS entry"))
    text = F.expr(_FEED_TEXT.replace("{g}", "").replace("\\", "\\\\"))
    docs = table(spark, sf_dir, "documents")
    feedsrc.write_cve_feed(docs.select(F.concat(entry, F.lit("\n"), text, F.lit("\n")).alias("entry")), out)
    back = feedsrc.read_cve_feed(spark, out)
    of_file = Window.partitionBy("feed_id")  # numbers and hashes only, no text
    rows = back.select("feed_id", "entry_no", (F.regexp_extract("entry", "CVE-[0-9]+-([0-9]+)", 1).cast("long") - 1000).alias("id"),
                       F.length("entry").alias("n_chars"), F.md5(F.col("entry")).alias("entry_md5"))
    return rows.select(F.col("id").alias("entry_no"), F.col("n_chars").cast("long").alias("n_chars"), "entry_md5",
                       (F.max("entry_no").over(of_file) + 1 == F.count("*").over(of_file)).alias("dense"))


@register("cve_first_id", _cve_sql("SELECT entry_no, cve_id FROM firsts"))
def q_cve_first_id(spark, sf_dir):
    """First CVE id per entry."""
    return cve.first_cve_id(fixture(spark, sf_dir, "cve_feed")).select("entry_no", "cve_id")


@register("commit_links", _cve_sql("SELECT entry_no, cve_id, link FROM links"))
def q_commit_links(spark, sf_dir):
    """All commit links of entries that have a CVE id."""
    return _links(spark, sf_dir).select("entry_no", "cve_id", "link")


@register("links_by_year", _cve_sql("SELECT entry_no, cve_id, link FROM ylinks"))
def q_links_by_year(spark, sf_dir):
    """Links of CVE ids in the default year range 2014-2014."""
    return cve.year_filter(_links(spark, sf_dir)).select("entry_no", "cve_id", "link")


@register("cve_links", _cve_sql("SELECT link, cve_id FROM clinks"))
def q_cve_links(spark, sf_dir):
    """C4: distinct (link, cve_id) set."""
    return cve.cve_links(_links(spark, sf_dir))


@register("link_counts", _cve_sql("""SELECT substr(cve_id, 5, 4) AS year, count(*) AS n_pairs, count(DISTINCT link) AS n_links
FROM (SELECT DISTINCT link, cve_id FROM links) GROUP BY 1"""))
def q_link_counts(spark, sf_dir):
    """Unique pairs and links per CVE year (all years)."""
    return cve.link_counts(_links(spark, sf_dir))


@register("commit_keys", _cve_sql("SELECT link, cve_id, repo_url, commit_hash FROM keys"))
def q_commit_keys(spark, sf_dir):
    """C6 + C7: parsed commit keys; links deeper than owner/repo are dropped."""
    return _commit_keys(spark, sf_dir).select("link", "cve_id", "repo_url", "commit_hash")


@register("repo_tags", _cve_sql("""SELECT cve_id, repo_url, commit_hash,
  replace(regexp_replace(repo_url, '^https://', ''), '/', '_') || '_' || commit_hash AS repo_tag FROM keys"""))
def q_repo_tags(spark, sf_dir):
    """Per-commit tag (prefix strip fixed)."""
    return _commit_keys(spark, sf_dir).select("cve_id", "repo_url", "commit_hash", cve.repo_tag().alias("repo_tag"))


@register("cve_commit_diffs", _cve_sql("""SELECT cve_id, link, repo_url, commit_hash, CAST(length(diff_text) AS INTEGER) AS diff_chars
FROM keys JOIN commit_diffs USING (repo_url, commit_hash)"""))
def q_cve_commit_diffs(spark, sf_dir):
    """Commit keys joined with their diffs; the CVE id travels with the diff."""
    j = cve.attach_diffs(_commit_keys(spark, sf_dir), fixture(spark, sf_dir, "commit_diffs"))
    return j.select("cve_id", "link", "repo_url", "commit_hash", F.length("diff_text").alias("diff_chars"))


@register("links_roundtrip", _cve_sql("SELECT cve_id, link FROM clinks"))
def q_links_roundtrip(spark, sf_dir):
    """The link set written as `cve_id link` lines to the shared folder and read back."""
    out = shared_path(spark, "links", uuid.uuid4().hex)
    feedsrc.write_link_file(cve.cve_links(_links(spark, sf_dir)), out)
    return feedsrc.read_link_file(spark, out)


# ---------------------------------------------------------------------------------
# Diff mining over the derived diffs F-diff (one diff per short document).
# ---------------------------------------------------------------------------------
from patchtrace.operators import blocks  # noqa: E402
from patchtrace.operators import diffs as dops  # noqa: E402
from patchtrace.operators import verdict  # noqa: E402
from patchtrace.plans import sqltext  # noqa: E402

_DK = ["repo_url", "commit_hash"]


def _diff_sql(select: str) -> str:
    return with_fixtures(f"WITH {sqltext.diff_ctes('commit_diffs', _DK)}\n{select}", "commit_diffs")


def _parts(spark, sf_dir):
    return dops.diff_parts(fixture(spark, sf_dir, "commit_diffs"))


@register("diff_hunks", _diff_sql("SELECT repo_url, commit_hash, part_no, file, header FROM parts"))
def q_diff_hunks(spark, sf_dir):
    """D1 + D2: emitted hunks with their path and header line."""
    p = _parts(spark, sf_dir)
    return p.select(*_DK, "part_no", "file", F.substring_index("diff_part", "\n", 1).alias("header"))


@register("diff_files", _diff_sql("SELECT repo_url, commit_hash, file, count(*) AS n_parts FROM parts GROUP BY ALL"))
def q_diff_files(spark, sf_dir):
    """Parts per (commit, file)."""
    return _parts(spark, sf_dir).groupBy(*_DK, "file").agg(F.count(F.lit(1)).alias("n_parts"))


@register("diff_parts_blocks", _diff_sql("SELECT repo_url, commit_hash, part_no, file, diff_part FROM parts"))
def q_diff_parts_blocks(spark, sf_dir):
    """D1-D6 over texts of any size: the diffs cut into small blocks, parts by a prefix scan over them."""
    cut = blocks.text_blocks(fixture(spark, sf_dir, "commit_diffs"), _DK, "diff_text", block_chars=4096)
    return blocks.diff_parts_of_blocks(cut, _DK)


@register("diff_part_text", _diff_sql("SELECT repo_url, commit_hash, part_no, diff_part FROM parts"))
def q_diff_part_text(spark, sf_dir):
    """The text of each diff part."""
    return _parts(spark, sf_dir).select(*_DK, "part_no", "diff_part")


@register("old_versions", _diff_sql("SELECT repo_url, commit_hash, part_no, old_version FROM parts"))
def q_old_versions(spark, sf_dir):
    """D3 + D5: the pre-change text of each part (empty for pure additions)."""
    return dops.with_old_version(_parts(spark, sf_dir)).select(*_DK, "part_no", "old_version")


@register("hunk_line_counts", _diff_sql("""SELECT repo_url, commit_hash, part_no,
  CAST(len(list_filter(hl, lambda x: starts_with(x, '+'))) AS INTEGER) AS n_added,
  CAST(len(list_filter(hl, lambda x: starts_with(x, '-'))) AS INTEGER) AS n_removed,
  CAST(len(list_filter(hl, lambda x: starts_with(x, ' '))) AS INTEGER) AS n_context,
  CAST(len(list_filter(hl, lambda x: NOT (starts_with(x, '+') OR starts_with(x, '-') OR starts_with(x, ' ')))) AS INTEGER) AS n_other
FROM parts"""))
def q_hunk_line_counts(spark, sf_dir):
    """Added / removed / context / other line counts per part."""
    return dops.with_line_counts(_parts(spark, sf_dir)).select(
        *_DK, "part_no", "n_added", "n_removed", "n_context", "n_other")


@register("fragment_keys", _diff_sql("""SELECT repo_url, commit_hash, part_no,
  'part_' || CAST(part_no AS VARCHAR) || '_' || replace(file, '/', '_') AS fragment_id FROM parts"""))
def q_fragment_keys(spark, sf_dir):
    """D6 + S8: part number and fragment name per part."""
    return _parts(spark, sf_dir).select(*_DK, "part_no", dops.fragment_id().alias("fragment_id"))


@register("verdict_prompts", _diff_sql(f"""SELECT repo_url, commit_hash, part_no,
  dense_rank() OVER (PARTITION BY repo_url, commit_hash, part_no ORDER BY no) - 1 AS prompt_no,
  {sqltext.q(verdict.PROMPT_HEAD)} || string_agg(l, chr(10) ORDER BY i) || {sqltext.q(verdict.PROMPT_TAIL)} AS prompt
FROM (SELECT repo_url, commit_hash, part_no, l, i, coalesce(sum(length(l) + 1) OVER (
        PARTITION BY repo_url, commit_hash, part_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
        // {verdict.MAX_DIFF_CHARS} AS no
      FROM (SELECT repo_url, commit_hash, part_no, unnest(string_split(diff_part, chr(10))) AS l,
                   generate_subscripts(string_split(diff_part, chr(10)), 1) AS i FROM parts))
GROUP BY repo_url, commit_hash, part_no, no"""))
def q_verdict_prompts(spark, sf_dir):
    """The numbered classifier prompts of each part, the whole diff among them."""
    return _parts(spark, sf_dir).select(*_DK, "part_no", F.posexplode(verdict.prompt_texts()).alias("prompt_no", "prompt"))


_RULE_F, _RULE_E = sqltext.rule_scorer_cols()


@register("functional_rule_scorer", with_fixtures(f"""WITH every_diff AS (
  SELECT * FROM commit_diffs UNION ALL SELECT * FROM rename_diffs),
{sqltext.diff_ctes('every_diff', _DK)}
SELECT repo_url, commit_hash, part_no, {_RULE_F} AS is_functional, {_RULE_E} AS explanation FROM parts""",
                                                  "commit_diffs", "rename_diffs"))
def q_functional_rule_scorer(spark, sf_dir):
    """The default (rule) scorer's verdict per part, planted renames among them."""
    every = fixture(spark, sf_dir, "commit_diffs").unionByName(fixture(spark, sf_dir, "rename_diffs"))
    return verdict.rule_scorer(dops.diff_parts(every)).select(*_DK, "part_no", "is_functional", "explanation")


_ANSWER = sqltext.trim("string_split(text, '[/INST]')[-1]")


@register("verdict_parse", f"""
SELECT conv_id, turn,
  CASE WHEN upper(a) LIKE '%YES%' THEN true WHEN upper(a) LIKE '%NO%' THEN false ELSE true END AS is_functional,
  CASE WHEN upper(a) LIKE '%YES%' OR upper(a) LIKE '%NO%' THEN a ELSE '{verdict.UNCLEAR_PREFIX}' || a END AS explanation
FROM (SELECT conv_id, turn, {_ANSWER} AS a FROM conversations WHERE role = 'assistant')""")
def q_verdict_parse(spark, sf_dir):
    """Assistant turns of ``conversations`` parsed as classifier replies."""
    c = table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    is_f, expl = verdict.parse_reply("text")
    return c.select("conv_id", "turn", is_f.alias("is_functional"), expl.alias("explanation"))


# ---------------------------------------------------------------------------------
# Function inventory over the derived sources F-src (and F-src2 for C#/JS/Ruby).
# ---------------------------------------------------------------------------------
from patchtrace.operators import extract as xops  # noqa: E402
from patchtrace.operators import source_blocks  # noqa: E402


def _src_sql(select: str, extra: bool = False) -> str:
    src = "source_files_more" if extra else "source_files"
    return with_fixtures(f"WITH {sqltext.function_ctes(src, extra)}\n{select}", src)


def _functions(spark, sf_dir, extra=False, languages=None, bodies=True):
    src = fixture(spark, sf_dir, "source_files_more" if extra else "source_files")
    return xops.extract_functions(src, extra=extra, languages=languages, bodies=bodies)


_FN_COLS = ["path", "fn_no", "name", "signature", "start_line", "end_line", "body"]
_FN_SEL = ", ".join(_FN_COLS)


@register("language_labels", _src_sql(f"""SELECT path, lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) AS suffix,
  {sqltext.lang_case('path', xops.LANGUAGE_SUFFIXES)} AS language FROM source_files"""))
def q_language_labels(spark, sf_dir):
    """suffix and language label per source file."""
    src = fixture(spark, sf_dir, "source_files")
    return src.select("path", xops.suffix("path").alias("suffix"), xops.language_label("path").alias("language"))


@register("comment_strip", _src_sql("SELECT path, code FROM bf"))
def q_comment_strip(spark, sf_dir):
    """comment-stripped text of the brace-language files."""
    f = xops.label_files(fixture(spark, sf_dir, "source_files").select("path", "content"))
    return (f.where(F.col("language").isin("c", "cpp", "java", "rust"))
             .select("path", xops.strip_comments(F.col("content")).alias("code")))


for _key, _langs, _doc in [("functions_c", ("c", "cpp"), "F3: C/C++ functions (brace plan)."),
                           ("functions_java", ("java",), "F4: Java methods (brace plan)."),
                           ("functions_rust", ("rust",), "F5: Rust functions (brace plan)."),
                           ("functions_python", ("python",), "F6: Python functions (line plan).")]:
    def _make(langs, doc):
        def q_fn(spark, sf_dir):
            return _functions(spark, sf_dir, languages=list(langs)).select(*_FN_COLS)
        q_fn.__doc__ = doc
        return q_fn
    _in = ", ".join(f"'{x}'" for x in _langs)
    register(_key, _src_sql(f"SELECT {_FN_SEL} FROM functions WHERE language IN ({_in})"))(_make(_langs, _doc))

@register("functions_blocks", _src_sql(f"SELECT {_FN_SEL} FROM functions WHERE language IN ('c', 'cpp', 'java', 'rust')"))
def q_functions_blocks(spark, sf_dir):
    """F2-F5 over files of any size: the sources cut into small blocks, functions by prefix scans over them."""
    src = xops.label_files(fixture(spark, sf_dir, "source_files").select("path", "content"))
    src = src.where(F.col("language").isin(xops.BRACE_LANGUAGES))
    cut = blocks.text_blocks(src, ["path", "language"], "content", block_chars=1024)
    return source_blocks.brace_functions_of_blocks(cut, xops.BRACE_LANGUAGES).select(*_FN_COLS)


for _key, _lang, _doc in [("functions_cs", "csharp", "F10: C# methods (our header rule)."),
                          ("functions_js", "javascript", "F10: JavaScript function declarations (our rule)."),
                          ("functions_ruby", "ruby", "F10: Ruby methods (our def/end rule).")]:
    def _make2(lang, doc):
        def q_fn(spark, sf_dir):
            return _functions(spark, sf_dir, extra=True, languages=[lang]).select(*_FN_COLS)
        q_fn.__doc__ = doc
        return q_fn
    register(_key, _src_sql(f"SELECT {_FN_SEL} FROM functions WHERE language = '{_lang}'", extra=True))(_make2(_lang, _doc))


@register("function_spans", _src_sql("SELECT path, fn_no, language, start_line, end_line, start_pos, end_pos FROM functions"))
def q_function_spans(spark, sf_dir):
    """F7 + F8: line numbers and offsets of every function (all five languages)."""
    return _functions(spark, sf_dir, bodies=False).select("path", "fn_no", "language", "start_line", "end_line", "start_pos", "end_pos")


@register("functions_nested", _src_sql("""SELECT path, CAST(count(*) AS BIGINT) AS n_functions,
  list(name ORDER BY fn_no) AS names, list(start_line ORDER BY fn_no) AS start_lines FROM functions GROUP BY path"""))
def q_functions_nested(spark, sf_dir):
    """Functions grouped under their file (the JSON sink's shape)."""
    n = xops.nested_by_file(_functions(spark, sf_dir))
    return n.select("path", F.size("functions").cast("long").alias("n_functions"),
                    F.col("functions.name").alias("names"), F.col("functions.start_line").alias("start_lines"))


@register("inventory_counts", _src_sql("""SELECT l.language, count(*) AS n_files, count(n) AS n_files_with_functions,
  CAST(coalesce(sum(n), 0) AS BIGINT) AS n_functions
FROM (SELECT path, language FROM lf WHERE language IS NOT NULL) l
LEFT JOIN (SELECT path, count(*) AS n FROM functions GROUP BY path) c USING (path) GROUP BY l.language"""))
def q_inventory_counts(spark, sf_dir):
    """supported files, files with functions and functions, per language."""
    src = fixture(spark, sf_dir, "source_files")
    return xops.inventory_counts(src, _functions(spark, sf_dir, bodies=False))


# ---------------------------------------------------------------------------------
# Embedding with the built-in hashed encoder.
# ---------------------------------------------------------------------------------
from patchtrace.operators import embed as eops  # noqa: E402
from patchtrace.operators import subword  # noqa: E402


def _round_vec(c="embedding", digits=6):
    # most entries are zero, and rounding one goes through a decimal text
    return F.transform(F.col(c), lambda v: F.when(v == 0, F.lit(0.0)).otherwise(F.round(v, digits))).alias(c)


@register("token_windows", f"""
WITH {sqltext.embed_ctes('documents', ['doc_id'], 'text', 'd_')}
SELECT doc_id, CAST(w AS INTEGER) AS win_no, CAST(w * 256 AS INTEGER) AS start, CAST(least(w * 256 + 512, L) AS INTEGER) AS "end"
FROM d_wn""")
def q_token_windows(spark, sf_dir):
    """Token windows (512 / stride 256) of every whole document."""
    d = table(spark, sf_dir, "documents")
    return eops.token_windows(d, ["doc_id"]).select("doc_id", "win_no", "start", "end")


@register("window_vectors", f"""
WITH {sqltext.embed_ctes('documents', ['doc_id'], 'text', 'd_', per_window=True)}
SELECT doc_id, CAST(w AS INTEGER) AS win_no, {sqltext.round_list('embedding')} AS embedding FROM d_vec""")
def q_window_vectors(spark, sf_dir):
    """The hashed encoder's vector of every window of every document."""
    d = table(spark, sf_dir, "documents")
    v = eops.window_vectors(eops.token_windows(d, ["doc_id"]), ["doc_id"])
    return v.select("doc_id", "win_no", _round_vec())


@register("mean_pool", f"""
WITH {sqltext.embed_ctes('documents', ['doc_id'], 'text', 'd_')}
SELECT doc_id, {sqltext.round_list('embedding')} AS embedding FROM d_vec""")
def q_mean_pool(spark, sf_dir):
    """Mean of the window vectors per document (dense path)."""
    d = table(spark, sf_dir, "documents")
    v = eops.mean_pool(eops.window_vectors(eops.token_windows(d, ["doc_id"]), ["doc_id"]), ["doc_id"])
    return v.select("doc_id", _round_vec())


@register("subword_windows")
def q_subword_windows(spark, sf_dir):
    """E1 in a public tokenizer's ids: windows of every document, as digests of their ids."""
    import public_tokenizers
    docs = table(spark, sf_dir, "documents")
    w = subword.subword_windows(docs, ["doc_id"], subword.rank_tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"),
                                                                           public_tokenizers.PATTERN))
    return w.select("doc_id", "win_no", "start", "end", subword.ids_digest().alias("ids_md5"))


@register("corpus_embeddings", with_fixtures(f"""
WITH {sqltext.embed_ctes('source_files', ['path'], 'content', 'f_')}
SELECT path, {sqltext.round_list('embedding')} AS embedding FROM f_vec""", "source_files"))
def q_corpus_embeddings(spark, sf_dir):
    """E5: one vector per source file (fused windows + mean)."""
    src = fixture(spark, sf_dir, "source_files")
    return eops.embed_texts(src, ["path"], "content").select("path", _round_vec())


@register("zero_fallback", _diff_sql(f"""
, {sqltext.embed_ctes('parts', ['repo_url', 'commit_hash', 'part_no'], 'old_version', 'z_', special=False)}
SELECT p.repo_url, p.commit_hash, p.part_no,
       coalesce({sqltext.round_list('v.embedding')}, list_transform(range(256), lambda i: 0.0)) AS embedding
FROM parts p LEFT JOIN z_vec v USING (repo_url, commit_hash, part_no)""".replace("\n, ", ",\n", 1)))
def q_zero_fallback(spark, sf_dir):
    """Old versions embedded without special tokens; parts with fewer than two
    tokens (pure additions) get the zero vector."""
    parts = dops.with_old_version(_parts(spark, sf_dir))
    key = ["repo_url", "commit_hash", "part_no"]
    v = eops.embed_texts(parts, key, "old_version", special=False)
    return eops.with_zero_fallback(parts, v, key).select(*key, _round_vec())


# ---------------------------------------------------------------------------------
# Fragments, end-to-end match and report (the reference's threshold 0.947).
# ---------------------------------------------------------------------------------
from patchtrace.plans import pipeline  # noqa: E402
from patchtrace.sources import sinks  # noqa: E402

_VK = ["cve_id", "repo_url", "commit_hash"]
_VF_RULE_F, _ = sqltext.rule_scorer_cols()
_FRAG_CTES = f"""{_CVE_CTES},
vj AS (SELECT k.cve_id, k.repo_url, k.commit_hash, c.diff_text FROM keys k JOIN commit_diffs c USING (repo_url, commit_hash)),
{sqltext.diff_ctes('vj', _VK, prefix='v_')},
vfrag AS (SELECT 'part_' || CAST(part_no AS VARCHAR) || '_' || replace(file, '/', '_') AS fragment_id,
                 cve_id, repo_url, commit_hash, part_no, file, old_version AS code
          FROM v_parts WHERE {_VF_RULE_F})"""


def _m6_sql(select: str) -> str:
    return with_fixtures(f"WITH {_FRAG_CTES}\n{select}", "cve_feed", "commit_diffs", "source_files")


@register("vulnerable_fragments", _m6_sql("SELECT fragment_id, cve_id, repo_url, commit_hash, part_no, file, code FROM vfrag"))
def q_vulnerable_fragments(spark, sf_dir):
    """D8 + T7: functional parts of CVE fix commits with their pre-fix code."""
    return pipeline.vulnerable_fragments(fixture(spark, sf_dir, "cve_feed"), fixture(spark, sf_dir, "commit_diffs"))


def _unit_ctes(vec: str, out: str) -> str:
    return f"{out} AS (SELECT path, embedding AS v, sqrt(list_dot_product(embedding, embedding)) AS nrm FROM {vec})"


_KV_CTES = f""",
frag AS (SELECT cve_id || '/' || replace(regexp_replace(repo_url, '^https://', ''), '/', '_') || '_' || commit_hash || '/' || fragment_id AS path,
                cve_id, code AS text FROM vfrag WHERE code <> ''),
{sqltext.function_ctes('source_files', p='s_')},
fn AS (SELECT project_id || '/' || path || '#' || CAST(fn_no AS VARCHAR) AS path, body AS text
       FROM s_functions JOIN (SELECT path, project_id FROM source_files) USING (path)),
{sqltext.embed_ctes('frag', ['path'], 'text', 'c_')},
{sqltext.embed_ctes('fn', ['path'], 'text', 'p_')},
{_unit_ctes('c_vec', 'cu')}, {_unit_ctes('p_vec', 'pu')},
kv AS (SELECT * FROM (SELECT a.path AS cve_function_path, b.path AS project_function_path,
                             CASE WHEN a.nrm = 0 OR b.nrm = 0 THEN 0.0 ELSE list_dot_product(a.v, b.v) / (a.nrm * b.nrm) END AS similarity
                      FROM cu a, pu b) WHERE similarity >= {match.REFERENCE_THRESHOLD})"""


@register("known_vulnerabilities")
def q_known_vulnerabilities(spark, sf_dir):
    """M6: CVE fragments (functional) matched against every function of the corpus."""
    r = pipeline.known_vulnerabilities(spark, fixture(spark, sf_dir, "cve_feed"), fixture(spark, sf_dir, "commit_diffs"),
                                       fixture(spark, sf_dir, "source_files"))
    return match.rounded(r)


ORACLE["known_vulnerabilities"] = with_fixtures(f"""WITH {_FRAG_CTES}{_KV_CTES}
SELECT f.cve_id, kv.cve_function_path, kv.project_function_path, round(kv.similarity, 4) AS similarity
FROM kv JOIN frag f ON f.path = kv.cve_function_path""", "cve_feed", "commit_diffs", "source_files")
ORACLE["clone_counts_e2e"] = with_fixtures(f"""WITH {_FRAG_CTES}{_KV_CTES}
SELECT cve_function_path, count(*) AS n_clones FROM kv GROUP BY cve_function_path""", "cve_feed", "commit_diffs", "source_files")


@register("clone_counts_e2e")
def q_clone_counts_e2e(spark, sf_dir):
    """M3 on the end-to-end pairs: clones found per CVE fragment."""
    r = pipeline.known_vulnerabilities(spark, fixture(spark, sf_dir, "cve_feed"), fixture(spark, sf_dir, "commit_diffs"),
                                       fixture(spark, sf_dir, "source_files"))
    return match.clone_counts(r)


@register("clone_report", with_fixtures(f"""WITH {_FRAG_CTES}{_KV_CTES}
SELECT cve_function_path, project_function_path, round(similarity, 4) AS similarity FROM kv""",
                                        "cve_feed", "commit_diffs", "source_files"))
def q_clone_report(spark, sf_dir):
    """The end-to-end pairs (fragments x functions) written as JSON to the shared
    folder and read back."""
    pairs = pipeline.known_vulnerabilities(spark, fixture(spark, sf_dir, "cve_feed"), fixture(spark, sf_dir, "commit_diffs"),
                                           fixture(spark, sf_dir, "source_files")).drop("cve_id")
    out = shared_path(spark, "reports", uuid.uuid4().hex)
    sinks.write_clone_report(match.rounded(pairs), out)
    return sinks.read_clone_report(spark, out)


# ---------------------------------------------------------------------------------
# Sources, syntax-tree tool outputs, output keys, upsert, incremental and streamed use.
# ---------------------------------------------------------------------------------
from patchtrace.operators import spans as spops  # noqa: E402
from patchtrace.sources import files as filesrc  # noqa: E402
from patchtrace.sources import trees  # noqa: E402
from patchtrace.streaming import incremental, match_index, record_table  # noqa: E402


@register("source_tree_filter", with_fixtures(f"""
SELECT path, {sqltext.lang_case('path', xops.LANGUAGE_SUFFIXES)} AS language,
       regexp_matches(path, '^src/[^/]+$') AS in_flat_listing
FROM (SELECT path FROM source_files UNION ALL SELECT path FROM source_files_more
      UNION ALL SELECT 'docs/d' || CAST(doc_id AS VARCHAR) || '.md' FROM documents)
WHERE lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) IN ({', '.join(sqltext.q(s) for s in filesrc.supported_suffixes())})""",
    "source_files", "source_files_more"))
def q_source_tree_filter(spark, sf_dir):
    """Supported files of a listing (F-src, F-src2 and markdown docs), with the flat
    (non-recursive) listing of folder ``src`` marked."""
    listing = (fixture(spark, sf_dir, "source_files").select("path")
               .unionByName(fixture(spark, sf_dir, "source_files_more").select("path"))
               .unionByName(table(spark, sf_dir, "documents")
                            .select(F.concat(F.lit("docs/d"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))))
    kept = filesrc.filter_supported(listing)
    return kept.select("path", xops.language_label("path").alias("language"),
                       filesrc.flat_listing(kept, "src").alias("in_flat_listing"))


@register("decode_policy", with_fixtures("""
SELECT path, 'ignore' AS policy, content AS text FROM source_files
UNION ALL SELECT path, 'skip' AS policy, content AS text FROM source_files WHERE NOT ends_with(lower(path), '.c')""",
    "source_files"))
def q_decode_policy(spark, sf_dir):
    """S3: F-src stored as CRLF bytes, with an undecodable byte appended to the .c files;
    decoded under both policies (ignore: byte dropped; skip: file dropped)."""
    src = fixture(spark, sf_dir, "source_files")
    raw = src.select("path", F.concat(
        F.encode(F.replace(F.col("content"), F.lit("\n"), F.lit("\r\n")), "UTF-8"),
        F.when(F.lower("path").endswith(".c"), F.expr("X'FF'")).otherwise(F.expr("X''"))).alias("content"))
    ign = filesrc.decoded_files(raw, "ignore").select("path", F.lit("ignore").alias("policy"), "text")
    skp = filesrc.decoded_files(raw, "skip").select("path", F.lit("skip").alias("policy"), "text")
    return ign.unionByName(skp)


def _dumps(spark, sf_dir):
    """Parse dumps derived from the F-src function table: one dump per file, one
    function node (with a child) and one comment node per function."""
    f = _functions(spark, sf_dir).withColumn("_kind", spops.node_kind("path"))
    r1 = (F.col("start_line") - 1).cast("string")
    r2 = (F.col("end_line") - 1).cast("string")
    node = F.concat(F.lit("\n  ("), F.col("_kind"), F.lit(" ["), r1, F.lit(", 0] - ["), r2, F.lit(", 1]\n"),
                    F.lit("    name: (identifier ["), r1, F.lit(", 4] - ["), r1, F.lit(", 7]))\n"),
                    F.lit("  (comment ["), r2, F.lit(", 0] - ["), r2, F.lit(", 2])"))
    g = f.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("fn_no", node.alias("node")))).alias("_n"))
    return g.select(F.col("path").alias("file_path"),
                    F.concat(F.lit("(translation_unit [0, 0] - [9999, 0]"),
                             F.array_join(F.transform("_n", lambda x: x["node"]), ""), F.lit(")")).alias("dump"))


def _dump_sql() -> str:
    from patchtrace.operators.spans import SUFFIX_NODE_KIND
    kinds = sorted(set(SUFFIX_NODE_KIND.values()))
    ext = "CASE kind " + " ".join(
        f"WHEN {sqltext.q(k)} THEN regexp_extract_all(dump, {sqltext.q(spops.node_pattern(k))}, 0)" for k in kinds) + " END"
    num = r"\[([0-9]+),[^0-9]*([0-9]+)\][^\[]*\[([0-9]+),[^0-9]*([0-9]+)\]"
    return f""",
dumps AS (SELECT path AS file_path, '(translation_unit [0, 0] - [9999, 0]' ||
                 string_agg({sqltext.dump_node(sqltext.node_kind_case('path'), 'start_line', 'end_line')}, '' ORDER BY fn_no) || ')' AS dump
          FROM functions GROUP BY path),
spx AS (SELECT file_path, generate_subscripts(ns, 1) - 1 AS span_no, unnest(ns) AS node
        FROM (SELECT file_path, {ext} AS ns FROM (SELECT *, {sqltext.node_kind_case('file_path')} AS kind FROM dumps) WHERE kind IS NOT NULL)),
spn AS (SELECT file_path, CAST(span_no AS INTEGER) AS span_no,
               CAST(regexp_extract(node, '{num}', 1) AS INTEGER) AS start_row, CAST(regexp_extract(node, '{num}', 2) AS INTEGER) AS start_col,
               CAST(regexp_extract(node, '{num}', 3) AS INTEGER) AS end_row, CAST(regexp_extract(node, '{num}', 4) AS INTEGER) AS end_col
        FROM spx)"""


@register("dump_spans")
def q_dump_spans(spark, sf_dir):
    """function spans read from parse dumps (kind chosen by file suffix)."""
    return spops.dump_spans(_dumps(spark, sf_dir))


ORACLE["dump_spans"] = with_fixtures(f"WITH {sqltext.function_ctes('source_files')}{_dump_sql()}\n"
                                     "SELECT file_path, span_no, start_row, start_col, end_row, end_col FROM spn", "source_files")


@register("span_slices")
def q_span_slices(spark, sf_dir):
    """the text of each dump span, cut from the source file by (row, column)."""
    src = fixture(spark, sf_dir, "source_files").select(F.col("path").alias("file_path"), "content")
    return spops.slice_spans(spops.dump_spans(_dumps(spark, sf_dir)), src).select(
        "file_path", "span_no", "contents")


ORACLE["span_slices"] = with_fixtures(f"""WITH {sqltext.function_ctes('source_files')}{_dump_sql()},
sl AS (SELECT path AS file_path, generate_subscripts(ls, 1) - 1 AS row, unnest(ls) AS line
       FROM (SELECT path, string_split(content, chr(10)) AS ls FROM source_files)),
so AS (SELECT file_path, row, length(line) + 1 AS len,
              CAST(sum(length(line) + 1) OVER (PARTITION BY file_path ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - length(line) - 1 AS off
       FROM sl),
ab AS (SELECT n.file_path, n.span_no, s.off + least(n.start_col, s.len) AS a, e.off + least(n.end_col, e.len) AS b
       FROM spn n JOIN so s ON s.file_path = n.file_path AND s.row = n.start_row
                  JOIN so e ON e.file_path = n.file_path AND e.row = n.end_row)
SELECT ab.file_path, ab.span_no, CASE WHEN b > a THEN substr(f.content, a + 1, b - a) ELSE '' END AS contents
FROM ab JOIN source_files f ON f.path = ab.file_path""", "source_files")


@register("cutter_records")
def q_cutter_records(spark, sf_dir):
    """The cutter's records, one per file, written as JSON to the shared folder and read back."""
    src = fixture(spark, sf_dir, "source_files").select(F.col("path").alias("file_path"), "content")
    records = spops.file_records(spops.slice_spans(spops.dump_spans(_dumps(spark, sf_dir)), src))
    out = shared_path(spark, "cutter", uuid.uuid4().hex)
    sinks.write_functions_json(records, out)
    r = spark.read.schema(records.schema).json(out)
    return r.select("file_path", F.col("functions.start.row").alias("start_rows"),
                    F.col("functions.end.column").alias("end_columns"), F.col("functions.contents").alias("contents"))


ORACLE["cutter_records"] = ORACLE["span_slices"].replace(
    "SELECT ab.file_path, ab.span_no, CASE",
    """SELECT ab.file_path, list(ab.start_row ORDER BY ab.span_no) AS start_rows, list(ab.end_col ORDER BY ab.span_no) AS end_columns,
       list(CASE""").replace("ELSE '' END AS contents", "ELSE '' END ORDER BY ab.span_no) AS contents").replace(
    "SELECT n.file_path, n.span_no, s.off", "SELECT n.file_path, n.span_no, n.start_row, n.end_col, s.off") + "\nGROUP BY ab.file_path"


@register("function_bodies", _src_sql("""SELECT name || CAST(row_number() OVER (ORDER BY path, fn_no) - 1 AS VARCHAR) AS output_key,
  body, path, fn_no FROM functions"""))
def q_function_bodies(spark, sf_dir):
    """Every function body under its output name, written to the shared folder and read back."""
    out = shared_path(spark, "bodies", uuid.uuid4().hex)
    sinks.write_bodies(_functions(spark, sf_dir), out)
    return spark.read.parquet(out)


@register("upsert_latest", """
SELECT file_path, seq, lang, n_chars FROM (
  SELECT source AS file_path, doc_id AS seq, lang, n_chars,
         row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS rn FROM documents) WHERE rn = 1""")
def q_upsert_latest(spark, sf_dir):
    """latest record per key over a record stream with many records per key
    (documents as records keyed by source, ordered by id)."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("file_path"), F.col("doc_id").alias("seq"),
                                                  "lang", "n_chars")
    return spops.latest_per_key(d, "file_path", "seq")


_RECORDS = "file_path string, seq long, lang string, n_chars long"


@register("upsert_stream", """
SELECT file_path, seq, lang, n_chars FROM (
  SELECT md5(text) AS file_path, doc_id AS seq, lang, n_chars,
         row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id DESC) AS rn FROM documents) WHERE rn = 1""")
def q_upsert_stream(spark, sf_dir):
    """F13 + I2: a record for each text, which its copies replace; the records arrive in three turns, out of
    order and a third of them twice, and each batch rewrites the buckets that it touches."""
    run = uuid.uuid4().hex
    landing, state = shared_path(spark, "records", run), shared_path(spark, "stream-state", run, "records")
    held = record_table.RecordTable(spark, shared_path(spark, "record-table", run), _RECORDS, n_buckets=16)
    d = table(spark, sf_dir, "documents").select(F.md5("text").alias("file_path"), F.col("doc_id").alias("seq"), "lang", "n_chars")
    turn = F.pmod(F.xxhash64("seq"), F.lit(3))
    for k in (0, 1, 2):
        arrived = d.where(turn == k) if k < 2 else d.where(turn == 2).unionByName(d.where(turn == 0))
        arrived.write.mode("append").parquet(landing)
        record_table.upsert_arrivals(spark, landing, _RECORDS, state, held)
    return held.read()


_PLACED = "'/src/' || project_id || '/' || CASE WHEN path LIKE '%1%' THEN 'vendor/lib/' WHEN path LIKE '%2%' THEN 'vendorx/' ELSE '' END || path"


@register("projects_scan", with_fixtures(f"""WITH placed AS (SELECT {_PLACED} AS path, length(content) AS n_chars FROM source_files),
roots AS (SELECT DISTINCT '/src/' || project_id AS root, project_id FROM source_files WHERE project_id <> 'proj3'
          UNION ALL SELECT DISTINCT '/src/' || project_id || '/vendor', 'vendor-of-' || project_id FROM source_files)
SELECT path, project_id, n_chars FROM (
  SELECT path, n_chars, r.project_id, row_number() OVER (PARTITION BY path ORDER BY length(root) DESC) AS rn
  FROM placed JOIN roots r ON starts_with(path, root || '/')) WHERE rn = 1""", "source_files"))
def q_projects_scan(spark, sf_dir):
    """M5 + S2: files below the roots of many projects, some inside others, each with its project."""
    src = fixture(spark, sf_dir, "source_files")
    placed = src.select(F.expr(_PLACED).alias("path"), F.length("content").cast("long").alias("n_chars"))
    own = src.select("project_id").distinct()
    roots = (own.where("project_id <> 'proj3'").select(F.concat(F.lit("/src/"), "project_id").alias("root"), "project_id")
             .unionByName(own.select(F.concat(F.lit("/src/"), "project_id", F.lit("/vendor")).alias("root"),
                                     F.concat(F.lit("vendor-of-"), "project_id").alias("project_id"))))
    return trees.assign_projects(placed, roots).select("path", "project_id", "n_chars")


_NEXT_PATH = "CASE WHEN path LIKE '%7.%' THEN 'moved/' || path ELSE path END"
_NEXT_TEXT = "CASE WHEN path LIKE '%3.%' THEN content || 'x' ELSE content END"


@register("tree_delta", with_fixtures(f"""WITH o AS (
  SELECT project_id, path, sha256(content) AS old_digest FROM source_files WHERE path NOT LIKE '%5.%'),
n AS (SELECT project_id, {_NEXT_PATH} AS path, sha256({_NEXT_TEXT}) AS digest FROM source_files WHERE path NOT LIKE '%6.%'),
j AS (SELECT project_id, path, digest, old_digest, CASE WHEN old_digest IS NULL THEN 'added' WHEN digest IS NULL THEN 'removed'
             WHEN digest <> old_digest THEN 'changed' ELSE 'same' END AS status FROM o FULL OUTER JOIN n USING (project_id, path)),
g AS (SELECT old_digest AS d, min((project_id, path)) AS f FROM j WHERE status = 'removed'
        AND old_digest IN (SELECT digest FROM j WHERE status = 'added') GROUP BY old_digest)
SELECT j.project_id, j.path, CASE WHEN status = 'added' AND f IS NOT NULL THEN 'moved' ELSE status END AS status, digest, old_digest,
       CASE WHEN status = 'added' THEN f[1] END AS from_project_id, CASE WHEN status = 'added' THEN f[2] END AS from_path
FROM j LEFT JOIN g ON d = coalesce(digest, old_digest)
WHERE NOT (status = 'removed' AND f IS NOT NULL AND f = (j.project_id, j.path))""", "source_files"))
def q_tree_delta(spark, sf_dir):
    """F1/S2 + I1: two states of the source files compared: added, changed, removed, moved and same ones."""
    src, key = fixture(spark, sf_dir, "source_files"), ["project_id", "path"]
    later = src.where("path NOT LIKE '%6.%'").select(
        "project_id", F.expr(_NEXT_PATH).alias("path"), F.expr(_NEXT_TEXT).alias("content"))
    return trees.tree_delta(trees.snapshot(src.where("path NOT LIKE '%5.%'"), key), trees.snapshot(later, key), key)


@register("function_output_keys", _src_sql("""SELECT path, fn_no, name, row_number() OVER (ORDER BY path, fn_no) - 1 AS counter,
  name || CAST(row_number() OVER (ORDER BY path, fn_no) - 1 AS VARCHAR) AS output_key FROM functions"""))
def q_function_output_keys(spark, sf_dir):
    """Per-function output names ``<name><running counter>`` in (path, fn_no) order."""
    return sinks.output_keys(_functions(spark, sf_dir, bodies=False))


@register("new_commits_only", with_fixtures(f"""
WITH {_CVE_CTES},
allkeys AS (SELECT DISTINCT cve_id, repo_url, commit_hash FROM (
   SELECT cve_id, 'https://github.com/' || regexp_extract(link, '{cve.COMMIT_KEY_PATTERN}', 1) AS repo_url,
          regexp_extract(link, '{cve.COMMIT_KEY_PATTERN}', 2) AS commit_hash, substr(cve_id, 5, 4) AS y
   FROM (SELECT DISTINCT link, cve_id FROM links) WHERE regexp_extract(link, '{cve.COMMIT_KEY_PATTERN}', 1) <> ''))
SELECT a.cve_id, a.repo_url, a.commit_hash FROM allkeys a
WHERE NOT EXISTS (SELECT 1 FROM allkeys p WHERE substr(p.cve_id, 5, 4) <= '2013'
                  AND p.repo_url = a.repo_url AND p.commit_hash = a.commit_hash)""", "cve_feed"))
def q_new_commits_only(spark, sf_dir):
    """Commits of all years not already processed by an earlier run (years up to 2013)."""
    links = cve.commit_links(cve.first_cve_id(fixture(spark, sf_dir, "cve_feed")))
    keys = cve.commit_keys(cve.cve_links(links)).select("cve_id", "repo_url", "commit_hash").distinct()
    done = keys.where(cve.cve_year() <= "2013")
    return incremental.new_only(keys, done, ["repo_url", "commit_hash"])


@register("stream_clone_scan", _diff_sql(f"""SELECT repo_url, commit_hash, part_no,
  'part_' || CAST(part_no AS VARCHAR) || '_' || replace(file, '/', '_') AS fragment_id, old_version AS code
FROM parts WHERE {_RULE_F}"""))
def q_stream_clone_scan(spark, sf_dir):
    """Diffs land as files; a Structured Streaming query (availableNow, checkpointed)
    mines each file once with the batch operators via foreachBatch."""
    run = uuid.uuid4().hex
    landing = shared_path(spark, "landing", run)
    out = shared_path(spark, "fragments", run)
    ckpt = shared_path(spark, "stream-state", run)
    d = fixture(spark, sf_dir, "commit_diffs")
    d.write.mode("overwrite").parquet(landing)

    def mine(batch):
        parts = dops.with_old_version(dops.diff_parts(batch))
        kept = verdict.functional_only(verdict.rule_scorer(parts))
        return kept.select(*_DK, "part_no", dops.fragment_id().alias("fragment_id"), F.col("old_version").alias("code"))

    incremental.process_arrivals(spark, landing, "repo_url string, commit_hash string, diff_text string",
                                 out, ckpt, mine)
    return spark.read.parquet(out).select(*_DK, "part_no", "fragment_id", "code")


@register("stream_known_vulnerabilities", ORACLE["known_vulnerabilities"])
def q_stream_known_vulnerabilities(spark, sf_dir):
    """M6 + I2: diffs and source files arrive as two streams, in two turns each; every batch is matched
    with all that came before by the persisted index. The pairs are those of the batch match."""
    run = uuid.uuid4().hex
    index = match_index.MatchIndex(spark, shared_path(spark, "match-index", run))
    keys = cve.commit_keys(cve.cve_links(_links(spark, sf_dir))).checkpoint()
    later = F.pmod(F.xxhash64("path"), F.lit(2))  # which turn a row arrives in; both turns are read
    arrivals = {
        "cve": (fixture(spark, sf_dir, "commit_diffs").withColumn("path", F.col("commit_hash")),
                lambda d: eops.embed_texts(pipeline.fragment_items(pipeline.mined_fragments(keys, d)), ["path"])),
        "project": (fixture(spark, sf_dir, "source_files"),
                    lambda d: eops.embed_texts(pipeline.function_items(xops.extract_functions(d)), ["path"]))}
    for turn in (0, 1):
        for side, (rows, to_vectors) in arrivals.items():
            landing, state = shared_path(spark, "arrivals", run, side), shared_path(spark, "stream-state", run, side)
            rows.where(later == turn).write.mode("append").parquet(landing)
            match_index.match_arrivals(spark, landing, rows.schema.simpleString()[7:-1].replace(":", " "), state, index, side, to_vectors)
    pairs = match.rounded(index.pairs())
    return pairs.select(F.substring_index("cve_function_path", "/", 1).alias("cve_id"), "*")


from patchtrace.sources import vectors as vecsrc  # noqa: E402


@register("fragment_sink", _m6_sql("""SELECT fragment_id, cve_id, repo_url, commit_hash, part_no, file, code,
  substr(cve_id, 5, 4) AS cve_year FROM vfrag"""))
def q_fragment_sink(spark, sf_dir):
    """Functional fragments written to the shared folder partitioned by CVE year and
    read back, every year."""
    out = shared_path(spark, "fragments-by-year", uuid.uuid4().hex)
    sinks.write_fragments(pipeline.vulnerable_fragments(fixture(spark, sf_dir, "cve_feed"),
                                                        fixture(spark, sf_dir, "commit_diffs")), out)
    back = spark.read.parquet(out)
    return back.select("fragment_id", "cve_id", "repo_url", "commit_hash", "part_no", "file", "code",
                       F.col("cve_year").cast("string").alias("cve_year"))


@register("embedding_sink", with_fixtures(f"""
WITH {sqltext.embed_ctes('source_files', ['path'], 'content', 'f_')}
SELECT path, {sqltext.round_list('embedding')} AS embedding FROM f_vec""", "source_files"))
def q_embedding_sink(spark, sf_dir):
    """S9 + S4: file vectors written as JSON lines to the shared folder and scanned back."""
    out = shared_path(spark, "embeddings", uuid.uuid4().hex)
    src = fixture(spark, sf_dir, "source_files")
    sinks.write_embeddings(eops.embed_texts(src, ["path"], "content"), out, fmt="json")
    return vecsrc.read_vectors(spark, out, "json").select("path", _round_vec())
