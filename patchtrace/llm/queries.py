"""The registered queries of this subpackage, with their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchtrace.llm import (bpe_automaton, centroids, exact_dedup, html_extract, language_id, license_scan, line_dedup,
                            ngram_join, packing, quality_classifier, quality_rules, sharding, spelling)
from patchtrace.llm.common import fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql.strip()
        return fn
    return deco


@register("op1_html_extract")
def op1_html_extract(spark, sf_dir):
    """Main text of every page."""
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


@register("op2_language_id")
def op2_language_id(spark, sf_dir):
    """Predicted language of every document; learned from the rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, public_tokenizers.path("piece_bpe_32k.model"),
                            learn_from=lambda c: fold(c, 4) != 2)
    return (language_id.identify(docs, model)
            .select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
                    "lang_pred", "score"))


@register("op3_exact_dedup", r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
     r AS (SELECT doc_id, norm, n, sha256(norm) AS text_sha256 FROM d)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM r WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)""")
def op3_exact_dedup(spark, sf_dir):
    """Which row of each group of equal texts stays, for every document."""
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("row_key", "row_no")


@register("op4_quality_classifier")
def op4_quality_classifier(spark, sf_dir):
    """Quality score of every document; labels of the held-out fifth are not read."""
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"),
                                   learn_from=lambda c: fold(c, 5) != 0)
    return (quality_classifier.score(docs, model, threshold=0.3)
            .select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
                    "score", "predicted"))


SHARDS = [f"shard-{i:03d}" for i in range(64)]


@register("op5_sharding", f"""
SELECT doc_id, slot, {sharding.lookup_table(SHARDS).tolist()}[slot + 1] AS shard
FROM (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 15)
                          AS BIGINT) % {sharding.SLOTS} AS slot FROM documents)""")
def op5_sharding(spark, sf_dir):
    """The shard of every document, by the lookup table."""
    return sharding.place(table(spark, sf_dir, "documents"), SHARDS)


@register("op6_packing")
def op6_packing(spark, sf_dir):
    """All documents packed into sequences of at most 2048 tokens, one row per piece."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"),
                                  end_id=1)


@register("op7_license_scan")
def op7_license_scan(spark, sf_dir):
    """Every license notice in the documents, with its template and its wording differences."""
    return license_scan.scan_documents(table(spark, sf_dir, "documents"))


@register("op8_ngram_join", r"""
WITH RECURSIVE w AS (
       SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS l
       FROM documents),
     s AS (SELECT doc_id, CASE WHEN len(l) = 0 THEN []
                  WHEN len(l) < 5 THEN [array_to_string(l, ' ')]
                  ELSE list_distinct([array_to_string(l[i:i + 4], ' ')
                                           FOR i IN range(1, len(l) - 3)]) END AS g FROM w),
     n AS (SELECT doc_id, len(g) AS n_shingles, md5(array_to_string(list_sort(g), chr(10))) AS k, g FROM s),
     c AS (SELECT min(doc_id) AS c, any_value(n_shingles) AS n, any_value(g) AS g FROM n
           WHERE n_shingles > 0 GROUP BY k),
     p AS (SELECT c, n, unnest(g) AS x FROM c),
     e AS (SELECT a.c AS u, b.c AS v FROM p a JOIN p b ON a.x = b.x AND a.c <> b.c
           GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
     r AS (SELECT c AS node, c AS low FROM c UNION SELECT e.v, r.low FROM r JOIN e ON e.u = r.node
           WHERE r.low < e.v),
     m AS (SELECT node, min(low) AS low FROM r GROUP BY node)
SELECT n.doc_id, n.n_shingles, coalesce(m.low, n.doc_id) AS component_id
FROM n LEFT JOIN (SELECT k, min(doc_id) AS c FROM n WHERE n_shingles > 0 GROUP BY k) z ON z.k = n.k
       LEFT JOIN m ON m.node = z.c""")
def op8_ngram_join(spark, sf_dir):
    """Size of every document's shingle set and the group of documents it is linked with."""
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


@register("op9_bpe_automaton")
def op9_bpe_automaton(spark, sf_dir):
    """Ids of every document under a byte-level BPE, and the text decoded from them, as digests."""
    return bpe_automaton.digests(table(spark, sf_dir, "documents"),
                                 public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


@register("op10_quality_rules")
def op10_quality_rules(spark, sf_dir):
    """Rule counts of every document and the verdict of its divergence from the languages."""
    docs = table(spark, sf_dir, "documents")
    return quality_rules.quality_rules(docs, quality_rules.references(docs))


def _round_sql(before: str) -> str:
    """The vectors of ``before``'s centroids after one assignment and update, as SQL."""
    return f"""
     SELECT c, list(q ORDER BY i) AS w FROM (
       SELECT c, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS q FROM (
         SELECT c, i, sum(x) AS s, count(*) AS n FROM (
           SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM ({_nearest_sql(before)})) GROUP BY c, i))
     GROUP BY c
     UNION ALL SELECT c, w FROM {before} WHERE c NOT IN (SELECT c FROM ({_nearest_sql(before)}))"""


def _nearest_sql(centers: str) -> str:
    return f"""SELECT r, vec_id, v, c, d FROM (
       SELECT r, vec_id, v, c, d, row_number() OVER (PARTITION BY r ORDER BY d, c) AS place FROM (
         SELECT r, vec_id, v, c, list_sum([(v[j] - w[j]) * (v[j] - w[j]) FOR j IN range(1, 65)])::BIGINT AS d
         FROM k, {centers})) WHERE place = 1"""


@register("op11_centroids", f"""
WITH k AS MATERIALIZED (
       SELECT row_number() OVER () AS r, vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM (
         SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = 64
           AND list_bool_and([x IS NOT NULL AND coalesce(abs(x) < 1048576, false) FOR x IN embedding]))),
     c0 AS MATERIALIZED (
       SELECT c, w FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c,
                                v AS w FROM k) WHERE c < 16),
     c1 AS MATERIALIZED ({_round_sql("c0")}),
     c2 AS MATERIALIZED ({_round_sql("c1")}),
     c3 AS MATERIALIZED ({_round_sql("c2")}),
     a AS MATERIALIZED ({_nearest_sql("c3")})
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256
FROM a JOIN c3 USING (c)""")
def op11_centroids(spark, sf_dir):
    """The cluster of every embedding, in exact integers."""
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


#: crc32 of a text of ASCII and of the letters U+00C0 to U+00FF, in SQL: a table made by its
#: rule, then one step a byte.
_CRC_SQL = """
     crc(t) AS MATERIALIZED (SELECT [list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x:
         CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FOR i IN range(256)]),
     h AS (SELECT run, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(
             [CASE WHEN p < 128 THEN [p::BIGINT] ELSE [195::BIGINT, (p - 64)::BIGINT] END
              FOR p IN [unicode(y) FOR y IN string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, '')]])),
             lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM runs, crc)"""


@register("op12_spelling", f"""
WITH RECURSIVE runs AS MATERIALIZED (
       SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')), '{spelling.UPPER}',
                                '{spelling.LOWER}') AS run FROM documents),
{_CRC_SQL},
     w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT)
                         || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM h),
     v AS MATERIALIZED (SELECT word, count(*) AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
     s AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) AS a, substr(word, i + 2) AS b
                        FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
     near AS (SELECT DISTINCT x, nx, y, ny FROM (
         SELECT p.word AS x, p.n AS nx, q.word AS y, q.n AS ny FROM s p JOIN s q
           ON p.i = q.i AND p.a = q.a AND p.b = q.b AND p.word <> q.word
         UNION ALL SELECT s.word, s.n, v.word, v.n FROM s JOIN v ON s.a || s.b = v.word
         UNION ALL SELECT v.word, v.n, s.word, s.n FROM s JOIN v ON s.a || s.b = v.word)),
     best AS (SELECT x, nx, count(*) AS n_near, first(y ORDER BY ny DESC, y) AS y, max(ny) AS ny FROM near GROUP BY x, nx),
     f AS MATERIALIZED (SELECT x AS word, y AS form, ny AS form_n FROM best WHERE ny >= 10 * nx),
     path AS (SELECT word, form AS root FROM f UNION ALL SELECT path.word, f.form FROM path JOIN f ON f.word = path.root)
SELECT v.word, f.form, coalesce(e.root, v.word) AS root, v.n, coalesce(best.n_near, 0) AS n_near, f.form_n
FROM v LEFT JOIN best ON best.x = v.word LEFT JOIN f ON f.word = v.word
     LEFT JOIN (SELECT word, root FROM path WHERE root NOT IN (SELECT word FROM f)) e ON e.word = v.word""")
def op12_spelling(spark, sf_dir):
    """Every word of the documents with its more frequent spelling, if it has one."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


@register("op13_line_dedup", rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
     x AS MATERIALIZED (SELECT r, doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM d),
     k AS MATERIALIZED (SELECT r, doc_id, i, line, translate(
            regexp_replace(line, '^[ 	-
]+|[ 	-
]+$', '', 'g'), '{line_dedup.UPPER}', '{line_dedup.LOWER}') AS key
          FROM x),
     g AS (SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
     z AS (SELECT k.*, g.key IS NOT NULL AND doc_id IS DISTINCT FROM owner AS gone FROM k LEFT JOIN g ON g.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM z GROUP BY r, doc_id""")
def op13_line_dedup(spark, sf_dir):
    """Lines that every document loses to another one that holds them too, and what it keeps."""
    docs = table(spark, sf_dir, "documents")
    return line_dedup.kept_lines(docs, line_dedup.keep_bitmaps(docs), with_text=False)
