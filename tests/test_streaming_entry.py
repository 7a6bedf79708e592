import os
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from patchtrace.operators import diffs, verdict
from patchtrace.plans.fixtures import TABLES, fixture
from patchtrace.streaming import incremental

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))
SF_SMALL = "/root/testdata/sf0.001"
SCHEMA = "repo_url string, commit_hash string, diff_text string"


def _mine(batch):
    p = verdict.functional_only(verdict.rule_scorer(diffs.with_old_version(diffs.diff_parts(batch))))
    return p.select("repo_url", "commit_hash", "part_no", F.col("old_version").alias("code"))


def test_stream_equals_batch_and_is_exactly_once(spark, tmpdir_path):
    d = fixture(spark, SF_SMALL, "commit_diffs")
    landing, out, ckpt = (os.path.join(tmpdir_path, x) for x in ("landing", "out", "ckpt"))
    first, second = d.randomSplit([0.5, 0.5], seed=7)
    first.repartition(2).write.parquet(landing + "/a")
    incremental.process_arrivals(spark, landing + "/*", SCHEMA, out, ckpt, _mine, max_files_per_trigger=1)
    n1 = spark.read.parquet(out).count()
    # a re-run with nothing new processes nothing
    incremental.process_arrivals(spark, landing + "/*", SCHEMA, out, ckpt, _mine, max_files_per_trigger=1)
    assert spark.read.parquet(out).count() == n1
    # new arrivals are processed once
    second.repartition(2).write.parquet(landing + "/b")
    incremental.process_arrivals(spark, landing + "/*", SCHEMA, out, ckpt, _mine, max_files_per_trigger=1)
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("repo_url", "commit_hash", "part_no", "code").collect())
    want = sorted(tuple(r) for r in _mine(d).collect())
    assert got == want


def test_end_to_end_with_a_model_and_projects(spark):
    from patchtrace.operators import embed, match
    from patchtrace.plans import pipeline

    def model():
        """A stand-in model: word counts in 768 buckets."""
        import zlib

        import numpy as np

        def encode(texts):
            out = np.zeros((len(texts), 768))
            for i, t in enumerate(texts):
                for w in t.split(" "):
                    out[i, zlib.crc32(w.encode()) % 768] += 1
            return out
        return encode

    old = "int f(int a)\n{\n  return a + b;\n}"
    diff = ("diff --git a/m.c b/m.c\n--- a/m.c\n+++ b/m.c\n@@ -1,4 +1,4 @@\n"
            + "\n".join("-" + x for x in old.split("\n")) + "\n+int f(int a) { return 1; }\n")
    feed = spark.createDataFrame([(1, "Name: CVE-2014-1234\nReference: https://github.com/o/r/commit/abc1234")], "entry_no long, entry string")
    diffs_df = spark.createDataFrame([("https://github.com/o/r", "abc1234", diff)], SCHEMA)
    src = spark.createDataFrame([("p1", "m.c", old + "\n"), ("p2", "m.c", old + "\n"), ("p2", "n.c", "void z(void)\n{\n}\n")],
                                "project_id string, path string, content string")
    enc = embed.window_encoder(embed.model_encoder(model, batch_size=4))
    vec = enc(spark.createDataFrame([("k", "a b c")], "path string, text string"), ["path"]).first().embedding
    assert len(vec) == 768 and sum(vec) == 5.0
    pairs = pipeline.known_vulnerabilities(spark, feed, diffs_df, src, threshold=0.9, encoder=enc)
    got = sorted((r.cve_id, r.project_function_path, round(r.similarity, 6)) for r in pairs.collect())
    assert [(a, b) for a, b, _ in got] == [("CVE-2014-1234", "p1/m.c#0"), ("CVE-2014-1234", "p2/m.c#0")]
    owners = src.select("project_id", F.concat("project_id", F.lit("/"), "path", F.lit("#0")).alias("path"))
    report = {r.project_id: r.n_pairs for r in match.project_reports(pairs, owners).collect()}
    assert report == {"p1": 1, "p2": 1}


def test_new_only(spark):
    c = spark.createDataFrame([("r", "1"), ("r", "2")], "repo_url string, commit_hash string")
    p = spark.createDataFrame([("r", "1")], "repo_url string, commit_hash string")
    assert [r.commit_hash for r in incremental.new_only(c, p, ["repo_url", "commit_hash"]).collect()] == ["2"]


def test_entry_contract(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.columns == ["cve_id", "cve_function_path", "project_function_path", "similarity"]
    assert df.count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", ["cve_links", "cve_commit_diffs", "old_versions", "functional_rule_scorer",
                                 "functions_c", "functions_python", "functions_ruby", "corpus_embeddings",
                                 "clone_pairs", "vulnerable_fragments", "known_vulnerabilities", "span_slices"])
def test_oracle_small(spark, duck, key):
    import __spark_entry__ as e
    from check_oracle import digest
    sdf = e.queries()[key](spark, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    r = duck.execute(e.oracle_sql()[key])
    dcols = [d[0] for d in r.description]
    drows = r.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(sdf.columns, srows)[0] == digest(dcols, drows)[0]
