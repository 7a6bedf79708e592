import os

from pyspark.sql import functions as F

from patchtrace.operators import cve
from patchtrace.sources import feed as feedsrc

SEP = "=" * 39


def test_first_id_links_year_and_keys(spark):
    rows = [
        (0, "Name: CVE-2014-0001\nsee CVE-2015-9999\nhttps://github.com/a/b/commit/abcdef1 "
            "(also https://github.com/a/c/commit/0123456789)"),
        (1, "no id here https://github.com/a/b/commit/abcdef1"),
        (2, "CVE-2013-12345 https://github.com/x/y/tree/commit/abcdef12"),
        (3, "CVE-2014-0002 https://github.com/a/b/commit/abc"),  # hash too short
    ]
    feed = spark.createDataFrame(rows, "entry_no long, entry string")
    first = {r.entry_no: r.cve_id for r in cve.first_cve_id(feed).collect()}
    assert first == {0: "CVE-2014-0001", 2: "CVE-2013-12345", 3: "CVE-2014-0002"}
    links = cve.commit_links(cve.first_cve_id(feed))
    got = sorted((r.entry_no, r.link) for r in links.collect())
    assert got == [(0, "https://github.com/a/b/commit/abcdef1"), (0, "https://github.com/a/c/commit/0123456789"),
                   (2, "https://github.com/x/y/tree/commit/abcdef12")]
    y = cve.year_filter(links)
    assert {r.cve_id for r in y.collect()} == {"CVE-2014-0001"}
    keys = cve.commit_keys(cve.cve_links(links)).collect()
    # the deeper link has no key
    assert sorted((k.repo_url, k.commit_hash) for k in keys) == [
        ("https://github.com/a/b", "abcdef1"), ("https://github.com/a/c", "0123456789")]


def test_repo_tag_is_prefix_strip(spark):
    df = spark.createDataFrame([("https://github.com/php/php", "abc")], "repo_url string, commit_hash string")
    assert df.select(cve.repo_tag().alias("t")).first().t == "github.com_php_php_abc"


def test_feed_file_scan_latin1(spark, tmpdir_path):
    text = ("head\n" + SEP + "\nName: CVE-2014-0001 caf\xe9\n" + SEP + "\nlast").encode("latin-1")
    p = os.path.join(tmpdir_path, "allitems.txt")
    with open(p, "wb") as f:
        f.write(text)
    e = feedsrc.read_cve_feed(spark, p).orderBy("entry_no").collect()
    assert [r.entry for r in e] == ["head\n", "\nName: CVE-2014-0001 caf\xe9\n", "\nlast"]
    assert [r.entry_no for r in e] == [0, 1, 2]


def test_link_file_roundtrip(spark, tmpdir_path):
    links = spark.createDataFrame([("https://github.com/a/b/commit/abcdef1", "CVE-2014-0001")], "link string, cve_id string")
    out = os.path.join(tmpdir_path, "links")
    feedsrc.write_link_file(links, out)
    back = feedsrc.read_link_file(spark, out).collect()
    assert [(r.cve_id, r.link) for r in back] == [("CVE-2014-0001", "https://github.com/a/b/commit/abcdef1")]
    assert open([os.path.join(out, f) for f in os.listdir(out) if f.startswith("part-")][0]).read() == \
        "CVE-2014-0001 https://github.com/a/b/commit/abcdef1\n"


def test_link_counts(spark):
    links = spark.createDataFrame([("l1", "CVE-2014-1"), ("l1", "CVE-2014-1"), ("l2", "CVE-2014-2"), ("l1", "CVE-2015-3")],
                                  "link string, cve_id string")
    got = {r.year: (r.n_pairs, r.n_links) for r in cve.link_counts(links).collect()}
    assert got == {"2014": (2, 2), "2015": (1, 1)}
    _ = F
