"""CVE mining: from feed entries to commit keys joined with their diffs.

All operators are narrow projections/filters/explodes except ``cve_links`` (one
shuffle for the distinct) and ``attach_diffs`` (one join on the commit key).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchtrace.functions.text import WS, empty_to_null

# Fixed values of the reference (patterns and default year range), written in the
# common Java/RE2 dialect: Python's Unicode \d is \p{Nd}, its \s is the class S.
CVE_ID_PATTERN = r"CVE-\p{Nd}{4}-\p{Nd}{4,7}"
COMMIT_LINK_PATTERN = r"https://github\.com/[^" + WS + r")]+/commit/[0-9a-f]{7,40}"
COMMIT_KEY_PATTERN = r"^https://github\.com/([^/]+/[^/]+)/commit/([0-9a-f]+)"
FIRST_YEAR = "2014"
LAST_YEAR = "2014"


def first_cve_id(feed: DataFrame, entry: str = "entry") -> DataFrame:
    """The first CVE id of each entry; entries without one are dropped."""
    return (feed.withColumn("cve_id", F.regexp_extract(F.col(entry), CVE_ID_PATTERN, 0))
                .where(F.col("cve_id") != ""))


def commit_links(entries: DataFrame, entry: str = "entry") -> DataFrame:
    """Every commit link of the entry, one row each (repeats kept, as findall)."""
    return entries.withColumn("link", F.explode(F.regexp_extract_all(F.col(entry), F.lit(COMMIT_LINK_PATTERN), 0)))


def cve_year(cve_id: str = "cve_id"):
    return F.substring(F.col(cve_id), 5, 4)


def year_filter(links: DataFrame, first: str = FIRST_YEAR, last: str = LAST_YEAR) -> DataFrame:
    """Keep ids whose year field lies in [first, last] (string comparison)."""
    y = cve_year()
    return links.where((y >= F.lit(first)) & (y <= F.lit(last)))


def cve_links(links: DataFrame) -> DataFrame:
    """C4: the set of (link, cve_id). Sorting is left to the sink (``orderBy``)."""
    return links.select("link", "cve_id").dropDuplicates(["link", "cve_id"])


def link_counts(links: DataFrame) -> DataFrame:
    """Unique (link, cve_id) pairs and unique links, per CVE year."""
    return (links.select("link", "cve_id").dropDuplicates(["link", "cve_id"])
                 .groupBy(cve_year().alias("year"))
                 .agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("link").alias("n_links")))


def commit_keys(links: DataFrame, link: str = "link") -> DataFrame:
    """C6 + C7: (repo_url, commit_hash) from the link prefix; unparsable links dropped."""
    owner_repo = empty_to_null(F.regexp_extract(F.col(link), COMMIT_KEY_PATTERN, 1))
    return (links.withColumn("repo_url", F.concat(F.lit("https://github.com/"), owner_repo))
                 .withColumn("commit_hash", F.regexp_extract(F.col(link), COMMIT_KEY_PATTERN, 2))
                 .where(F.col("repo_url").isNotNull()))


def repo_tag(repo_url: str = "repo_url", commit_hash: str = "commit_hash"):
    """C8 (fixed): host prefix removed as a prefix, '/' -> '_', then '_<hash>'."""
    return F.concat(F.replace(F.regexp_replace(F.col(repo_url), "^https://", ""), F.lit("/"), F.lit("_")),
                    F.lit("_"), F.col(commit_hash))


def attach_diffs(keys: DataFrame, diffs: DataFrame) -> DataFrame:
    """Inner equi-join of commit keys with the diff table on (repo_url, commit_hash).

    Both sides are keyed by commit; the join shuffles on the key (or broadcasts the
    key side when AQE measures it small). The CVE id stays on the row (Q19 fixed).
    """
    return keys.join(diffs, ["repo_url", "commit_hash"], "inner")
