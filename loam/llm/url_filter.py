"""URL rules by host-suffix and path-prefix expressions.

Each URL expands into the expressions that the rule set can hold: its host's suffixes of as many
labels as some rule's host has, times its path's prefixes as long as some rule's path is. An
expression meets the rules through an equi-join on the first four bytes of its SHA-256; the full
digest confirms the hit, and of the confirmed rules the longest wins (equally long: the one with
the longer host). A URL without a rule gets the default verdict.

Defined results: a null URL or one without ``://`` has an empty host and path and thus no rule;
repeated rows give repeated results; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Beyond so many rules the rule table is shuffled like the expressions, not broadcast.
BROADCAST_RULES = 100_000


def _rule_table(spark: SparkSession, rules) -> DataFrame:
    ranked = sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[1] + r[2]))
    rows = [(i + 1, v, h + p) for i, (v, h, p) in enumerate(ranked)]
    table = spark.createDataFrame(rows, "rank int, rule_verdict string, rule string")
    digest = F.sha2("rule", 256)
    return table.select(F.substring(digest, 1, 8).alias("short"), digest.alias("digest"), "rank", "rule", "rule_verdict")


def filter_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict."""
    spark = pages.sparkSession
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    parts = pages.select(F.col(id_col).alias("page_id"), after.alias("rest")).select(
        F.monotonically_increasing_id().alias("row"),
        "page_id",
        F.translate(F.regexp_extract("rest", r"^[^/?#]*", 0), UPPER, LOWER).alias("host"),
        F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"),
    )
    labels = sorted({h.count(".") + 1 for _, h, _ in rules})
    lengths = sorted({len(p) for _, _, p in rules})
    names = F.split("host", r"\.")
    suffixes = F.filter(
        F.array(*[F.when(F.size(names) >= n, F.substring_index("host", ".", -n)) for n in labels] or [F.lit(None).cast("string")]),
        lambda x: x.isNotNull(),
    )
    prefixes = F.filter(
        F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths] or [F.lit(None).cast("string")]),
        lambda x: x.isNotNull(),
    )
    pairs = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    digests = parts.select("*", F.explode_outer(pairs).alias("expression")).withColumn("full", F.sha2("expression", 256))
    table = _rule_table(spark, rules)
    hits = table.select("short", "digest", "rank")
    hits = F.broadcast(hits) if len(rules) <= BROADCAST_RULES else hits
    found = (
        digests.withColumn("short", F.substring("full", 1, 8))
        .join(hits, "short", "left")
        .withColumn("rank", F.when(F.col("full") == F.col("digest"), F.col("rank")))
        .groupBy("row", "page_id", "host", "path")
        .agg(F.max("rank").alias("rank"))
    )
    named = table.select("rank", "rule", "rule_verdict")
    named = F.broadcast(named) if len(rules) <= BROADCAST_RULES else named
    return found.join(named, "rank", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.lit(default)).alias("verdict")
    )


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP7_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
u AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         row_number() OVER () AS r
  FROM p),
rules(rv, rh, rp) AS (VALUES ('allow','com','/'), ('block','example.com','/en/'),
  ('allow','www.example.com','/en/'), ('block','net','/es/'), ('block','net','/fr/')),
m AS (
  SELECT r, first(rh || rp ORDER BY length(rh || rp) DESC, length(rh) DESC) AS rule,
         first(rv ORDER BY length(rh || rp) DESC, length(rh) DESC) AS rv
  FROM u JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  GROUP BY r)
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM u LEFT JOIN m USING (r)
"""
