"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes, then confirmed in full.

Each URL is expanded into every (host suffix, path prefix) expression whose number of host labels and path
length occur among the rules, so plain string prefixes of any length are found, and no others are made. An
expression's SHA-256 is cut to four bytes for the equi-join; the full digest then confirms the rule, and the
longest rule wins (of equal lengths the one with the longer host, then block before allow).

Rules: a DataFrame (host, path, verdict). Host: lower case, fitting itself and its subdomains; path: a prefix.

Defined results for the unusual:

* a null URL or one without `://` has an empty host and path; no rule fits an empty host;
* a URL that no rule fits gets the default verdict and a null rule;
* rows that repeat id and URL are all returned; a null id is an id like others;
* rules that repeat host and path count once, block before allow; null or empty hosts make no rule, a null
  path is the empty prefix; an empty table gives an empty result; other columns are ignored.

The rules are broadcast only up to `broadcast_rules` of them (counted first). Beyond that, rules are salted
and both sides shuffled, so that a rule that fits a third of all URLs is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, table

BROADCAST_RULES = 200_000
SALTS = 32


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty for null or without ://."""
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    return F.when(F.locate("://", url) > 0, lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    return F.when(F.locate("://", url) > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.unhex(F.sha2(F.concat(host, F.lit("\x00"), path).cast("binary"), 256))


def _short(digest: Column) -> Column:
    return F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("long")


def prepared_rules(rules: DataFrame) -> DataFrame:
    """(short, digest, rule, rule_verdict, labels, path_length), one row per host and path."""
    rules = rules.select(lower_ascii(F.col("host")).alias("h"), F.coalesce("path", F.lit("")).alias("p"), F.col("verdict").alias("v"))
    rules = rules.filter("h IS NOT NULL AND h <> '' AND v IS NOT NULL").groupBy("h", "p").agg(F.max("v").alias("rule_verdict"))  # block > allow
    rules = rules.select(_digest(F.col("h"), F.col("p")).alias("digest"), F.concat("h", "p").alias("rule"), "rule_verdict", F.length("h").alias("host_length"), F.size(F.split("h", r"\.")).alias("labels"), F.length("p").alias("path_length"))
    return rules.withColumn("short", _short(F.col("digest")))


def expressions(labels: list[int], lengths: list[int]) -> Column:
    """Array of digests of a row's (host suffix, path prefix) expressions at these numbers of labels and path lengths."""
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.filter(F.array(*[F.lit(n) for n in labels]), lambda n: n <= F.size(parts)), lambda n: F.concat_ws(".", F.slice(parts, F.size(parts) - n + 1, n)))
    prefixes = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    return F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: _digest(h, p))))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """(id, url, host, path, rule, verdict) per row of pages."""
    ready = prepared_rules(rules)
    shape = ready.agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("labels")).alias("labels"), F.sort_array(F.collect_set("path_length")).alias("lengths")).first()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    if not shape["n"]:
        return rows.select("id", "url", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    # An empty digest stands for the row itself, so that rows without expressions stay and repeated rows are counted.
    found = F.when(F.col("host") != "", expressions(shape["labels"], shape["lengths"])).otherwise(F.array().cast("array<binary>"))
    keyed = rows.withColumn("digest", F.explode(F.concat(F.array(F.lit(b"").cast("binary")), found)))
    keyed = keyed.withColumn("short", F.coalesce(_short(F.col("digest")), F.lit(-1)))
    side = ready.withColumnRenamed("digest", "rule_digest").select("short", "rule_digest", "rule", "rule_verdict", "host_length")
    keys = ["short"]
    if shape["n"] <= broadcast_rules:
        side = F.broadcast(side)
    else:
        side = side.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
        keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int"))
        keys = ["short", "salt"]
    joined = keyed.join(side, keys, "left")
    confirmed = F.col("digest") == F.col("rule_digest")
    order = F.struct(F.length("rule").alias("length"), "host_length", F.col("rule_verdict").alias("verdict"), "rule")
    best = joined.groupBy("id", "url", "host", "path").agg(F.max(F.when(confirmed, order)).alias("best"), F.sum(F.when(F.length("digest") == 0, 1).otherwise(0)).alias("times"))
    best = best.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return best.select("id", "url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


#: The production list: (host, path, verdict).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    judged = judge_urls(table(spark, sf_dir, "pages"), rules)
    return judged.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


SQL = f"""
WITH rules(h, p, v) AS (VALUES {", ".join(str(r) for r in RULES)}),
u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), t AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.v, 'allow') AS verdict
FROM t LEFT JOIN LATERAL (
  SELECT h || p AS rule, v FROM rules WHERE (t.host = h OR ends_with(t.host, '.' || h)) AND starts_with(t.path, p) ORDER BY length(h || p) DESC LIMIT 1
) best ON true
"""
