"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

Each source s gets a rate r(s) = share(s) * budget / size(s): how often its documents must appear on average
for the mix to hold the target weights. A document's count is the Poisson quantile, with mean r(s), of a
uniform number hashed from (seed, id). The document is exploded by that count, and the copies are dealt out
over all partitions and sorted by a hash of (seed, id, replica), which is one global random order.

Counts depend on nothing but the row's id, its source's rate and the seed: reruns, other partitionings and
lost executors give the same copies.

Defined results for the unusual:

* a null source is a source of its own, named by `null_name` in the weights;
* a source that the weights lack gets `other_weight`, which the caller has to choose; a source without any size, or
  with weight 0, gets rate 0, and left_out() lists such sources with what they hold;
* a null text has size 0 and may still be replicated; a null id hashes as the empty string;
* rows that repeat an id get equal counts, and each is replicated;
* texts of any length are carried whole; an empty table gives an empty result; other columns are carried along,
  whatever their names, except that columns named as the added ones are replaced.

Sources are joined by broadcast only up to `broadcast_sources` of them (counted first); beyond that by a
shuffle join whose small side is salted, so that a source that holds a third of all rows is spread.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_parts, table, written

BROADCAST_SOURCES = 10_000
SALTS = 64
_TWO52 = float(2**52)


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of SHA-256 over the parts."""
    digest = F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(_TWO52)


def poisson_cdf(rate: Column) -> Column:
    """Cumulative Poisson probabilities at 0, 1, ... far enough that what is left is below 2^-52.

    Rates above 500 are split into equal parts by poisson_count, so exp(-rate) never underflows.
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf"))
    step = lambda s, k: F.struct(
        (s["p"] * rate / k).alias("p"),
        F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + s["p"] * rate / k)).alias("cdf"),
    )
    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["cdf"])


#: A rate is drawn as a sum of this many independent Poisson counts at most 500 each.
def _pieces(rate: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(rate / 500)).cast("int")


def source_rates(docs: DataFrame, weights: dict[str, float], budget: float | None, source_col: str, size: Column, other_weight: float, null_name: str) -> DataFrame:
    """(source, size, weight, rate, pieces, cdf) per source that occurs; budget None keeps the corpus's total size."""
    total = docs.select(F.coalesce(F.col(source_col), F.lit(null_name)).alias("source"), size.alias("size")).groupBy("source").agg(F.sum("size").alias("size"))
    pairs = [x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w)))]
    weight = F.coalesce(F.create_map(*pairs)[F.col("source")], F.lit(float(other_weight))) if pairs else F.lit(float(other_weight))
    total = written(total.withColumn("weight", F.when(F.col("size") > 0, weight).otherwise(F.lit(0.0))), "sources")
    sums = total.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    aim = float(budget) if budget is not None else float(sums["size"])
    rate = F.when(F.col("weight") > 0, F.col("weight") / F.lit(sums["weight"] or 1.0) * F.lit(aim) / F.col("size")).otherwise(F.lit(0.0))
    rated = total.select("source", "size", "weight", rate.alias("rate"))
    return rated.withColumn("pieces", _pieces(F.col("rate"))).withColumn("cdf", poisson_cdf(F.col("rate") / F.col("pieces")))


def left_out(docs: DataFrame, weights: dict[str, float], *, other_weight: float, source_col: str = "source", size: Column | None = None, null_name: str = "") -> DataFrame:
    """(source, documents, size) of the sources that mix_sources() gives rate 0: what a mix with these weights loses."""
    size = F.coalesce(F.length("text"), F.lit(0)).cast("long") if size is None else size
    rates = source_rates(docs, weights, None, source_col, size, other_weight, null_name).filter("rate = 0").select("source", "size")
    held = docs.groupBy(F.coalesce(F.col(source_col), F.lit(null_name)).alias("source")).agg(F.count(F.lit(1)).alias("documents"))
    return held.join(rates, "source").select("source", "documents", "size")


#: Columns that a mix adds.
ADDED = ("replica", "mix_rate", "shuffle_key")


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float],
    seed: int = 0,
    budget: float | None = None,
    *,
    other_weight: float,
    id_col: str = "doc_id",
    source_col: str = "source",
    size: Column | None = None,
    null_name: str = "",
    broadcast_sources: int = BROADCAST_SOURCES,
) -> DataFrame:
    """docs with columns replica (from 0), mix_rate, shuffle_key; one row per copy, dealt out in a global random order."""
    spark = docs.sparkSession
    size = F.coalesce(F.length("text"), F.lit(0)).cast("long") if size is None else size
    rates = source_rates(docs, weights, budget, source_col, size, other_weight, null_name).select("source", F.col("rate").alias("mix_rate"), "pieces", "cdf")
    carried = [c for c in docs.columns if c not in ADDED]
    # The caller's columns travel as doc_0, doc_1, ..., so that none clashes with those of the mix.
    rows = docs.select(*[F.col(f"`{c}`").alias(f"doc_{k}") for k, c in enumerate(carried)])
    own = {c: f"doc_{k}" for k, c in enumerate(carried)}
    ids = F.col(own[id_col])
    rows = rows.withColumn("source", F.coalesce(F.col(own[source_col]), F.lit(null_name)))
    few = rates.limit(broadcast_sources + 1).count() <= broadcast_sources
    if few:
        rows = rows.join(F.broadcast(rates), "source")
    else:
        salt = F.pmod(F.xxhash64(ids), F.lit(SALTS)).cast("int")
        salted = rates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", salt).join(salted.hint("merge"), ["source", "salt"])
    below = lambda piece: F.size(F.filter("cdf", lambda c: c <= unit_hash(F.lit(seed), ids, piece)))
    # One uniform number per piece of the rate; nearly always there is one piece.
    count = F.when(F.col("pieces") == 1, F.size(F.filter("cdf", lambda c: c <= F.col("unit")))).otherwise(
        F.aggregate(F.sequence(F.lit(1), F.col("pieces")), F.lit(0), lambda n, k: n + below(k))
    )
    rows = rows.withColumn("unit", unit_hash(F.lit(seed), ids, F.lit(1))).withColumn("copies", count)
    rows = rows.filter("copies > 0").withColumn("replica", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    rows = rows.withColumn("shuffle_key", F.xxhash64(F.lit(seed), ids, F.col("replica"))).select(*own.values(), *ADDED)
    rows = rows.repartition(shuffle_parts(spark), "shuffle_key").sortWithinPartitions("shuffle_key")
    return rows.select(*[F.col(own[c]).alias(c) for c in carried], *ADDED)


#: Production weights: source number i of the corpus is wanted in proportion to 1 + i mod 5.
def production_weights(n_sources: int = 20) -> dict[str, float]:
    return {f"src{i}": 1.0 + i % 5 for i in range(n_sources)}


SEED = 17
#: Production weight of every source that is not in the list, of a null one too, so that no document's source is lost.
OTHER_WEIGHT = 1.0


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"), production_weights(), SEED, other_weight=OTHER_WEIGHT)
    return mixed.select("doc_id", "source", "replica", F.round("mix_rate", 9).alias("mix_rate"), "n_chars", "text")


def _sql() -> str:
    values = ", ".join(f"('{k}', {w})" for k, w in production_weights().items())
    last = 60 + 12 * math.ceil(math.sqrt(60))
    return f"""
WITH RECURSIVE w(source, weight) AS (VALUES {values}),
s AS (SELECT coalesce(source, '') AS source, sum(coalesce(length(text), 0)) AS size FROM documents GROUP BY 1),
t AS (SELECT s.source, s.size, CASE WHEN s.size > 0 THEN coalesce(w.weight, {OTHER_WEIGHT}) ELSE 0 END::DOUBLE AS weight FROM s LEFT JOIN w USING (source)),
r AS (SELECT source, CASE WHEN weight > 0 THEN weight / (SELECT sum(weight) FROM t) * (SELECT sum(size) FROM t)::DOUBLE / size ELSE 0 END::DOUBLE AS rate FROM t),
c(source, rate, k, p, cdf) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM r
  UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM c WHERE k < {last}
),
u AS (SELECT doc_id, coalesce(source, '') AS s, source, n_chars, text, ('0x' || substr(sha256('{SEED}|' || coalesce(doc_id::VARCHAR, '') || '|1'), 1, 13))::BIGINT / {_TWO52:.1f} AS u FROM documents),
n AS (SELECT u.doc_id, u.s, u.u, count(*) FILTER (WHERE c.cdf <= u.u) AS n, any_value(c.rate) AS rate FROM (SELECT DISTINCT doc_id, s, u FROM u) u JOIN c ON c.source = u.s GROUP BY 1, 2, 3)
SELECT u.doc_id, u.source, x.replica::INTEGER AS replica, round(n.rate, 9) AS mix_rate, u.n_chars, u.text
FROM u JOIN n ON u.doc_id IS NOT DISTINCT FROM n.doc_id AND u.s = n.s, LATERAL (SELECT unnest(range(n.n)) AS replica) x
"""


SQL = _sql()
