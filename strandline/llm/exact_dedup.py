"""Exact dedup: a persistent digest index, bucketed and sorted by hash, with sort-merge anti-join and append.

The index is a saved table with one row per distinct normalised text: its SHA-256 digest, the smallest id of the
batch that brought it, and how many rows of that batch carried it. A batch is deduplicated by a sort-merge anti-join:
digests that the index lacks are appended to it; of those it holds, the batch's smallest id and count are appended to a
second table beside it, so that no row of the index is ever rewritten. Both are bucketed and sorted by digest, so
taking a new batch shuffles that batch's digests (40 bytes a row), never the index and never a text. Any number of
batches, in any order, gives what one batch of all their rows gives.

Defined results for the unusual:

* a null text counts as the empty text; texts of only white space normalise to one space;
* of equal texts the row with the smallest id stays; null ids sort last, and where all ids are null, null stays;
* rows that repeat both id and text all refer to the same id; keep_rows() returns such a row once;
* texts of any length are read whole; an empty table gives an empty result, and other columns (whatever their names) are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, shuffle_parts, table, written

#: Each run of white space becomes one space. A lone space already is one, so only other matches are rewritten.
_RUN = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUN, " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest) of each row: the digest is SHA-256 of the normalised text, as 32 bytes."""
    return docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(normalised(F.col(text_col)).cast("binary"), 256)).alias("digest"))


class DigestIndex:
    """A saved table (digest binary, keep_id, n) bucketed and sorted by digest, and one of what later batches repeat."""

    def __init__(self, spark: SparkSession, name: str, buckets: int):
        self.spark, self.name, self.repeats, self.buckets = spark, name, f"{name}_repeats", buckets

    def create(self) -> DigestIndex:
        """Make the tables where there are none yet."""
        for name in (self.name, self.repeats):
            if not self.spark.catalog.tableExists(name):
                self._append(self.spark.createDataFrame([], "digest binary, keep_id long, n long"), name)
        return self

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def _append(self, groups: DataFrame, name: str) -> None:
        writer = groups.select("digest", "keep_id", "n").write.format("parquet").mode("append")
        writer.option("compression", "zstd").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(name)

    def take(self, groups: DataFrame) -> None:
        """Append a batch's groups (a written table, one row per digest): new digests to the index, the others beside it."""
        again = written(self._held(groups), "repeats")
        self._append(self.unseen(groups), self.name)
        self._append(again, self.repeats)
        discard(again)

    def _held(self, groups: DataFrame) -> DataFrame:
        held = self.read().select(F.col("digest").alias("held")).hint("merge")
        return groups.join(held, groups["digest"] == held["held"], "left_semi")

    def unseen(self, groups: DataFrame) -> DataFrame:
        """The groups whose digest the index lacks: a sort-merge anti-join; the index side is not shuffled."""
        # The planner would move a plain anti-join below the aggregation, where a hot digest still has all its
        # rows; a condition on an aggregate keeps it above. It is true of every group.
        seen = self.read().select(F.col("digest").alias("seen")).hint("merge")
        return groups.join(seen, (groups["digest"] == seen["seen"]) & (groups["n"] > 0), "left_anti")

    def shared(self) -> DataFrame:
        """(digest, keep_id, n) of the digests that more than one row carries, over all batches taken."""
        more = self.spark.table(self.repeats).groupBy("digest").agg(F.min("keep_id").alias("low"), F.sum("n").alias("more"))
        both = self.read().join(more.hint("merge"), "digest", "left")
        # least() skips nulls, as the smallest id does.
        return both.select("digest", F.least("keep_id", "low").alias("keep_id"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")).filter("n > 1")

    def drop(self) -> None:
        for name in (self.name, self.repeats):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def groups_of(rows: DataFrame) -> DataFrame:
    """One row per digest of a batch. Partial sums meet a hot digest first, so no task sees all its rows."""
    return rows.groupBy("digest").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))


def add_batch(index: DigestIndex, rows: DataFrame) -> None:
    """Deduplicate a batch of (id, digest) rows against the index and append what it brings."""
    groups = written(groups_of(rows), "groups")
    index.take(groups)
    discard(groups)


def resolve(rows: DataFrame, index: DigestIndex) -> DataFrame:
    """(id, keep_id, group_size, kept, digest) per row that the index has taken, over all batches taken so far.

    Only digests that more than one row carries are joined back. Both sides are plain shuffles, so that
    adaptive execution may split the partition of a hot digest.
    """
    # substring() hides the buckets from the planner: without it the rows would have to follow them, hot ones too.
    shared = index.shared().select(F.substring("digest", 1, 32).alias("digest"), "keep_id", "n")
    joined = rows.join(shared.hint("merge"), "digest", "left")
    alone = F.col("n").isNull()
    return joined.select(
        "id",
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.when(alone, F.lit(True)).otherwise(F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "digest",
    )


#: Batches that exact_dedup() hands to its index, one after another.
BATCHES = 2


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """(id, keep_id, group_size, kept, digest) per row of docs, taken by an index of its own in batches by hash of the id.

    The index is dropped once its answer is written; keep one with DigestIndex, add_batch() and resolve().
    """
    spark = docs.sparkSession
    rows = written(digests(docs, id_col, text_col), "digests")
    index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", shuffle_parts(spark)).create()
    try:
        for k in range(batches):
            add_batch(index, rows.filter(F.pmod(F.xxhash64("id"), F.lit(batches)) == k))
        return written(resolve(rows, index), "resolved")
    finally:
        index.drop()
        discard(rows)


def keep_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns, once each."""
    found = exact_dedup(docs, id_col, text_col)
    ids = written(found.groupBy(F.col("id").alias("__id")).agg(F.count(F.lit(1)).alias("__n"), F.bool_or("kept").alias("__kept")), "kept")
    same = docs[id_col].eqNullSafe(ids["__id"])
    # A merge at any size: what stays of a table grows with it.
    once = docs.join(ids.filter("__kept AND __n = 1").hint("merge"), same, "left_semi")
    if not ids.filter("__kept AND __n > 1").limit(1).count():
        return once
    # Ids that several rows carry are rare: those rows are told apart by their digests.
    again = docs.join(ids.filter("__kept AND __n > 1"), same, "left_semi")
    again = again.withColumn("__digest", F.unhex(F.sha2(normalised(F.col(text_col)).cast("binary"), 256)))
    stay = found.filter("kept").select(F.col("id").alias("__id"), F.col("digest").alias("__stays"))
    again = again.join(stay, again[id_col].eqNullSafe(stay["__id"]) & (again["__digest"] == stay["__stays"]), "left_semi")
    return once.unionByName(again.dropDuplicates(["__digest"]).drop("__digest"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""
