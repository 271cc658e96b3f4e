"""Substring dedup: documents are factored greedily, relative to an index of reference stretches of the corpus.

A window is WINDOW consecutive words. A document is parsed from left to right into factors, each the longest
stretch from that point all of whose windows occur in one reference document's indexed blocks; at a factor's
end the parse goes on WINDOW - 1 words earlier, so every window across a factor boundary is looked up as well.
Factors of at least WINDOW words are the duplicate spans, and no repeated window is missed.

The index is distributed. Parsing every document against every block would cost their product; here a block is
addressed by content, so a document meets just the blocks that can hold one of its windows:

1. a window's *anchor* is the least hash among its GRAM-word grams. Equal windows have equal anchors; an anchor
   that occurs once in the corpus (nearly all do) rules out all of its windows;
2. consecutive windows of one anchor are a *stretch*. Equal stretches fold to one reference stretch (of the
   smallest document id). Where all stretches of an anchor are equal, they are repeated as a whole;
3. only where stretches of one anchor differ (at the ends of a repeated passage) are the windows of each
   reference stretch indexed one by one and counted, with the number of stretches behind it.

All groupings are sums or minima, with partial aggregation, so a passage that a third of all documents share
meets no task as a whole; joins have plain shuffles on both sides, which adaptive execution may split.
Windows are judged on the input. Grams, stretches and windows are identified by 64-bit hashes, the latter two
together with their anchor's: 128 bits.

Defined results for the unusual: null, empty and white-space texts have no words, and the SHA-256 of the empty
string; texts of fewer than WINDOW words lose nothing; rows that repeat id and text are documents of their own,
each of which repeats the other; rows are told apart by id and text, and null ids are ids like others; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_batches, written
from .words import WordHashes, rolling, text_bytes

WINDOW = 35
GRAM = 12
#: Rows of one Arrow batch that Python hands back at a time.
PART = 400


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each run of `width` values, in log2(width) steps."""
    n = len(x) - width + 1
    power, have = x, 1
    while have * 2 <= width:
        power = pick(power[: len(power) - have], power[have:])
        have *= 2
    return pick(power[:n], power[width - have : width - have + n])


def anchors(words: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(anchor of each window, all grams' hashes); both empty without windows."""
    if len(words) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    grams = rolling(words, gram)
    return _sliding(grams, window - gram + 1, np.minimum), grams


def anchor_counts(words: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchors of a document, and at how many places each gram stands that is some window's anchor."""
    low, grams = anchors(words, window, gram)
    if not len(low):
        return low, np.zeros(0, np.int64)
    width = window - gram + 1
    pad = np.zeros(width - 1, np.uint64)
    chosen = grams[_sliding(np.concatenate([pad, low, pad]), width, np.maximum) == grams]
    return np.unique(chosen, return_counts=True)


def _list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)])
    values = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.astype(kind.to_pandas_dtype()), kind))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, mark, text) to (id, mark, n_words, whole, anchors, times)."""
    hashes = WordHashes()
    for batch in batches:
        for at in range(0, batch.num_rows, PART):
            part = batch.slice(at, PART)
            sizes, digests, keys, times = [], [], [], []
            for text in part.column(2):
                words = text_bytes(text.as_py()).split()
                sizes.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                if len(words) < WINDOW:
                    k, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
                else:
                    k, n = anchor_counts(hashes.of(words))
                keys.append(k.view(np.int64))
                times.append(np.minimum(n, 2))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(digests), _list_array(keys, pa.int64()), _list_array(times, pa.int32())],
                names=["id", "mark", "n_words", "whole", "anchors", "times"],
            )


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, mark, text, anchors that repeat) to (id, mark, anchor, stretch, start, windows): one row per stretch."""
    hashes = WordHashes()
    for batch in batches:
        for at in range(0, batch.num_rows, PART):
            part = batch.slice(at, PART)
            rows, starts, keys, marks, runs = [], [], [], [], []
            for k in range(part.num_rows):
                words = hashes.of(text_bytes(part.column(2)[k].as_py()).split())
                low, _ = anchors(words)
                wanted = np.asarray(part.column(3)[k].values, dtype=np.int64).view(np.uint64)
                cut = np.flatnonzero(np.diff(low)) + 1
                first = np.concatenate([[0], cut])
                last = np.concatenate([cut, [len(low)]])
                ok = np.isin(low[first], wanted)
                found = rolling(words, WINDOW).view(np.int64)
                for i, j in zip(first[ok].tolist(), last[ok].tolist()):
                    run = found[i:j]
                    rows.append(k)
                    starts.append(i)
                    runs.append(run)
                    marks.append(xxhash.xxh3_64_intdigest(run.tobytes()))
                keys.append(low[first[ok]])
            if rows:
                take = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(take),
                        part.column(1).take(take),
                        pa.array(np.concatenate(keys).view(np.int64)),
                        pa.array(np.array(marks, dtype=np.uint64).view(np.int64)),
                        pa.array(starts, pa.int32()),
                        _list_array(runs, pa.int64()),
                    ],
                    names=["id", "mark", "anchor", "stretch", "start", "windows"],
                )


def parse(refs: dict[int, object]) -> list[tuple[int, int, object]]:
    """Greedy factors (first word, words, reference id) of a document whose window i occurs in document refs[i]."""
    out: list[tuple[int, int, object]] = []
    order = sorted(refs)
    at = 0
    while at < len(order):
        first, end = order[at], at + 1
        while end < len(order) and order[end] == order[end - 1] + 1 and refs[order[end]] == refs[first]:
            end += 1
        out.append((first, order[end - 1] - first + WINDOW, refs[first]))
        at = end
    return out


def _key_join(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Join on (id, mark), nulls equal; b's keys go."""
    b = b.withColumnRenamed("id", "__id").withColumnRenamed("mark", "__mark")
    return a.join(b, a["id"].eqNullSafe(b["__id"]) & (a["mark"] == b["__mark"]), how).drop("__id", "__mark")


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, scanned, found): the keyed texts, the scan of each, and per document with repeats its stretches.

    found: (id, mark, parts array<struct<start, n, at, refs>>): windows start .. start+n-1 repeat as a whole and occur in
    refs[0] if at is null, else the windows start+at[k] do, in refs[k].
    """
    with text_batches(docs.sparkSession):
        return _repeated_windows(docs, id_col, text_col)


def _repeated_windows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("mark"), F.col(text_col).alias("text"))
    scanned = written(texts.mapInArrow(_scan, f"id {kind}, mark long, n_words long, whole string, anchors array<long>, times array<int>"), "scan")
    places = scanned.select("id", "mark", F.explode(F.arrays_zip("anchors", "times")).alias("x")).select("id", "mark", F.col("x.anchors").alias("anchor"), F.col("x.times").alias("times"))
    repeated = places.groupBy("anchor").agg(F.sum("times").alias("times")).filter("times > 1").select("anchor")
    wanted = places.join(repeated, "anchor").groupBy("id", "mark").agg(F.collect_set("anchor").alias("wanted"))
    runs = _key_join(texts, wanted).select("id", "mark", "text", "wanted").mapInArrow(_stretches, f"id {kind}, mark long, anchor long, stretch long, start int, windows array<long>")
    runs = written(runs, "stretches")
    # Reference stretches: one per distinct stretch of an anchor.
    classes = runs.groupBy("anchor", "stretch").agg(F.count(F.lit(1)).alias("times"), F.min("id").alias("ref"))
    kinds = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    classes = classes.join(kinds, "anchor", "left").withColumn("by_window", F.col("kinds").isNotNull() | (F.col("times") == 1))
    classes = written(classes.select("anchor", "stretch", "times", "ref", "by_window"), "classes")
    whole = classes.filter("NOT by_window").select("anchor", "stretch", F.lit(None).cast("array<int>").alias("at"), F.array("ref").alias("refs"))
    one = classes.filter("by_window").select(F.col("anchor").alias("a"), F.col("stretch").alias("s"), "times", "ref")
    reference = runs.join(one, (F.col("anchor") == F.col("a")) & (F.col("stretch") == F.col("s")) & F.col("id").eqNullSafe(F.col("ref")))
    reference = reference.groupBy("anchor", "stretch").agg(F.first("windows").alias("windows"), F.first("times").alias("times"), F.first("ref").alias("ref"))
    index = reference.select("anchor", "stretch", "ref", F.least("times", F.lit(2)).alias("times"), F.posexplode("windows").alias("at", "window"))
    index = written(index, "windows")
    # Written, so that the join below has plain shuffles on both sides and a hot window can be split.
    hits = written(index.groupBy("anchor", "window").agg(F.sum("times").alias("times"), F.min("ref").alias("first")).filter("times > 1").select("anchor", "window", "first"), "hits")
    partly = index.drop("times", "ref").join(hits, ["anchor", "window"]).groupBy("anchor", "stretch").agg(F.sort_array(F.collect_list(F.struct("at", "first"))).alias("x"))
    partly = partly.select("anchor", "stretch", F.col("x.at").alias("at"), F.col("x.first").alias("refs"))
    parts = runs.select("id", "mark", "anchor", "stretch", "start", F.size("windows").alias("n")).join(whole.unionByName(partly), ["anchor", "stretch"])
    found = parts.groupBy("id", "mark").agg(F.collect_set(F.struct("start", "n", "at", "refs")).alias("parts"))
    return texts, scanned, found


def _refs(parts: list[dict]) -> dict[int, object]:
    refs: dict[int, object] = {}
    for p in parts:
        if p["at"] is None:
            refs.update((p["start"] + k, p["refs"][0]) for k in range(p["n"]))
        else:
            refs.update((p["start"] + k, r) for k, r in zip(p["at"], p["refs"]))
    return refs


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, mark, text, parts) to (id, n_words, n_removed, spans, kept)."""
    for batch in batches:
        kind = batch.schema.field(0).type
        span = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("ref", kind)]))
        for at in range(0, batch.num_rows, PART):
            part = batch.slice(at, PART)
            sizes, removed, spans, kept = [], [], [], []
            for text, parts in zip(part.column(2), part.column(3)):
                words = text_bytes(text.as_py()).split()
                factors = parse(_refs(parts.as_py()))
                gone = np.zeros(len(words), dtype=bool)
                for start, n, _ in factors:
                    gone[start : start + n] = True
                sizes.append(len(words))
                removed.append(int(gone.sum()))
                spans.append([{"start": s, "words": n, "ref": r} for s, n, r in factors])
                kept.append(b" ".join([w for w, x in zip(words, gone.tolist()) if not x]).decode("utf-8", "replace"))
            columns = [part.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "n_removed", "spans", "kept"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, spans, kept, whole) per row.

    spans: array<struct<start, words, ref>>, the duplicate factors in order (neighbours overlap by less than a
    window); kept: the remaining words, joined by one space. Where nothing repeats, spans and kept are null and
    whole has the SHA-256 of all words joined by one space; else whole is null.
    """
    texts, scanned, found = repeated_windows(docs, id_col, text_col)
    found = written(found, "found")
    kind = docs.schema[id_col].dataType.simpleString()
    span = f"array<struct<start:long,words:long,ref:{kind}>>"
    cut = _key_join(texts, found).select("id", "mark", "text", "parts")
    cut = cut.mapInArrow(_cut, f"id {kind}, n_words long, n_removed long, spans {span}, kept string").withColumn("whole", F.lit(None).cast("string"))
    rest = _key_join(scanned.select("id", "mark", "n_words", "whole"), found.select("id", "mark"), "left_anti")
    rest = rest.select("id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.lit(None).cast(span).alias("spans"), F.lit(None).cast("string").alias("kept"), "whole")
    return cut.unionByName(rest)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.coalesce("whole", F.sha2(F.col("kept").cast("binary"), 256)).alias("kept_sha256"))


SQL = r"""
WITH w AS (
  SELECT doc_id, CASE WHEN len(a) = 1 AND a[1] = '' THEN [] ELSE a END AS a
  FROM (SELECT doc_id, string_split(trim(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), ' ') AS a FROM documents)
), g AS (
  SELECT doc_id, i, sha256(array_to_string(a[i : i + 34], ' ')) AS h FROM w, LATERAL (SELECT unnest(range(1, len(a) - 33)) AS i) WHERE len(a) >= 35
), r AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, unnest(range(i, i + 35)) AS k FROM g SEMI JOIN r USING (h))),
t AS (SELECT doc_id, i AS k, a[i] AS word FROM w, LATERAL (SELECT unnest(range(1, len(a) + 1)) AS i)),
k AS (SELECT t.doc_id, count(*) AS n, string_agg(t.word, ' ' ORDER BY t.k) AS kept FROM t ANTI JOIN c USING (doc_id, k) GROUP BY 1)
SELECT w.doc_id, len(w.a)::BIGINT AS n_words, (len(w.a) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""
