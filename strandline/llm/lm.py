"""LM scoring: every whole document under a gated recurrent language model, and under the unigram base.

Words are counted over all training documents and the counts stay a distributed table; so does their join with
the documents' words. Only the COMMON most frequent words reach the driver and the workers: a fixed number. The
model's own vocabulary is the most frequent of these; any other word is the unknown token, times the word's
smoothed share of all counts outside the vocabulary, so that the model, too, gives every word a probability.

Training: a warm start on the driver, on WARM windows (of the least hashed documents); then every token of every
training document is learned, in shards. Documents (of PIECE tokens or more: their pieces) are dealt to shards by a
hash of id and text, and learned in the order of another, one behind another, the state carried from window to window
along a text as in scoring. A shard has about SHARD tokens; beyond MAX_SHARDS shards they grow instead. The shards'
parameters are averaged by tokens, as a sum of whole numbers, which comes out the same in any order. So shards, their
order and the average depend on the corpus alone: other partitions, retries and lost executors give the same model.

Defined results for the unusual: a null or empty text is one end token; a null id hashes as the empty string
(and so trains); texts of any length are learned and scored whole; repeated rows count and are returned each; without
any training document all counts are 0, the base is that of the formula, and the model stays at its start; an empty
table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_parts, table, text_batches, written
from .gru import END, LN10, UNKNOWN, Adam, Gru, score, train
from .words import text_bytes

COMMON = 150_000
CLASSES, SIZE, HIDDEN, EMBED = 48, 48, 24, 16
WARM, WARM_WINDOW, WARM_EPOCHS = 2_048, 96, 4
WARM_RATE, RATE = 0.02, 0.004
#: Tokens of a shard, how many shards there are at most, and tokens that are learned at a time.
SHARD, MAX_SHARDS, AT_ONCE = 1 << 20, 4_096, 1 << 20
#: Tokens of a document that are learned as one sequence.
PIECE = 1 << 14
#: Bytes of text that are scored side by side: the more, the less often few long texts are left to be read alone.
SLICE = 32 << 20
#: Averaged parameters are whole multiples of 2^-SCALE, below 2^6.
SCALE, LARGEST = 20, 63.0


def words_of(text: str | None) -> list[bytes]:
    return text_bytes(text).lower().split()


def is_held_out(ids: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(ids.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of texts, summed as far as a bounded counter holds."""
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            held.update(words_of(text))
            if len(held) > 400_000:
                yield out()
                held.clear()
    if held:
        yield out()


class Lexicon:
    """The most frequent words (at most COMMON), the corpus's totals, and what follows from them."""

    def __init__(self, words: list[bytes], counts: list[int], ends: int, n_words: int, kinds: int, size: int):
        self.words = words
        self.size = size  # of the model's vocabulary, END and UNKNOWN included
        self.n = n_words + ends
        self.v = kinds + (1 if ends else 0)
        self.ends = ends
        counts_ = np.array(counts, dtype=np.int64)
        self.logs = np.log10(counts_ + 0.5)
        self.norm = float(np.log10(self.n + 0.5 * (self.v + 1)))
        inside = counts_[: size - 2]
        self.model_counts = np.concatenate([[ends, n_words - int(inside.sum())], inside]) if len(inside) else np.array([ends, n_words])
        outside = n_words - int(inside.sum())
        self.outside_norm = float(np.log10(outside + 0.5 * (kinds - len(inside) + 1)))

    def ranks(self, most: int | None = None) -> dict[bytes, int]:
        """Rank of each word, or of the `most` most frequent ones; -1 of any other."""

        class Ranks(dict):
            def __missing__(self, word: bytes) -> int:
                return -1

        return Ranks(zip(self.words[:most], range(len(self.words))))

    def model_ranks(self) -> dict[bytes, int]:
        """Rank of each word that the model knows: few enough to stay in a processor's cache."""
        return self.ranks(max(0, self.size - 2))


def _ranks(words: list[bytes], ranks: dict[bytes, int]) -> np.ndarray:
    # get() with a default makes no Python call per rare word, as __missing__ would.
    return np.fromiter(map(ranks.get, words, repeat(-1)), np.int32, len(words))


def _model_tokens(rank: np.ndarray, size: int) -> np.ndarray:
    """Model tokens of a text's words, and its end."""
    out = np.full(len(rank) + 1, END, np.int32)
    out[:-1] = np.where((rank >= 0) & (rank < size - 2), rank + 2, UNKNOWN)
    return out


def pieces_of(tokens: np.ndarray) -> list[np.ndarray]:
    """A text's tokens in pieces of PIECE, each with the token ahead of it (END ahead of the first)."""
    led = np.concatenate([[END], tokens]).astype(np.int32)
    return [led[at : at + PIECE + 1] for at in range(0, len(tokens), PIECE)]


def warm_window(tokens: np.ndarray, seed: int) -> np.ndarray:
    """One window of a text, by its seed, with the token ahead of it."""
    at = seed % -(-len(tokens) // WARM_WINDOW) * WARM_WINDOW
    return np.concatenate([[END], tokens]).astype(np.int32)[at : at + WARM_WINDOW + 1]


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over texts in column text."""
    return docs.select("text").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def most_frequent(counts: DataFrame, most: int) -> list:
    """Of (word, c), about the `most` most frequent words and never more, most frequent first, ties by word.

    The cut is found in a histogram of counts, 16 steps to a doubling, so that no task has to sort or send more
    than its share of the words above the cut. Of the step at the cut, words are taken by hash, as many as there is room for.
    """
    rated = counts.withColumn("step", F.floor(F.log2("c") * 16).cast("int"))
    part = F.pmod(F.xxhash64("word"), F.lit(4096)).cast("int")
    room, wanted = most, F.lit(True)
    for r in sorted(rated.groupBy("step").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["step"]):
        if r["n"] <= room:
            room -= r["n"]
            continue
        last = -1
        for p in sorted(rated.filter(F.col("step") == r["step"]).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda p: p["part"]):
            if p["n"] > room:
                break
            room, last = room - p["n"], p["part"]
        wanted = (F.col("step") > r["step"]) | ((F.col("step") == r["step"]) & (part <= last))
        break
    return sorted(rated.filter(wanted).select("word", "c").collect(), key=lambda r: (-r["c"], bytes(r["word"])))


def _together(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches put together to `size` bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _dealt(lexicon: Lexicon, shards: int, key: str | None, text: str | None, ranks: dict) -> list[tuple[int, int, int, bytes]]:
    """(shard, order, piece, tokens as 16-bit numbers) of each piece of a text."""
    order = xxhash.xxh3_64_intdigest(text_bytes(text), seed=zlib.crc32((key or "").encode()))
    found = pieces_of(_model_tokens(_ranks(words_of(text), ranks), lexicon.size))
    return [(xxhash.xxh3_64_intdigest(order.to_bytes(8, "little"), seed=k) % shards, _signed(order), k, p.astype(np.uint16).tobytes()) for k, p in enumerate(found)]


def _learned(start: Gru, pieces: Iterator[tuple[int, bytes]]) -> Iterator[tuple[Gru, int]]:
    """(parameters, tokens) of each shard that (shard, tokens) rows, sorted, make up, from the start's parameters."""
    shard, own, adam, tokens, held, size = None, None, None, 0, [], 0

    def learn() -> int:
        return train(own, held, RATE, adam=adam)[1] if held else 0

    for now, raw in pieces:
        if now != shard:
            if shard is not None:
                tokens += learn()
                yield own, tokens
            shard, own, tokens, held, size = now, start.same(), 0, [], 0
            adam = Adam(own, RATE)
        held.append(np.frombuffer(raw, np.uint16).astype(np.int32))
        size += len(held[-1]) - 1
        if size >= AT_ONCE:
            tokens += learn()
            held, size = [], 0
    if shard is not None:
        tokens += learn()
        yield own, tokens


def fit(training: DataFrame, lexicon: Lexicon) -> Gru:
    """The model of training (id, text): a warm start on the driver, then every token, by shards, averaged."""
    spark = training.sparkSession
    shared = spark.sparkContext.broadcast(lexicon)
    keyed = training.select(F.col("id").cast("string").alias("id"), "text")

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        ranks = lex.model_ranks()
        for batch in batches:
            rows = [(zlib.crc32(f"warm|{i}".encode()), warm_window(_model_tokens(_ranks(words_of(t), ranks), lex.size), zlib.crc32(f"window|{i}".encode()))) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([w.astype(np.uint16).tobytes() for _, w in rows], pa.binary())], names=["key", "tokens"])

    # Only documents whose hash is low can be among the WARM least: the rest are not even split into words.
    below = min(1.0, 2.0 * WARM / max(1, lexicon.ends))
    near = keyed.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < F.lit(int(below * 1_000_003) + 1))
    warm = near.mapInArrow(sample, "key long, tokens binary").orderBy("key", "tokens").limit(WARM).collect()
    model = Gru(CLASSES, SIZE, HIDDEN, EMBED).start(np.concatenate([lexicon.model_counts, np.zeros(max(0, lexicon.size - len(lexicon.model_counts)))]))
    if not warm:
        return model
    train(model, [np.frombuffer(r["tokens"], np.uint16).astype(np.int32) for r in warm], WARM_RATE, epochs=WARM_EPOCHS)
    start = spark.sparkContext.broadcast(model)
    shards = min(MAX_SHARDS, -(-lexicon.n // SHARD))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        ranks = lex.model_ranks()
        for batch in batches:
            rows = [r for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in _dealt(lex, shards, i, t, ranks)]
            columns = zip(*rows) if rows else ([], [], [], [])
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["shard", "order", "piece", "tokens"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, tokens = None, 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total), pa.array(np.full(len(total), tokens))], names=["at", "sum", "n"])

        rows = ((s, x) for b in batches for s, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for own, n in _learned(start.value, rows):
            if tokens + n >= 1 << 36:
                yield out()
                total, tokens = None, 0
            share = np.rint(np.clip(own.flat().astype(np.float64), -LARGEST, LARGEST) * 2.0**SCALE).astype(np.int64) * n
            total, tokens = share if total is None else total + share, tokens + n
        if tokens:
            yield out()

    dealt = keyed.mapInArrow(deal, "shard int, order long, piece int, tokens binary")
    dealt = dealt.repartition(min(shards, shuffle_parts(spark)), "shard").sortWithinPartitions("shard", "order", "piece", "tokens")
    sums = dealt.select("shard", "tokens").mapInArrow(learn, "at long, sum long, n long")
    sums = sums.groupBy("at").agg(F.sum(F.col("sum").cast("decimal(38,0)")).cast("double").alias("sum"), F.sum("n").alias("n"))
    mean = sums.select("at", (F.col("sum") / F.col("n") / F.lit(2.0**SCALE)).alias("x")).toPandas()
    return model.same().load(mean.sort_values("at")["x"].to_numpy())


def fit_corpus(training: DataFrame) -> tuple[Lexicon, Gru, DataFrame]:
    """Lexicon, model and the kept table (word, c) of training (id, text), for the caller to unpersist.

    The counts are kept on the executors' disks: a block that is lost is counted again, to the same sums. Written as a
    table they would be a file a task, and on a local file system Hadoop starts processes for each, to set its mode.
    """
    counts = count_words(training).persist(StorageLevel.DISK_ONLY)
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    common = most_frequent(counts, COMMON)
    lexicon = Lexicon([bytes(r["word"]) for r in common], [r["c"] for r in common], training.count(), totals["n"], totals["v"], CLASSES * SIZE)
    return lexicon, fit(training, lexicon), counts


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row."""
    rows = docs.select(F.col(id_col).alias("id"), is_held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    with text_batches(docs.sparkSession):
        lexicon, gru, counts = fit_corpus(rows.filter("NOT held_out").select("id", "text"))
        return score_rows(rows, lexicon, gru, counts)


def score_rows(rows: DataFrame, lexicon: Lexicon, gru: Gru, counts: DataFrame) -> DataFrame:
    """score_documents() of rows (id, held_out, text) with a fitted model."""
    spark, kind = rows.sparkSession, rows.schema["id"].dataType.simpleString()
    model, shared = spark.sparkContext.broadcast(gru), spark.sparkContext.broadcast(lexicon)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, gru = shared.value, model.value
        ranks = lex.ranks()
        end_log = float(np.log10(lex.ends + 0.5))
        context = TaskContext.get()
        key = (context.partitionId() if context else 0) << 33
        inside = lex.size - 2
        # Batches are put together to SLICE bytes: the model reads many documents side by side.
        for batch in _together(batches, SLICE):
            texts, sizes, known, base, outside, unknown, rare_words, rare_times = [], [], [], [], [], [], [], []
            for text in batch.column(2).to_pylist():
                words = words_of(text)
                rank = _ranks(words, ranks)
                found = rank[rank >= 0]
                logs = lex.logs[found]
                rare = Counter(words[k] for k in np.flatnonzero(rank < 0).tolist())
                texts.append(_model_tokens(rank, lex.size))
                sizes.append(len(words) + 1)
                known.append(len(found) + (1 if lex.ends else 0))
                base.append(float(logs.sum()) + end_log)
                outside.append(float(logs[found >= inside].sum()))
                unknown.append(int((texts[-1] == UNKNOWN).sum()))
                rare_words.append(list(rare))
                rare_times.append(list(rare.values()))
            # ln P of the model's tokens, plus the share of each unknown word among those outside the vocabulary.
            total = score(gru, texts) / LN10 + np.array(outside) - np.array(unknown) * lex.outside_norm
            keys = np.arange(key, key + len(texts))
            key += len(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(total, pa.float64()), pa.array(rare_words, pa.list_(pa.binary())), pa.array(rare_times, pa.list_(pa.int64()))],
                names=["key", "id", "held_out", "n_tokens", "known", "base", "total", "words", "times"],
            )

    # Written once: from here on, a row's key is fixed.
    scored = written(rows.mapInArrow(read, f"key long, id {kind}, held_out boolean, n_tokens long, known long, base double, total double, words array<binary>, times array<long>"), "scored")
    rare = scored.select("key", F.explode(F.arrays_zip("words", "times")).alias("x")).select("key", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    c = F.coalesce("c", F.lit(0))
    rare = rare.join(counts.hint("merge"), "word", "left").groupBy("key").agg(F.sum(F.log10(c + 0.5) * F.col("times")).alias("rare"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    rare = written(rare, "rare")
    counts.unpersist()
    joined = scored.drop("words", "times").join(rare, "key", "left")
    more = F.coalesce("rare", F.lit(0.0))
    return joined.select(
        "id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(lexicon.n).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(lexicon.norm)).alias("base_score"),
        (F.col("total") + more).alias("score"),
    )


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
