"""Approximate nearest neighbours by adaptive dimension scan over the lists of an inverted file.

The measure is the inner product. One more dimension, sqrt(M^2 - |x|^2) with M the largest norm (0 for queries),
turns it into Euclidean distance, which a seeded random rotation leaves as it is. After the rotation, the
distance over the first d of D dimensions, times D / d, estimates the whole; a candidate is abandoned as soon as
that exceeds a bound on the k-th distance by the factor (1 + eps / sqrt(d))^2, a hypothesis test whose level eps
sets. Rotated candidates lie in column blocks (dimension-major), and each block is one matrix operation over what is
still alive. Survivors are scored exactly, in double precision, on the original vectors.

The bound starts as the k-th distance among the sample below and tightens as the search goes on: from tile to tile
of a list to the k-th distance found so far, and after each query's nearest lists, which are searched first, to the
k-th distance found in them, with which its other lists are searched. So what survives a list is a small multiple of k,
however long the list.

Lists: centroids are fitted on at most SAMPLE vectors (the least hashed ids); every vector is indexed in the
list of its nearest centroid. The number of lists grows with the root of the number of vectors, and a query
probes as many of the nearest lists as reach the wanted recall between vectors of the sample, more if these hold
too few vectors: few lists where vectors form clusters, most of them where they point everywhere. Lists are cut into chunks of about
CHUNK vectors by a hash of the id, and so are the queries of a list, so a list that holds a third of all vectors
is many tasks of bounded size.

Defined results for the unusual: vectors that are null, empty, zero, or hold a null, NaN or infinite component
take no part, nor do those of another dimension than the most common one (of equally common ones the smallest),
nor rows with a null id; an id that several rows carry stands for all their vectors, the best of which counts; a
query's own id is no candidate; ties go to the smaller id; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, table, written

SAMPLE = 16_384
MAX_LISTS = 4_096
CHUNK = 4_096
QUERY_CHUNK = 1_024
BLOCK = 16
#: Candidates and queries whose partial distances are held at a time, and the share of pairs alive from which on
#: only those are gone on with.
TILE, Q_TILE, SPARSE = 2_048, 256, 0.1
EPS = 2.1
#: Slack of limits, as distances are in single precision.
SLACK, TINY = np.float32(1.0001), np.float32(1e-5)
SEED = 7
RESULT = "query_id long, rank int, vec_id long, score double"


def usable(vector: Column) -> Column:
    """Not null or empty, all components finite, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same for a dimension and seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def augmented(vectors: np.ndarray, top: float) -> np.ndarray:
    """Vectors with the dimension that turns inner products into distances."""
    rest = np.sqrt(np.maximum(top * top - np.einsum("ij,ij->i", vectors, vectors), 0))
    return np.hstack([vectors, rest[:, None]])


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = SEED) -> np.ndarray:
    """Lloyd's algorithm from distinct random vectors; an empty list moves to the vector farthest from its centroid."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.permutation(len(sample))[:lists]].copy()
    for _ in range(rounds):
        near, far = _nearest(sample, centres)
        for c in range(len(centres)):
            own = near == c
            if own.any():
                centres[c] = sample[own].mean(axis=0)
            else:
                centres[c] = sample[far.argmax()]
                far[far.argmax()] = 0
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    near, far = np.empty(len(x), np.int64), np.empty(len(x))
    for at in range(0, len(x), 4096):
        d = ((x[at : at + 4096] ** 2).sum(1)[:, None] + (centres**2).sum(1)[None]) - 2 * x[at : at + 4096] @ centres.T
        near[at : at + 4096] = d.argmin(1)
        far[at : at + 4096] = d.min(1)
    return near, far


def tightened(limits: np.ndarray, held: tuple[np.ndarray, np.ndarray], query: np.ndarray, squares: np.ndarray, k: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """(limits, held) after more (query, squared distance) pairs: held has each query's k least, the k-th is a limit."""
    query, squares = np.concatenate([held[0], query]), np.concatenate([held[1], squares])
    order = np.lexsort((squares, query))
    query, squares = query[order], squares[order]
    rank = np.arange(len(query)) - np.searchsorted(query, query, side="left")
    limits = limits.copy()
    last = rank == k - 1
    limits[query[last]] = np.minimum(limits[query[last]], squares[last] * SLACK + TINY)
    return limits, (query[rank < k], squares[rank < k])


def adaptive_scan(queries: np.ndarray, limits: np.ndarray, blocks: list[np.ndarray], eps: float = EPS, k: int | None = None, own: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) positions of pairs whose squared distance is within the query's limit.

    queries: (n, D), rotated; blocks: candidates as column blocks (d, m). Partial distances of a tile of queries and
    candidates grow block by block; after each, pairs that fail the test are abandoned. As long as most are alive the
    tile goes on as a whole, later only what is alive. With k, limits tighten from tile to tile to the k-th distance
    found, not counting pairs of equal ids, given as own (of queries, of candidates).
    """
    dim, m = sum(len(b) for b in blocks), blocks[0].shape[1]
    cuts = np.cumsum([len(b) for b in blocks])[:-1]
    squares = [np.einsum("ij,ij->j", b, b) for b in blocks]
    found_q, found_c = [], []
    for q0 in range(0, len(queries), Q_TILE):
        parts = np.split(queries[q0 : q0 + Q_TILE], cuts, axis=1)
        limit = limits[q0 : q0 + Q_TILE]
        held = (np.zeros(0, np.int64), np.zeros(0, np.float32))
        for c0 in range(0, m, TILE):
            sums = np.zeros((len(limit), min(TILE, m - c0)), np.float32)
            at = None
            done = 0
            for block, square, part in zip(blocks, squares, parts):
                if at is None:
                    sums += np.einsum("ij,ij->i", part, part)[:, None] + square[None, c0 : c0 + TILE] - 2 * (part @ block[:, c0 : c0 + TILE])
                else:
                    gap = block[:, c0 + at[1]] - part[at[0]].T
                    sums += np.einsum("ij,ij->j", gap, gap)
                done += len(part[0])
                bound = limit * (done / dim) * (1 + (eps / done**0.5 if done < dim else 0)) ** 2
                if at is None:
                    ok = sums <= bound[:, None]
                    if done == dim or ok.mean() < SPARSE:
                        at = np.nonzero(ok)
                        sums = sums[at]
                else:
                    ok = sums <= bound[at[0]]
                    at, sums = (at[0][ok], at[1][ok]), sums[ok]
                if at is not None and not len(at[0]):
                    break
            if k is not None and len(at[0]):
                other = slice(None) if own is None else own[0][q0 + at[0]] != own[1][c0 + at[1]]
                limit, held = tightened(limit, held, at[0][other], sums[other], k)
                ok = sums <= limit[at[0]]
                at = (at[0][ok], at[1][ok])
            found_q.append(q0 + at[0])
            found_c.append(c0 + at[1])
    return np.concatenate(found_q), np.concatenate(found_c)


def best_of(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best (query, id) pairs: largest score, ties to the smaller id, each id once."""
    order = np.lexsort((ids, -scores, query))
    pairs = np.stack([query[order], ids[order]], axis=1)
    order = order[np.sort(np.unique(pairs, axis=0, return_index=True)[1])] if len(order) else order
    starts = np.searchsorted(query[order], query[order], side="left")
    return order[np.arange(len(order)) - starts < k]


def probes_for(vectors: np.ndarray, points: np.ndarray, centres: np.ndarray, turn: np.ndarray, k: int, recall: float, queries: int = 512) -> int:
    """How many nearest lists hold that share of the k nearest among the sample, on average over some of its vectors."""
    q = vectors[:queries]
    scores = q @ vectors.T
    scores[np.arange(len(q)), np.arange(len(q))] = -np.inf
    k = min(k, len(vectors) - 1)
    if k < 1:
        return 1
    best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    turned = np.hstack([q, np.zeros((len(q), 1))]) @ turn
    order = np.argsort((centres**2).sum(1)[None] - 2 * turned @ centres.T, axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(len(centres))[None], axis=1)
    depth = np.take_along_axis(rank, _nearest(points, centres)[0][best], axis=1)
    return int(np.quantile(depth, recall, method="higher")) + 1


def kth_distance(own: np.ndarray, queries: np.ndarray, ids: np.ndarray, points: np.ndarray, k: int) -> np.ndarray:
    """Squared distance of each query's k-th nearest point, its own id's left out; infinite where there are fewer."""
    out = np.full(len(queries), np.inf)
    if len(points) <= k:
        return out
    squares = (points**2).sum(1)
    for at in range(0, len(queries), 256):
        part = queries[at : at + 256]
        d = squares[None] + (part**2).sum(1)[:, None] - 2 * part @ points.T
        place = np.searchsorted(ids, own[at : at + 256])
        here = np.flatnonzero((place < len(ids)) & (ids[np.minimum(place, len(ids) - 1)] == own[at : at + 256]))
        d[here, place[here]] = np.inf
        out[at : at + 256] = np.partition(d, k - 1, axis=1)[:, k - 1]
    return out


def _matrix(column) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.float64) for v in column], dtype=np.float64)


def nearest_neighbours(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    recall: float = 0.97,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    eps: float = EPS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row that is_query selects, by inner product."""
    spark = vectors.sparkSession
    rows = vectors.filter(is_query | F.col(id_col).isNotNull()).filter(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("q"))
    shapes = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("top"))
    shape = shapes.orderBy(F.desc("n"), "dim").first()
    if shape is None:
        return spark.createDataFrame([], RESULT)
    dim, top = shape["dim"], shape["top"] ** 0.5
    rows = rows.filter(F.size("v") == dim)
    sample = rows.select("id", "v").orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(SAMPLE).toPandas()
    turn = rotation(dim + 1)
    originals = _matrix(sample["v"])
    points = augmented(originals, top) @ turn
    lists = int(min(MAX_LISTS, max(1, round(shape["n"] ** 0.5 / 2)), len(points)))
    centres = fit_centroids(points, lists)
    probes = probes_for(originals, points, centres, turn, k, recall)
    # One vector per id of the sample: its k-th distance bounds that of the whole.
    anchor_ids, first = np.unique(sample["id"].to_numpy(), return_index=True)
    anchors = points[first].astype(np.float32)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                batch["list"] = _nearest(augmented(_matrix(batch["v"]), top) @ turn, centres)[0]
                yield batch

    indexed = written(rows.mapInPandas(assign, "id long, v array<double>, q boolean, list long"), "lists")
    held = {r["list"]: r["n"] for r in indexed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # MAX_LISTS rows at most
    counts = np.array([held.get(c, 0) for c in range(lists)])

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            m = _matrix(batch["v"])
            q = np.hstack([m, np.zeros((len(m), 1))]) @ turn
            order = np.argsort((centres**2).sum(1)[None] - 2 * q @ centres.T, axis=1, kind="stable")
            # The nearest lists, and more of them until they hold enough vectors to choose from.
            enough = (np.cumsum(counts[order], axis=1) < 4 * k + 1).sum(axis=1) + 1
            take = np.minimum(np.maximum(enough, probes), lists)
            limit = kth_distance(batch["id"].to_numpy(), q.astype(np.float32), anchor_ids, anchors, 2 * k)
            first = np.concatenate([np.arange(t) < e for t, e in zip(take, np.minimum(enough, take))])
            yield pd.DataFrame({"id": np.repeat(batch["id"].to_numpy(), take), "v": [v for v, t in zip(batch["v"], take) for _ in range(t)], "limit": np.repeat(limit, take), "list": np.concatenate([o[:t] for o, t in zip(order, take)]), "first": first})

    probed = written(indexed.filter("q").select("id", "v").mapInPandas(probe, "id long, v array<double>, `limit` double, list long, first boolean"), "probes")

    def scan(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(candidates) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids, c = candidates["id"].to_numpy(), _matrix(candidates["v"])
        asked, q = queries["id"].to_numpy(), _matrix(queries["v"])
        columns = np.ascontiguousarray((augmented(c, top) @ turn).T.astype(np.float32))
        blocks = [columns[at : at + BLOCK] for at in range(0, dim + 1, BLOCK)]
        turned = (np.hstack([q, np.zeros((len(q), 1))]) @ turn).astype(np.float32)
        limits = queries["limit"].to_numpy().astype(np.float32) * SLACK + TINY
        # Vectors that share an id would count twice among the k least.
        tighten = k if len(np.unique(ids)) == len(ids) else None
        at_q, at_c = adaptive_scan(turned, limits, blocks, eps, tighten, (asked, ids))
        other = asked[at_q] != ids[at_c]
        at_q, at_c = at_q[other], at_c[other]
        scores = np.concatenate([(c[at_c[k0 : k0 + 8192]] * q[at_q[k0 : k0 + 8192]]).sum(axis=1) for k0 in range(0, len(at_q), 8192)] or [np.zeros(0)])
        best = best_of(asked[at_q], ids[at_c], scores, k)
        return pd.DataFrame({"query_id": asked[at_q][best], "vec_id": ids[at_c][best], "score": scores[best]})

    def search(probed: DataFrame) -> DataFrame:
        asked = {r["list"]: r["n"] for r in probed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # MAX_LISTS rows at most
        cut = [(int(c), int(-(-held[c] // CHUNK)), int(-(-asked[c] // QUERY_CHUNK))) for c in asked if held.get(c)]
        if not cut:
            return spark.createDataFrame([], RESULT)
        cuts = F.broadcast(spark.createDataFrame(cut, "list long, chunks long, query_chunks long"))
        own_chunk = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        left = indexed.join(cuts, "list").select("list", own_chunk("chunks").alias("chunk"), every("query_chunks").alias("query_chunk"), "id", "v")
        right = probed.join(cuts, "list").select("list", every("chunks").alias("chunk"), own_chunk("query_chunks").alias("query_chunk"), "id", "v", "limit")
        keys = ["list", "chunk", "query_chunk"]
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(scan, "query_id long, vec_id long, score double")
        return ranked(found)

    def ranked(found: DataFrame) -> DataFrame:
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    # The nearest lists first: the k-th distance found there bounds what the others may add.
    near = written(search(probed.filter("first")), "nearest")
    bounds = near.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    reached = F.when(F.col("kth").isNotNull(), norm + top * top - 2 * F.col("kth"))
    rest = probed.filter("NOT first").join(bounds, "id", "left").select("id", "v", F.least("limit", reached).alias("limit"), "list")
    rest = written(rest, "rest")
    result = written(ranked(near.drop("rank").unionByName(search(rest).drop("rank"))), "neighbours")
    discard(near, rest, probed)
    # A bound or a test may leave a query with less than k: such queries, few if any, look at every list without either.
    full = result.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k).select(F.col("query_id").alias("id"))
    short = written(indexed.filter("q").select("id", "v").join(full, "id", "left_anti"), "short")
    if not short.limit(1).count():
        return result
    again = short.withColumn("limit", F.lit(float("inf"))).withColumn("list", F.explode(F.array(*[F.lit(int(c)).cast("long") for c in sorted(held)])))
    return result.join(full.withColumnRenamed("id", "query_id"), "query_id", "left_semi").select("query_id", "rank", "vec_id", "score").unionByName(search(again))


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
