"""MinHash near-dedup by fast similarity sketching, banding, and exact verification.

Sketch (Dahlgaard, Knudsen and Thorup): in round i each shingle is thrown into one of T bins with a value in
[i, i+1); a bin keeps its least value; rounds T to 2T-1 send every shingle to one fixed bin each, so that every
coordinate is filled whatever the set's size. The rounds stop once all bins are filled, as later values cannot
be less. Two sketches agree in a coordinate with probability equal to the Jaccard similarity, and the share of
agreeing coordinates is concentrated around it.

Banding: T = 128 coordinates make 32 bands of 4. A pair of similarity 0.75 shares no band with probability
(1 - 0.75^4)^32 = 5e-6.

What keeps large groups linear:

1. documents with equal shingle sets are folded to one representative before banding;
2. within a bucket each member is paired with the bucket's centre only (the smallest id in even bands, the
   smallest hashed id in odd ones), and pairs are verified on the full shingle sets;
3. buckets that still hold several components are searched in hashed blocks of bounded size, in memory: pairs
   across components whose sketches agree enough are verified there and then, and only links come out (below:
   exhaust()). So no link that shares a band is lost, and no group's pairs are emitted.

Components are found by hooking to the smallest neighbour and pointer jumping, in DataFrames; nothing about
documents reaches the driver but counts.

Defined results for the unusual:

* null, empty and white-space texts have an empty set, link with nothing and are their own component;
* fewer than five words: the whole sequence is one shingle;
* rows that repeat an id are one node of the graph, and each row is returned; rows with a null id link with
  nothing and have a null component;
* an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, table, text_batches, written
from .words import WordHashes, in_chunks, mixed, rolling, text_bytes

SHINGLE = 5
COORDS = 128
ROWS = 4
BANDS = COORDS // ROWS
#: Least number of agreeing coordinates for a pair inside a block: 5.3 standard deviations under 0.75 * 128.
AGREE = 70
#: Shingles of a bucket's members in one block; one task compares two blocks at a time.
BLOCK = 500_000
#: Members of a centre that one task verifies.
CHUNK = 256
_STEP = 0xD1B54A32D192ED03
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_set(text: str | None, hashes: WordHashes, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = text_bytes(text).lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < width:
        # The length goes in, so that a short sequence never equals a shingle of full width.
        whole = b" ".join(words)
        return np.array([xxhash.xxh3_64_intdigest(whole, seed=len(words))], dtype=np.uint64)
    return np.unique(rolling(hashes.of(words), width))


def fast_sketches(sets: list[np.ndarray], coords: int = COORDS) -> np.ndarray:
    """Sketch of each set (none may be empty): an array (sets, coords) of uint64, round in the top byte."""
    n = len(sets)
    sketch = np.full(n * coords, _NONE, dtype=np.uint64)
    items = np.concatenate(sets)
    owner = np.repeat(np.arange(n, dtype=np.int64), [len(s) for s in sets])
    shift = np.uint64(64 - (coords.bit_length() - 1))
    low = np.uint64(8)
    for i in range(2 * coords):
        h = mixed(items + np.uint64(_STEP * (i + 1) % 2**64))
        if i < coords:
            slot = owner * coords + (h >> shift).astype(np.int64)
            value = (h << (np.uint64(64) - shift)) >> low
        else:
            slot = owner * coords + (i - coords)
            value = h >> low
        np.minimum.at(sketch, slot, value | (np.uint64(i) << np.uint64(56)))
        open_sets = (sketch.reshape(n, coords) == _NONE).any(axis=1)
        if not open_sets.any():
            break
        going = open_sets[owner]
        if not going.all():
            items, owner = items[going], owner[going]
    return sketch.reshape(n, coords)


def band_keys(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band, its number mixed in."""
    n, coords = sketch.shape
    parts = sketch.reshape(n, coords // rows, rows)
    key = np.arange(1, coords // rows + 1, dtype=np.uint64) * np.uint64(_STEP)
    for r in range(rows):
        key = mixed(key + parts[:, :, r] * np.uint64(0x9E3779B97F4A7C15))
    return key.view(np.int64)


_SKETCHES = "id long, n long, digest binary, bands array<long>, sig binary"


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        ids = batch.column(0)
        # Texts become Python objects one at a time.
        rows = ((k, shingle_set(batch.column(1)[k].as_py(), hashes)) for k in range(batch.num_rows))
        for part in in_chunks(rows, 200_000, lambda r: len(r[1]) + 64):
            full = [k for k, (_, s) in enumerate(part) if len(s)]
            bands: list = [None] * len(part)
            sigs: list = [None] * len(part)
            if full:
                sketch = fast_sketches([part[k][1] for k in full])
                keys = band_keys(sketch)
                low = (mixed(sketch) >> np.uint64(56)).astype(np.uint8)
                for at, k in enumerate(full):
                    bands[k], sigs[k] = keys[at], low[at].tobytes()
            columns = [
                ids.slice(part[0][0], len(part)),
                pa.array([len(s) for _, s in part], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for _, s in part], pa.binary()),
                pa.array(bands, pa.list_(pa.int64())),
                pa.array(sigs, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "digest", "bands", "sig"])


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, digest, bands, sig) per row: set size, digest of the set, band keys, one byte of each coordinate."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_sketch_batches, _SKETCHES)


def _verify_batches(num: int, den: int):
    """Rows (b, chunk, role, id, text) sorted by all but the last: each centre (role 0) before its members."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        key, centres = None, []
        for batch in batches:
            a, b = [], []
            for c, chunk, role, i, text in zip(*[batch[x].array for x in ("b", "chunk", "role", "id", "text")]):
                if (c, chunk) != key:
                    key, centres = (c, chunk), []
                own = shingle_set(text, hashes)
                if role == 0:
                    centres.append(own)
                    continue
                for other in centres:
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    if den * both >= num * (len(own) + len(other) - both) and both:
                        a.append(i)
                        b.append(c)
                        break
            yield pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)})

    return run


def verified(pairs: DataFrame, docs: DataFrame, num: int = 75, den: int = 100) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have den * intersection >= num * union.

    Texts travel once per pair, to chunks of at most about CHUNK members of one centre b, next to the centre's
    own text; a task holds one centre and one batch at a time.
    """
    # Centres of one chunk need no join; what is left is small or, where it is not, split by adaptive execution.
    large = written(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks")).filter("chunks > 1"), "large")
    placed = pairs.join(large, "b", "left").withColumn("chunk", F.pmod(F.xxhash64("a"), F.coalesce("chunks", F.lit(1))).cast("long"))
    placed = placed.select("b", "chunk", F.lit(1).alias("role"), F.col("a").alias("id"))
    centres = placed.select("b", "chunk", F.lit(0).alias("role"), F.col("b").alias("id")).distinct()
    rows = placed.unionByName(centres).join(docs.select("id", "text").hint("merge"), "id")
    rows = rows.repartition("b", "chunk").sortWithinPartitions("b", "chunk", "role")
    return rows.select("b", "chunk", "role", "id", "text").mapInPandas(_verify_batches(num, den), "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """A written table with (id, root) of every id in links (a, b): root is the smallest id reachable.

    links must be a written table.
    """
    ends = links.select(F.col("a").alias("id"), F.least("a", "b").alias("low")).unionByName(links.select(F.col("b").alias("id"), F.least("a", "b").alias("low")))
    roots = written(ends.groupBy("id").agg(F.min("low").alias("root")), "roots")
    while True:
        # Pointer jumping until every id points to a root of its tree.
        up = roots.select(F.col("id").alias("root"), F.col("root").alias("next"))
        jumped = written(roots.select("id", "root").join(up, "root").select("id", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "jumped")
        moved = jumped.filter("moved").limit(1).count() > 0
        discard(roots)
        roots = jumped
        if moved:
            continue
        # All trees are stars now: hook each root to the smallest root next to it.
        a = roots.select(F.col("id").alias("a"), F.col("root").alias("ra"))
        b = roots.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        across = links.join(a, "a").join(b, "b").filter("ra <> rb")
        low, high = F.least("ra", "rb"), F.greatest("ra", "rb")
        hooks = written(across.select(high.alias("root"), low.alias("next")).groupBy("root").agg(F.min("next").alias("next")), "hooks")
        if not hooks.limit(1).count():
            discard(hooks)
            return roots
        hooked = written(roots.select("id", "root").join(hooks, "root", "left").select("id", F.coalesce("next", "root").alias("root")), "roots")
        discard(roots, hooks)
        roots = hooked


_UNIT = ("key", "i", "j", "block", "id", "n", "comp", "centre", "sig", "bands")


def _units(batches: Iterator[pd.DataFrame], columns: tuple[str, ...]) -> Iterator[dict[str, list]]:
    """Rows sorted by (key, i, j), one unit of work at a time."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*[batch[c].array for c in columns]):
            if held and row[:3] != held[0][:3]:
                yield dict(zip(columns, map(list, zip(*held))))
                held = []
            held.append(row)
    if held:
        yield dict(zip(columns, map(list, zip(*held))))


def _likely(u: dict[str, list]) -> list[tuple[int, np.ndarray]]:
    """(k, later members) of a unit that are worth an exact look.

    They are in different components and, if the unit is two blocks, in different ones; sizes allow the similarity;
    sketches agree in AGREE coordinates; neither is the bucket's centre, whose pairs have been verified; and this
    bucket is the first that they share, so that no pair is looked at in two buckets.
    """
    sig = np.frombuffer(b"".join(u["sig"]), dtype=np.uint8).reshape(-1, COORDS)
    bands = np.stack(u["bands"])
    ids, n, comp, block = (np.array(u[x], dtype=np.int64) for x in ("id", "n", "comp", "block"))
    usual = ids != u["centre"][0]
    this = int(np.flatnonzero(bands[0] == u["key"][0])[0])
    out = []
    for k in np.flatnonzero(usual[:-1]):
        rest = np.arange(k + 1, len(ids))
        ok = usual[rest] & (comp[rest] != comp[k]) & (4 * np.minimum(n[rest], n[k]) >= 3 * np.maximum(n[rest], n[k]))
        if u["i"][0] != u["j"][0]:
            ok &= block[rest] != block[k]
        rest = rest[ok]
        if len(rest):
            rest = rest[((sig[rest] == sig[k]).sum(axis=1) >= AGREE) & ~(bands[rest, :this] == bands[k, :this]).any(axis=1)]
        if len(rest):
            out.append((int(k), rest))
    return out


def _screen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of each unit that have a likely partner in it."""
    for u in _units(batches, _UNIT):
        likely = _likely(u)
        if likely:
            at = np.unique(np.concatenate([[k for k, _ in likely], *[r for _, r in likely]]).astype(np.int64))
            yield pd.DataFrame({c: [u[c][k] for k in at] for c in _UNIT})


def _settle(num: int, den: int):
    """Links of each unit, from full sets, until its likely pairs are in one component or found unlike."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for u in _units(batches, (*_UNIT, "text")):
            tree = {c: c for c in u["comp"]}

            def root(c: int) -> int:
                while tree[c] != c:
                    tree[c] = tree[tree[c]]
                    c = tree[c]
                return c

            sets: dict[int, np.ndarray] = {}

            def of(k: int) -> np.ndarray:
                if k not in sets:
                    sets[k] = shingle_set(u["text"][k], hashes)
                return sets[k]

            a, b = [], []
            for k, rest in _likely(u):
                for m in rest.tolist():
                    if root(u["comp"][k]) == root(u["comp"][m]):
                        continue
                    x, y = of(k), of(m)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if den * both >= num * (len(x) + len(y) - both):
                        tree[root(u["comp"][k])] = root(u["comp"][m])
                        a.append(max(u["id"][k], u["id"][m]))
                        b.append(min(u["id"][k], u["id"][m]))
            if a:
                yield pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)})

    return run


def exhaust(members: DataFrame, roots: DataFrame, reps: DataFrame, texts: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between different components that share a bucket and that the buckets' centres did not show.

    Buckets that one component fills are done. Of the others, members are hashed to blocks of about BLOCK shingles,
    and each pair of blocks is a unit of work, so no task holds more than two blocks. Units are screened by
    sketches first; only members with a likely partner get their texts.
    """
    known = members.join(roots, "id", "left").select("key", "id", "n", "centre", "weight", F.coalesce("root", "id").alias("comp"))
    known = written(known, "known")
    several = written(known.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("key"), "several")
    # Both are tables and the join is a merge of plain shuffles, so that adaptive execution can split a hot bucket.
    left = known.join(several.hint("merge"), "key").withColumn("blocks", F.ceil(F.col("weight") / BLOCK))
    left = left.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("long")).join(reps.select("id", "sig", "bands"), "id")
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    left = left.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "n", "comp", "centre", "sig", "bands")
    shape = "key long, i long, j long, block long, id long, n long, comp long, centre long, sig binary, bands array<long>"
    units = written(left.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInPandas(_screen, shape), "units")
    discard(known, several)
    rows = units.join(texts.hint("merge"), "id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return rows.select(*_UNIT, "text").mapInPandas(_settle(num, den), "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 75, den: int = 100) -> DataFrame:
    """(id, n, component) per row of docs."""
    with text_batches(docs.sparkSession):
        return _near_groups(docs, id_col, text_col, num, den)


def _near_groups(docs: DataFrame, id_col: str, text_col: str, num: int, den: int) -> DataFrame:
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sk = written(sketches(docs, id_col, text_col), "sketches")
    usable = sk.filter("n > 0 AND id IS NOT NULL")
    # Fold equal sets: all rows of a digest refer to its smallest id.
    # Written, so that the join has plain shuffles on both sides and the digest of a large group can be split.
    shared = written(usable.groupBy("digest").agg(F.min("id").alias("rep"), F.max("id").alias("high")).filter("rep < high").select("digest", "rep"), "shared")
    copies = written(usable.select("id", "digest").join(shared, "digest").filter("id <> rep").select("id", "rep", "digest"), "copies")
    reps = usable.join(copies.select("id", "digest"), ["id", "digest"], "left_anti").dropDuplicates(["id", "digest"])
    banded = reps.select("id", "n", F.posexplode("bands").alias("band", "key"))
    banded = banded.select("key", "id", "n", F.when(F.col("band") % 2 == 0, F.col("id")).otherwise(F.xxhash64("id")).alias("order"))
    buckets = banded.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min_by("id", "order").alias("centre"), F.min_by("n", "order").alias("centre_n"), F.sum("n").alias("weight")).filter("size > 1")
    members = written(banded.drop("order").join(buckets, "key"), "members")
    near_size = den * F.least("n", "centre_n") >= num * F.greatest("n", "centre_n")
    pairs = written(members.filter(near_size & (F.col("id") != F.col("centre"))).select(F.greatest("id", "centre").alias("a"), F.least("id", "centre").alias("b")).distinct(), "pairs")
    # Only documents that share a bucket are read again: one shuffle of the texts, at any size.
    near = written(texts.join(members.select("id").distinct().hint("merge"), "id", "left_semi"), "near")
    first = written(verified(pairs, near, num, den), "links")
    roots = components(first)
    more = written(exhaust(members.filter("size > 2"), roots, reps, near, num, den), "links")
    if more.limit(1).count():
        every = written(first.unionByName(more), "links")
        discard(roots)
        roots = components(every)
        discard(every)
    discard(shared, members, near, pairs, first, more)
    # A copy's component is its representative's.
    of_copies = copies.select("id", "rep").join(roots.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("root", "rep").alias("root"))
    if_repeated = of_copies.unionByName(roots.select("id", "root")).groupBy("id").agg(F.min("root").alias("root"))
    found = written(sk.select("id", "n").join(if_repeated, "id", "left").select("id", "n", F.coalesce("root", "id").alias("component")), "components")
    discard(sk, copies, roots)
    return found


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stand for their group, with all their columns; rows with a null id stay."""
    found = near_groups(docs, id_col, text_col)
    gone = found.filter(F.col("id").isNotNull() & (F.col("id") != F.col("component"))).select(F.col("id").alias("__gone")).distinct()
    # A merge at any size: what goes grows with the table.
    return docs.join(gone.hint("merge"), docs[id_col] == gone["__gone"], "left_anti")
