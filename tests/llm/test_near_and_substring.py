"""Near and substring dedup against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import near_dedup, substring_dedup
from strandline.llm.words import WordHashes, rolling

DOCS = "doc_id long, text string"


def _shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(_shingles(t))
    tree = {i: i for i in sets}

    def root(x):
        while tree[x] != x:
            x = tree[x]
        return x

    flat = [(i, s) for i, many in sets.items() for s in many if s]
    for k, (i, a) in enumerate(flat):
        for j, b in flat[:k]:
            if 100 * len(a & b) >= 75 * len(a | b):
                x, y = root(i), root(j)
                tree[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def near_corpus(seed, n=120):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    base = [[r.choice(vocab) for _ in range(r.randint(1, 90))] for _ in range(25)]
    rows = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 4, 9])):
            w[r.randrange(len(w))] = r.choice(vocab)
        rows.append((i, " ".join(w)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_groups_match_brute_force(spark, seed):
    rows = near_corpus(seed)
    got = {r.id: r.component for r in near_dedup.near_groups(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute_components(rows)


def test_near_groups_find_every_link_of_a_chain(spark):
    """Neighbours in a chain of edits are alike, its ends are not: one component, whatever the centre."""
    r = random.Random(4)
    w, rows = [f"x{k}" for k in range(300)], []
    for i in range(40):
        rows.append((i, " ".join(w)))
        for _ in range(4):
            w[r.randrange(len(w))] = f"y{r.random()}"
    got = {x.id: x.component for x in near_dedup.near_groups(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute_components(rows)


def test_near_groups_edge_cases(spark):
    long = " ".join(f"z{k}" for k in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (6, "one two three"), (7, long), (8, long + " end"), (9, "a b c d e"), (9, "a b c d e"), (10, "a b c d e"), (None, "a b c d e"), (11, "É b c d e"), (12, "é b c d e")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("component", F.lit("clash")).withColumn("bands", F.lit(0))
    got = sorted((str(r.id), r.n, str(r.component)) for r in near_dedup.near_groups(docs).collect())
    assert got == sorted([("1", 0, "1"), ("2", 0, "2"), ("3", 0, "3"), ("4", 1, "4"), ("5", 1, "4"), ("6", 1, "6"), ("7", 29996, "7"), ("8", 29997, "7"), ("9", 1, "9"), ("9", 1, "9"), ("10", 1, "9"), ("None", 1, "None"), ("11", 1, "11"), ("12", 1, "12")])
    kept = near_dedup.keep_representatives(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "3", "4", "6", "7", "9", "9", "None", "11", "12"])
    assert near_dedup.near_groups(docs.limit(0)).count() == 0


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    b = np.unique(np.concatenate([a[:300], rng.integers(0, 2**63, 100).astype(np.uint64)]))
    s = near_dedup.fast_sketches([a, b, a[:1], a[:2]])
    assert (s != np.uint64(2**64 - 1)).all()
    jaccard = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((s[0] == s[1]).mean() - jaccard) < 0.15
    assert (near_dedup.fast_sketches([a])[0] == s[0]).all()


def test_blocks_split_buckets_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 300)
    rows = near_corpus(9, 150)
    got = {r.id: r.component for r in near_dedup.near_groups(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute_components(rows)


def brute_removed(rows, width=35):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    count = Counter(tuple(w[k : k + width]) for _, w in words for k in range(len(w) - width + 1))
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - width + 1):
            if count[tuple(w[k : k + width])] > 1:
                gone.update(range(k, k + width))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((str(i), len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found_removed(df):
    rows = df.select("id", "n_words", "n_removed", F.coalesce("whole", F.sha2(F.col("kept").cast("binary"), 256)).alias("sha")).collect()
    return sorted((str(r.id), r.n_words, r.n_removed, r.sha) for r in rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_substrings_match_brute_force(spark, seed):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(60)]
    passages = [[r.choice(vocab) for _ in range(r.randint(30, 90))] for _ in range(8)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(r.randint(0, 4)):
            p = r.choice(passages)
            a = r.randint(0, 10)
            w += [r.choice(vocab) for _ in range(r.randint(0, 20))] + p[a : len(p) - r.randint(0, 10)]
        rows.append((i, " ".join(w)))
    assert found_removed(substring_dedup.substring_dedup(spark.createDataFrame(rows, DOCS))) == brute_removed(rows)


def test_substrings_edge_cases(spark):
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "be " * 200), (5, passage), (6, "start " + passage + " end"), (7, "once " + " ".join(f"q{k}" for k in range(34))), (8, passage.upper()), (9, "a b"), (9, "a b"), (10, " ".join(f"r{k}" for k in range(36))), (10, " ".join(f"r{k}" for k in range(36))), (None, passage), (11, "x y " * 20 + "tail " * 10), (12, " ".join(f"s{k % 50}" for k in range(400)))]
    docs = spark.createDataFrame(rows, DOCS).withColumn("spans", F.lit("clash")).withColumn("anchor", F.lit(0))
    assert found_removed(substring_dedup.substring_dedup(docs)) == brute_removed(rows)
    assert substring_dedup.substring_dedup(docs.limit(0)).count() == 0


def test_spans_are_factors_of_a_reference(spark):
    passage = " ".join(f"p{k}" for k in range(50))
    rows = [(1, "a b c " + passage), (2, passage + " d e f"), (3, "nothing of it")]
    out = {r.id: r for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, DOCS)).collect()}
    assert [(s.start, s.words, s.ref) for s in out[1].spans] == [(3, 50, 1)] and [(s.start, s.words, s.ref) for s in out[2].spans] == [(0, 50, 1)]
    assert out[1].kept == "a b c" and out[3].spans is None


def test_rolling_hash_is_of_the_run():
    h = WordHashes()
    a, b = h.of(b"a b c d e f g".split()), h.of(b"x b c d e f y".split())
    assert rolling(a, 5)[1] == rolling(b, 5)[1] and rolling(a, 5)[0] != rolling(b, 5)[0]
    assert len(rolling(a, 8)) == 0 and len(rolling(a, 7)) == 1
