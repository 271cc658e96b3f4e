"""Nearest neighbours, language model, BPE, language ID and the pipeline against brute force or held-out data."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.llm import ann, bpe, gru, langid, lm, registry
from tests.llm.test_near_and_substring import brute_components

tokenizers = pytest.importorskip("tokenizers")


# Nearest neighbours


def brute_neighbours(ids, x, q, k=20):
    scores = (x * x[q]).sum(axis=1)
    return [i for i in np.lexsort((ids, -scores)) if ids[i] != ids[q]][:k]


def test_ann_query_recall(spark, sf_dir):
    rows = registry.QUERIES["op1_ann"](spark, sf_dir).toPandas()
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    ids, x = e["vec_id"].to_numpy(), np.array(e["embedding"].tolist(), dtype=float)
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        own = rows[rows["query_id"] == ids[q]].sort_values("rank")
        best = brute_neighbours(ids, x, q)
        hits, total = hits + len(set(own["vec_id"]) & set(ids[best])), total + len(best)
        assert list(own["rank"]) == list(range(1, 21)) and own["score"].is_monotonic_decreasing
    assert hits / total >= 0.9


def test_ann_of_unequal_norms_in_many_lists(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 16)) * rng.uniform(0.2, 3, (3000, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest_neighbours(df, F.col("vec_id") % 50 == 0, k=10).toPandas()
    ids = np.arange(3000)
    hits = sum(len(set(got[got["query_id"] == q]["vec_id"]) & set(brute_neighbours(ids, x, q, 10))) for q in range(0, 3000, 50))
    assert hits / (60 * 10) >= 0.9


def test_ann_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (1, [1.0, 0.0]), (20, [0.5, 0.5]), (40, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("list", F.lit(1)).withColumn("q", F.lit(2))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest_neighbours(df, F.col("vec_id") % 20 == 0, k=3).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.5), (20, 1, 0, 0.5), (20, 2, 1, 0.5), (20, 3, 2, 0.5)]
    assert ann.nearest_neighbours(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    alone = ann.nearest_neighbours(df.filter("vec_id = 0"), F.col("vec_id") % 20 == 0)
    assert alone.count() == 0


def test_adaptive_scan_keeps_the_nearest():
    rng = np.random.default_rng(1)
    x, q = rng.standard_normal((5000, 48)).astype(np.float32), rng.standard_normal((300, 48)).astype(np.float32)
    d = ((x[None] - q[:, None]) ** 2).sum(2)
    limits = np.partition(d, 39, axis=1)[:, 39] * np.float32(1.0001)
    at_q, at_c = ann.adaptive_scan(q, limits, [np.ascontiguousarray(x.T[k : k + 16]) for k in (0, 16, 32)])
    assert (d[at_q, at_c] <= limits[at_q] * 1.001).all()
    assert len(at_q) >= 0.98 * 300 * 40
    assert (np.bincount(at_q, minlength=300) <= 41).all()


def test_limits_tighten_so_that_survivors_do_not_grow_with_the_candidates():
    rng = np.random.default_rng(2)
    x, q = rng.standard_normal((60_000, 32)).astype(np.float32), rng.standard_normal((40, 32)).astype(np.float32)
    survivors = {}
    for m in (8_000, 60_000):
        d = ((x[None, :m] - q[:, None]) ** 2).sum(2)
        at_q, at_c = ann.adaptive_scan(q, np.full(40, np.inf, np.float32), [np.ascontiguousarray(x[:m].T[k : k + 16]) for k in (0, 16)], k=20, own=(np.arange(40) - 50, np.arange(m)))
        survivors[m] = len(at_q) / 40
        best = np.argsort(d, axis=1)[:, :20]
        kept = [set(at_c[at_q == i]) for i in range(40)]
        assert np.mean([len(kept[i] & set(best[i])) / 20 for i in range(40)]) >= 0.97
    assert survivors[60_000] < 2 * survivors[8_000] + 20 and survivors[60_000] < 6 * 20


def test_best_of_takes_each_id_once():
    query, ids, scores = np.array([1, 1, 1, 1, 2]), np.array([5, 5, 4, 9, 5]), np.array([3.0, 2.0, 2.0, 2.0, 1.0])
    best = ann.best_of(query, ids, scores, 2)
    assert [(query[k], ids[k], scores[k]) for k in best] == [(1, 5, 3.0), (1, 4, 2.0), (2, 5, 1.0)]


# Language model


def test_gru_gradient_is_right():
    model = gru.Gru(3, 4, 5, 4).start(np.ones(12), seed=2)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    rng = np.random.default_rng(0)
    before, targets = rng.integers(0, 12, (6, 3)), rng.integers(0, 12, (6, 3))
    targets[4:, 1] = -1
    h0 = np.zeros((3, 5))
    _, _, grad, _ = model.window(before, targets, h0)
    for name, g in grad.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in g.shape)
            old = model.p[name][at]
            ends = []
            for e in (1e-5, -1e-5):
                model.p[name][at] = old + e
                ends.append(model.window(before, targets, h0)[0])
            model.p[name][at] = old
            assert (ends[0] - ends[1]) / 2e-5 == pytest.approx(g[at], abs=1e-4)


def test_gru_is_a_distribution_and_packing_does_not_matter():
    model = gru.Gru(3, 4, 5, 4).start(np.arange(12), seed=1)
    h = np.random.default_rng(0).standard_normal((1, 5)).astype(np.float32)
    assert sum(math.exp(model.log_probs(h, np.array([t]))[0]) for t in range(12)) == pytest.approx(1, abs=1e-4)
    rng = np.random.default_rng(4)
    texts = [np.append(rng.integers(1, 12, n), 0).astype(np.int32) for n in (0, 3, 200, 7, 1, 64)]
    alone = [gru.score(model, [t])[0] for t in texts]
    assert np.allclose(gru.score(model, texts, lanes=2), alone, atol=1e-3) and np.allclose(gru.score(model, texts, lanes=16), alone, atol=1e-3)


def test_lanes_beside_a_very_long_text_hold_a_few_times_the_tokens():
    for lengths in ([100_000, *[50] * 3_000], [300] * 5_000, [7], [1] * 9, [90_000, 80_000, 5]):
        lane = gru.packed(lengths, 512)
        assert sorted(i for one in lane for i in one) == list(range(len(lengths)))
        assert len(lane) * max(sum(lengths[i] for i in one) for one in lane) <= 4 * sum(lengths)


def brute_base(rows):
    words = [(i, [*(t or "").encode().lower().split(), None]) for i, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows]
    c = Counter(w for (_, ws), h in zip(words, held) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return [(str(i), h, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for (i, ws), h in zip(words, held)]


def _base_rows(df):
    return sorted((str(r.id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in df.collect())


def test_lm_base_matches_brute_force_and_the_model_beats_it(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = lm.score_documents(docs).cache()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert _base_rows(out) == sorted(brute_base(rows))
    held = out.filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert held.s > held.b


def test_lm_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(lm, "COMMON", 3)  # most words go the long way
    rows = [(0, "A b c b"), (1, None), (2, ""), (3, "x " * 500), (4, "new words here"), (4, "new words here"), (None, "b"), (7, "É é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("base", F.lit(1))
    out = lm.score_documents(docs)
    assert _base_rows(out) == sorted(brute_base(rows))
    assert all(math.isfinite(r.score) for r in out.collect())
    assert lm.score_documents(docs.limit(0)).count() == 0


def _plain_score(model, lexicon, ranks, counts, text):
    """log10 probability of a text, token by token, from the model's parameters only."""
    p = {k: v.astype(np.float64) for k, v in model.p.items()}
    words = lm.words_of(text)
    rank = [ranks[w] for w in words]
    tokens = [k + 2 if 0 <= k < lexicon.size - 2 else gru.UNKNOWN for k in rank] + [gru.END]
    n, h, last, total = model.hidden, np.zeros(model.hidden), gru.END, 0.0
    kinds, inside = len(counts), sum(1 for k in range(len(lexicon.words)) if k < lexicon.size - 2)
    outside = sum(counts.values()) - sum(counts[w] for w in lexicon.words[:inside])
    for k, token in enumerate(tokens):
        x, a = p["emb"][last] @ p["wx"] + p["b"], h @ p["u"]
        z, r = 1 / (1 + np.exp(-(x[:n] + a[:n]))), 1 / (1 + np.exp(-(x[n : 2 * n] + a[n : 2 * n])))
        c = np.tanh(x[2 * n :] + r * a[2 * n :])
        h = z * h + (1 - z) * c
        one, two = h @ p["wc"] + p["bc"], h @ p["ww"][token // model.size] + p["bw"][token // model.size]
        total += (one[token // model.size] - np.log(np.exp(one).sum()) + two[token % model.size] - np.log(np.exp(two).sum())) / np.log(10)
        if token == gru.UNKNOWN:
            total += np.log10(counts.get(words[k], 0) + 0.5) - np.log10(outside + 0.5 * (kinds - inside + 1))
        last = token
    return total


def test_lm_score_equals_a_plain_loop_and_does_not_depend_on_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").cache()
    one = {r.id: r.score for r in lm.score_documents(docs.repartition(1)).collect()}
    eight = {r.id: r.score for r in lm.score_documents(docs.repartition(8, "text")).collect()}
    assert set(one) == set(eight) and all(one[i] == pytest.approx(eight[i], rel=1e-6) for i in one)
    training = docs.filter(~lm.is_held_out(F.col("doc_id"))).withColumnRenamed("doc_id", "id")
    lexicon, model, _ = lm.fit_corpus(training)
    counts = Counter(w for r in training.collect() for w in lm.words_of(r.text))
    ranks = lexicon.ranks()
    for r in docs.filter("doc_id % 11 = 0").collect():
        assert one[r.doc_id] == pytest.approx(_plain_score(model, lexicon, ranks, counts, r.text), rel=1e-4, abs=1e-3)


def test_every_token_of_a_training_document_is_learned_once_in_one_order(monkeypatch):
    monkeypatch.setattr(lm, "PIECE", 64)
    rows = {"0": "a b c " * 400, "1": "a", "2": None, "9": "b zz " * 96}
    lexicon = lm.Lexicon([b"a", b"b", b"c"], [9, 8, 7], 4, 24, 3, 5)
    dealt = [p for i, t in rows.items() for p in lm._dealt(lexicon, 3, i, t, lexicon.ranks())]
    assert {s for s, *_ in dealt} == {0, 1, 2}
    learned = []
    monkeypatch.setattr(lm, "train", lambda model, pieces, rate, adam: learned.append(pieces) or (0.0, sum(len(p) - 1 for p in pieces)))
    tokens = [n for _, n in lm._learned(gru.Gru(2, 4, 3, 2).start(np.ones(8)), ((s, x) for s, _, _, x in sorted(dealt)))]
    assert len(tokens) == 3 and sum(tokens) == sum(len(lm.words_of(t)) + 1 for t in rows.values())
    # Each piece carries the token ahead of it, so that cutting a text loses no transition.
    whole = lm.pieces_of(np.arange(2, 300, dtype=np.int32))
    assert np.concatenate([p[1:] for p in whole]).tolist() == list(range(2, 300)) and [p[0] for p in whole[1:]] == [p[-1] for p in whole[:-1]]
    assert lm.warm_window(np.array([0], np.int32), 7).tolist() == [0, 0] and len(lm.warm_window(np.arange(2, 300, dtype=np.int32), 1)) == 97


def test_training_on_lanes_sets_the_state_back_at_each_text():
    model = gru.Gru(3, 4, 5, 4).start(np.ones(12), seed=2)
    before, targets, fresh = gru.stream([np.array([0, 5, 6, 0]), np.array([6, 7, 0]), np.array([0, 3, 0])])
    assert before.tolist() == [0, 5, 6, 6, 7, 0, 3] and targets.tolist() == [5, 6, 0, 7, 0, 3, 0] and fresh.tolist() == [True, False, False, True, False, True, False]
    column = lambda x: x[:, None]
    loss = model.window(column(before), column(targets), np.ones((1, 5), np.float32), column(fresh))[0]
    alone = sum(model.window(column(np.array(b)), column(np.array(t)), np.zeros((1, 5), np.float32), np.array([[True]] + [[False]] * (len(b) - 1)))[0] for b, t in (([0, 5, 6], [5, 6, 0]), ([6, 7], [7, 0]), ([0, 3], [3, 0])))
    assert loss == pytest.approx(alone, rel=1e-5)


def test_lm_keeps_its_counts_without_a_written_table_and_lets_them_go(spark, monkeypatch):
    labels, write = [], lm.written
    monkeypatch.setattr(lm, "written", lambda df, label, **options: labels.append(label) or write(df, label, **options))
    held = spark.sparkContext._jsc.sc().getPersistentRDDs
    before = held().size()
    docs = spark.createDataFrame([(i, f"one two w{i}") for i in range(40)], "doc_id long, text string")
    assert lm.score_documents(docs).count() == 40
    assert labels == ["scored", "rare"] and held().size() == before


def test_the_cut_of_common_words_takes_part_of_a_step(spark):
    counts = spark.range(500).select(F.concat(F.lit("w"), F.col("id")).cast("binary").alias("word"), F.lit(7).cast("long").alias("c"))
    some = lm.most_frequent(counts, 100)
    assert 90 <= len(some) <= 100 and some == lm.most_frequent(counts.repartition(5), 100)
    more = counts.unionByName(spark.createDataFrame([(b"top", 900)], "word binary, c long"))
    assert bytes(lm.most_frequent(more, 50)[0]["word"]) == b"top" and len(lm.most_frequent(more, 1000)) == 501


# BPE


@pytest.fixture(scope="module")
def both():
    path = bpe.vocabulary_path()
    reference = tokenizers.Tokenizer.from_file(path)
    reference.no_truncation()
    reference.no_padding()
    vocabulary = bpe.Vocabulary.from_json(path)
    return reference, bpe.Encoder(vocabulary), vocabulary


def _same(both, text):
    reference, encoder, vocabulary = both
    want = reference.encode(text, add_special_tokens=False).ids
    got = np.frombuffer(encoder.encode(text), "<i4").tolist()
    assert got == want
    assert bpe.decode_ids(got, vocabulary.tokens) == reference.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=80))
def test_bpe_equals_the_library_on_any_text(both, text):
    _same(both, text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "the", " ", "  ", "\n", "\t ", "'s", "'LL", "é", "12", "!?", "<|endoftext|>", "　", "\x1c", "한국", "word", "x" * 200, "ab" * 150]), max_size=40))
def test_bpe_equals_the_library_on_awkward_texts(both, parts):
    _same(both, "".join(parts))


def test_bpe_merges_agree(both):
    _, _, v = both
    for word in (b"a" * 129, b"thequickbrownfox" * 20, bytes(range(256))):
        parts = [v.byte_ids[b] for b in word]
        assert bpe.merge_short(list(parts), v.ranks, v.merged) == bpe.merge_long(list(parts), v.ranks, v.merged)


def test_bpe_query_round_trip(spark, sf_dir, both):
    reference = both[0]
    rows = {r.doc_id: r for r in registry.QUERIES["op5_bpe"](spark, sf_dir).collect()}
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = reference.encode(d.text or "", add_special_tokens=False).ids
        r = rows[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_bpe_edge_cases(spark):
    path = bpe.vocabulary_path()
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a"), (3, "b " * 50_000), (4, "b"), (4, "b")], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    out = bpe.decode(bpe.encode(docs, path), path).collect()
    assert sorted((str(r.id), len(r.ids), len(r.text)) for r in out) == sorted([("1", 0, 0), ("2", 0, 0), ("None", 1, 1), ("3", 50_001, 100_000), ("4", 1, 1), ("4", 1, 1)])
    assert bpe.encode(docs.limit(0), path).count() == 0


# Language ID


def test_language_id_on_held_out_labels(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.TextModel.fit(docs.filter("doc_id % 2 = 0"))
    none = F.lit(None).cast("string")
    found = langid.identify(docs.filter("doc_id % 2 = 1"), model, "doc_id", F.col("text"), none, none, F.col("source"), none, keep=("lang",))
    renamed = found.toDF("id", "found", "probability", "text_lang", "label")
    assert renamed.filter("found = label").count() / renamed.count() >= 0.95


def brute_languages(docs, pages):
    """{page_id: (lang, probability)} of op6, in plain Python over whole tables."""
    import re

    counts = {}
    for r in docs:
        if r.lang:
            counts.setdefault(r.lang, Counter()).update(langid.trigram_bins(r.text).tolist())
    langs = sorted(counts)
    logs = []
    for lang in langs:
        total = sum(counts[lang].values()) + 0.5 * langid.BINS
        logs.append({b: math.log((c + 0.5) / total) for b, c in counts[lang].items()} | {None: math.log(0.5 / total)})
    rows = []
    for p in pages:
        rest = p.url.split("://", 1)[1] if "://" in (p.url or "") else ""
        host = re.match(r"[^/?#]*", rest).group().lower()
        path = re.match(r"[^/?#]*([^?#]*)", rest).group(1)
        parts = host.split(".")
        code = re.match(r"/([a-z]{2})(?:/|$)", path)
        declared = re.search(r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)", p.html or "")
        text = re.sub(r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>|&[a-z#0-9]+;", " ", p.html or "")
        bins = Counter(langid.trigram_bins(text).tolist())
        scores = [sum(n * t.get(b, t[None]) for b, n in bins.items()) / 3 for t in logs] + [-sum(bins.values()) * math.log(langid.BINS) / 3] if bins else None
        rows.append((p.page_id, declared and declared.group(1).lower(), code.group(1) if code else parts[-1], host, ".".join(parts[-2:]) if len(parts) > 2 else host, scores))

    def normal(x):
        e = [math.exp(v - max(x)) for v in x]
        return [v / sum(e) for v in e]

    k = len(langs) + 1
    add = lambda table, key, x: table.__setitem__(key, [a + b for a, b in zip(table.get(key, [0.0] * k), x)])
    values, hosts, domains, base = {"d": {}, "s": {}}, {}, {}, [1.0] * k
    for _, d, s, host, domain, scores in rows:
        if scores:
            x = normal(scores)
            base = [a + b for a, b in zip(base, x)]
            for table, key in ((values["d"], d), (values["s"], s), (hosts, host), (domains, domain)):
                if key:
                    add(table, key, x)
    base = [b / sum(base) for b in base]
    smooth = lambda mass, up: [(m + 20 * u) / (sum(mass) + 20) for m, u in zip(mass, up)]
    value_logs = {}
    for name, table in values.items():
        totals = [sum(m[j] for m in table.values()) + len(table) for j in range(k)]
        value_logs[name] = {v: [0.5 * math.log((m[j] + 1) / totals[j]) for j in range(k)] for v, m in table.items()}
    out = {}
    for i, d, s, host, domain, scores in rows:
        known = scores or host in hosts or d in value_logs["d"] or s in value_logs["s"]
        prior = smooth(hosts[host], smooth(domains[domain], base) if domain in domains else base) if host in hosts else base
        post = normal([a + math.log(b) + c + e for a, b, c, e in zip(scores or [0.0] * k, prior, value_logs["d"].get(d, [0.0] * k), value_logs["s"].get(s, [0.0] * k))])
        out[i] = ([*langs, None][post.index(max(post))] if known else None, max(post) if known else 0.0)
    return out


def test_language_id_query_matches_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    odd = [(-1, None, None), (-2, "nowhere", ""), (-3, "http://a.b.c.d/xx/", "<html lang='zz'>12"), (-4, "http://one.example.org/en", "<html lang=en><p>!</html>"), (-5, "http://x.org/fr/", "<html lang=de>" + "the cat and the dog " * 20_000), (-6, "http://x.org/", "qxzj wvkq " * 50)]
    pages = pages.unionByName(spark.createDataFrame(odd, pages.schema)).withColumn("p", F.lit("clash")).withColumn("logs", F.lit(1))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    want = brute_languages(docs.collect(), pages.collect())
    got = {r.page_id: (r.lang, r.probability) for r in langid.op6_language_id(spark, str(tmp_path)).collect()}
    assert set(got) == set(want)
    # Distributions are held in single precision, so a long text's evidence differs in the sixth digit.
    assert all(got[i][0] == want[i][0] and got[i][1] == pytest.approx(want[i][1], abs=1e-3) for i in want)
    assert got[-1] == (None, 0.0) and got[-6][0] is None and got[-5][0] == "en"


def test_language_id_learns_seventy_languages(spark, monkeypatch):
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    own = {f"l{k:02}": " ".join(alphabet[(k * 7 + j * (k % 5 + 1)) % 26] * 2 + alphabet[k % 26] + alphabet[(k // 26 + j) % 26] for j in range(12)) for k in range(70)}
    docs = spark.createDataFrame([(k, lang, text, "s") for k, (lang, text) in enumerate(own.items())], "doc_id long, lang string, text string, source string")
    none = F.lit(None).cast("string")

    def found():
        model = langid.TextModel.fit(docs)
        assert len(model.langs) == 70
        return {r.id: (r.lang, round(r.probability, 6)) for r in langid.identify(docs, model, "doc_id", F.col("text"), F.col("lang"), none, F.col("source"), none).collect()}

    got = found()
    assert all(lang == f"l{i:02}" for i, (lang, _) in got.items())
    # The languages held at a time, and how tables are joined, change nothing.
    monkeypatch.setattr(langid, "LANGS_AT_ONCE", 9)
    monkeypatch.setattr(langid, "BROADCAST_CELLS", 1)
    assert found() == got


def test_language_id_edge_cases(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en", "s"), (2, "le chat et le chien", "fr", "s"), (3, None, None, None), (4, "12 34 !!", "fr", "t"), (5, "the dog", None, "s"), (5, "the dog", None, "s"), (None, "le chien", "en", None), (6, "zqj xkw vvq jjx " * 9, None, "u")], "doc_id long, text string, lang string, source string").withColumn("host", F.lit("clash")).withColumn("logs", F.lit(1)).withColumn("p", F.lit(2)).withColumn("doc_0", F.lit(3))
    model = langid.TextModel.fit(docs)
    none = F.lit(None).cast("string")
    out = {str(r.id): r for r in langid.identify(docs, model, "doc_id", F.col("text"), F.col("lang"), none, F.col("source"), none).collect()}
    assert out["1"].lang == "en" and out["2"].lang == "fr" and out["5"].lang == "en"
    assert out["3"].lang is None and out["3"].probability == 0 and out["4"].text_lang is None and out["4"].lang in ("en", "fr")
    kept = langid.accepted(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id IN (3, 4, 6)").count() == 0 and kept.filter("doc_id = 5").count() == 2
    empty = langid.TextModel.fit(docs.limit(0))
    assert langid.identify(docs, empty, "doc_id", F.col("text"), none, none, none, none).filter("lang IS NOT NULL").count() == 0
    assert langid.identify(docs.limit(0), model, "doc_id", F.col("text"), F.col("lang"), none, F.col("source"), none).count() == 0
    assert langid.accepted(docs.limit(0)).count() == 0


def test_sessions_keep_their_batch_size(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    langid.TextModel.fit(spark.createDataFrame([("en", "a b")], "lang string, text string"))
    assert spark.conf.get(key) == before


def test_markup_is_stripped(spark):
    df = spark.createDataFrame([('<html lang="de-AT"><head><style>p{}</style><script>var t="</p>";</script></head><body><!-- x --><p>Guten&nbsp;Tag</body>',)], "html string")
    row = df.select(langid.markup_text(F.col("html")).alias("t"), langid.declared_language(F.col("html")).alias("d")).first()
    assert row.t.split() == ["Guten", "Tag"] and row.d == "de"


# Pipeline


def test_pipeline_matches_brute_force(spark, tmp_path, both):
    import corpus_pipeline
    from strandline.llm import mixing

    texts = ["the cat sat on the mat and looked at the dog", "The cat sat on the mat and looked at the dog", "the  cat sat on the mat and looked at the dog", "le chat et le chien dorment sous la table ce soir", "!!! 123", "the dog ran over the hill and far away from here", "der hund und die katze schlafen unter dem tisch heute"]
    rows = [(i, t, "fr" if t.startswith("le") else "de" if t.startswith("der") else "en", f"src{i % 3}", len(t)) for i, t in enumerate(texts * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id, list(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    spoken = [r for r in rows if any(c.isalpha() for c in r[1])]
    exact = list({" ".join(r[1].split()): r for r in reversed(spoken)}.values())
    roots = brute_components([(r[0], r[1]) for r in exact])
    near = [r for r in exact if roots[r[0]] == r[0]]
    size = Counter()
    for r in near:
        size[r[3]] += len(r[1])
    weights = {s: mixing.production_weights()[s] for s in size}
    want = []
    for r in near:
        rate = weights[r[3]] / sum(weights.values()) * sum(size.values()) / size[r[3]]
        u = int(hashlib.sha256(f"{mixing.SEED}|{r[0]}|1".encode()).hexdigest()[:13], 16) / 2**52
        k, p, cdf = 0, math.exp(-rate), math.exp(-rate)
        while cdf <= u:
            k += 1
            p *= rate / k
            cdf += p
        want += [(r[0], both[0].encode(r[1], add_special_tokens=False).ids)] * k
    assert got == sorted(want)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "near_dedup", "mix_sources", "bpe"]
