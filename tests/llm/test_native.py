"""Exact dedup, mixing, URL filters and chat formatting: SQL twins and edge cases."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from strandline.llm import chat, exact_dedup, mixing, registry, url_filter
from tests.compare import duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    columns, want = duck_rows(duck, registry.ORACLES[name])
    assert sorted(df.columns) == columns
    assert spark_rows(df) == want


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _docs(spark, *rows):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)


def _found(df):
    return {(r.id, r.keep_id, r.group_size, r.kept) for r in df.collect()}


def test_exact_dedup_nulls_white_space_ties_and_repeats(spark):
    docs = _docs(spark, (3, "a  b"), (1, "a\tb"), (2, "a b "), (5, None), (4, ""), (7, " \n"), (6, " "), (9, "x"), (9, "x"), (None, "a b"), (None, "q"))
    got = _found(exact_dedup.exact_dedup(docs))
    assert got == {(1, 1, 3, True), (3, 1, 3, False), (None, 1, 3, False), (2, 2, 1, True), (4, 4, 2, True), (5, 4, 2, False), (6, 6, 2, True), (7, 6, 2, False), (9, 9, 2, True), (None, None, 1, True)}


def test_exact_dedup_keeps_each_text_once(spark):
    docs = _docs(spark, (1, "a b"), (1, "a b"), (2, "a b"), (1, "c"), (3, "d")).withColumn("digest", F.lit("clash")).withColumn("n", F.lit(1))
    kept = exact_dedup.keep_rows(docs)
    assert kept.columns == docs.columns
    assert sorted(r.text for r in kept.collect()) == ["a b", "c", "d"]


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.exact_dedup(_docs(spark).limit(0)).count() == 0


def test_batches_of_an_index_equal_one_batch(spark):
    index = exact_dedup.DigestIndex(spark, "digest_index_batches", 4)
    index.drop()
    index.create()
    rows = [[(5, "a"), (2, "b"), (7, "d"), (8, "d")], [(3, "a"), (4, "c"), (1, "a"), (6, "e"), (0, "d"), (9, "c")], [(None, "a"), (None, "f")], [(11, "f"), (12, "c"), (12, "c")]]
    batches = [exact_dedup.digests(_docs(spark, *r)) for r in rows]
    for batch in batches:
        exact_dedup.add_batch(index, batch)
    assert sorted(str((r.keep_id, r.n)) for r in index.read().collect()) == ["(2, 1)", "(4, 2)", "(5, 1)", "(6, 1)", "(7, 2)", "(None, 1)"]
    together = [r for one in rows for r in one]
    want = _found(exact_dedup.exact_dedup(_docs(spark, *together), batches=1))
    got = set().union(*[_found(exact_dedup.resolve(batch, index)) for batch in batches])
    assert got == want == _found(exact_dedup.exact_dedup(_docs(spark, *together), batches=3))
    assert {(3, 1, 4, False), (1, 1, 4, True), (0, 0, 3, True), (7, 0, 3, False), (None, 11, 2, False), (4, 4, 4, True)} <= got
    assert "SortMergeJoin" in index.unseen(exact_dedup.groups_of(exact_dedup.digests(_docs(spark, (6, "z")))))._jdf.queryExecution().toString()
    index.drop()


def test_exact_dedup_leaves_no_index_behind(spark):
    before = {t.name for t in spark.catalog.listTables()}
    exact_dedup.exact_dedup(_docs(spark, (1, "a"), (2, "a"))).count()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_poisson_quantiles(spark):
    rates = [0.0, 0.3, 1.0, 7.5, 40.0]
    cdf = spark.createDataFrame([(r,) for r in rates], "rate double").select("rate", mixing.poisson_cdf(F.col("rate")).alias("cdf"))
    for r in cdf.collect():
        assert r.cdf == sorted(r.cdf) and r.cdf[-1] == pytest.approx(1, abs=1e-9)


@pytest.mark.parametrize("limit", [10, 0])
def test_mixing_meets_weights_and_does_not_depend_on_the_join(spark, limit):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("abcd").alias("text"), F.when(F.col("id") % 3 == 0, "x").when(F.col("id") % 3 == 1, "y").alias("source"))
    mixed = mixing.mix_sources(docs, {"x": 3.0, "y": 1.0}, seed=5, other_weight=0.0, broadcast_sources=limit)
    counts = {r.source: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert set(counts) == {"x", "y"}
    assert counts["x"] == pytest.approx(4500, rel=0.06) and counts["y"] == pytest.approx(1500, rel=0.08)
    assert mixed.groupBy("doc_id", "replica").count().filter("count > 1").count() == 0
    other = mixing.mix_sources(docs.repartition(7), {"x": 3.0, "y": 1.0}, seed=5, other_weight=0.0)
    assert sorted(map(tuple, mixed.select("doc_id", "replica").collect())) == sorted(map(tuple, other.select("doc_id", "replica").collect()))


def test_mixing_large_rates_nulls_and_nothing(spark):
    docs = spark.createDataFrame([(1, "ab", "rare"), (None, None, None), (3, "a" * 3000, "big")], "doc_id long, text string, source string")
    mixed = mixing.mix_sources(docs, {"rare": 1.0}, seed=1, other_weight=0.0).groupBy("source").count().collect()
    assert [r.source for r in mixed] == ["rare"] and mixed[0]["count"] == pytest.approx(1501, rel=0.15)
    assert mixing.mix_sources(docs.limit(0), {"rare": 1.0}, other_weight=0.0).count() == 0
    assert set(mixing.mix_sources(docs, {}, other_weight=1.0, null_name="none").columns) == {*docs.columns, "mix_rate", "replica", "shuffle_key"}


def test_mixing_carries_clashing_names_and_repeated_rows(spark):
    clash = ["source_", "salt", "cdf", "pieces", "unit", "copies", "doc_0", "__u", "__source", "a.b"]
    docs = spark.createDataFrame([(i // 2, "abc", None if i % 3 == 0 else "x") for i in range(40)], "doc_id long, text string, source string")
    docs = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in clash if "." not in c}).withColumn("a.b", F.lit(1)).withColumn("replica", F.lit("gone"))
    for limit in (10, 0):
        mixed = mixing.mix_sources(docs, {"x": 1.0}, seed=3, budget=1200.0, other_weight=1.0, broadcast_sources=limit)
        assert mixed.columns == [*[c for c in docs.columns if c != "replica"], "replica", "mix_rate", "shuffle_key"]
        rows = mixed.collect()
        assert all(r["__u"] == f"__u{r.doc_id}" and r["pieces"] == f"pieces{r.doc_id}" for r in rows)
        # Rows that repeat an id get one count each, and each is replicated.
        per_id = {}
        for r in rows:
            per_id.setdefault((r.doc_id, r.source), []).append(r.replica)
        assert all(sorted(v) == sorted([*range(max(v) + 1)] * (len(v) // (max(v) + 1))) for v in per_id.values())


def test_mixing_says_what_it_leaves_out(spark):
    docs = spark.createDataFrame([(1, "ab", "x"), (2, "abc", None), (3, None, "z"), (4, "a", "elsewhere"), (5, "aa", "elsewhere")], "doc_id long, text string, source string")
    lost = {(r.source, r.documents, r.size) for r in mixing.left_out(docs, {"x": 1.0}, other_weight=0.0).collect()}
    assert lost == {("", 1, 3), ("z", 1, 0), ("elsewhere", 2, 3)}
    assert {r.source for r in mixing.left_out(docs, {"x": 1.0}, other_weight=1.0).collect()} == {"z"}
    assert {r.source for r in mixing.mix_sources(docs, {"x": 1.0}, budget=1000.0, other_weight=1.0).select("source").distinct().collect()} == {"x", None, "elsewhere"}
    with pytest.raises(TypeError):
        mixing.mix_sources(docs, {"x": 1.0})


def _judged(spark, urls, rules, **more):
    pages = spark.createDataFrame([(i, u, "clash", 1) for i, u in enumerate(urls)], "page_id int, url string, rule string, salt int")
    made = spark.createDataFrame(rules, "host string, path string, verdict string")
    return {r.id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, made, **more).collect()}


@pytest.mark.parametrize("limit", [100, 0])
def test_url_rules_longest_wins(spark, limit):
    rules = [("com", "/", "allow"), ("b.com", "/x", "block"), ("a.b.com", "/", "allow"), ("com", "/xyz/long", "block"), ("b.com", "/x", "allow"), (None, "/", "block"), ("", "/", "block")]
    urls = ["http://a.b.com/xy", "http://B.com/xyz?q", "http://c.com", "http://ab.com/x", None, "b.com/x", "http://b.com/xyz/long/er#f", "://", "http://a.b.com:80/x"]
    got = _judged(spark, urls, rules, default="allow", broadcast_rules=limit)
    assert got[0] == ("a.b.com", "/xy", "a.b.com/", "allow")
    assert got[1] == ("b.com", "/xyz", "b.com/x", "block")
    assert got[2] == ("c.com", "", None, "allow")
    assert got[3] == ("ab.com", "/x", "com/", "allow")
    assert got[4] == got[5] == got[7] == ("", "", None, "allow")
    assert got[6] == ("b.com", "/xyz/long/er", "com/xyz/long", "block")
    assert got[8] == ("a.b.com:80", "/x", None, "allow")


def test_url_of_great_length(spark):
    deep = "http://" + "s." * 3000 + "b.com/x" + "/y" * 200_000
    got = _judged(spark, [deep, "http://" + "p" * 1_000_000], [("b.com", "/x", "block"), ("b.com", "/x" + "/y" * 9, "allow")], default="block")
    assert got[0][2:] == ("b.com/x" + "/y" * 9, "allow") and got[1][2:] == (None, "block")


def test_exact_dedup_of_very_long_texts(spark):
    long = "word \t " * 400_000
    docs = _docs(spark, (2, long), (1, long.replace("\t", "\n")), (3, long + "x"))
    assert _found(exact_dedup.exact_dedup(docs)) == {(1, 1, 2, True), (2, 1, 2, False), (3, 3, 1, True)}


def test_url_rules_repeats_and_nothing(spark):
    pages = spark.createDataFrame([(1, "http://a.com/"), (1, "http://a.com/"), (None, None)], "page_id int, url string")
    rules = spark.createDataFrame([("com", "/", "block")], "host string, path string, verdict string")
    assert sorted(str((r.id, r.verdict)) for r in url_filter.judge_urls(pages, rules).collect()) == ["(1, 'block')", "(1, 'block')", "(None, 'allow')"]
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    assert url_filter.judge_urls(pages, rules.limit(0)).count() == 3


def test_chat_masks_cover_the_speaker(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo\nyo"), (1, 3, "ann", None), (1, 3, "ann", None), (1, None, None, "?"), (None, 0, "ann", "lost"), (2, 0, "system", "alone")]
    out = {r.participant: r for r in chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("mask", F.lit(1))).collect()}
    assert set(out) == {"ann", "bob", "unknown"}
    ann = out["ann"]
    assert (ann.n_messages, ann.n_trained) == (5, 2)
    assert [ann.rendered[m.start : m.end] for m in ann.mask] == ["hi<|im_end|>", "<|im_end|>"]
    assert ann.rendered.startswith("<|im_start|>user name=unknown\n?<|im_end|>\n<|im_start|>system\nbe kind") and "<|im_start|>assistant\nhi" in ann.rendered
    assert "user name=ann" in out["bob"].rendered


def _dialogue(spark, tmp_path, rows):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = pytest.importorskip("duckdb").connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    return con


def _brute_rendering(messages, who):
    """Text and trained pieces of a whole dialogue, straight from its messages."""
    text, trained = "", []
    for _, role, body in messages:
        name = "system" if role == "system" else "assistant" if role == who else f"user name={role}"
        text += f"<|im_start|>{name}\n"
        if role == who:
            trained.append((len(text), len(text) + len(body) + 10))
        text += f"{body}<|im_end|>\n"
    return text, trained


def test_chat_renders_a_thousand_turns_whole_for_every_participant(spark):
    # a speaks at first only, b later only, and the system once, at the start.
    rows = [(1, 0, "system", "be kind")] + [(1, t, "a" if t < 400 else "b", f"t{t}é" * (t % 5)) for t in range(1, 1000)]
    out = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("block").collect()
    for who in ("a", "b"):
        own = [r for r in out if r.participant == who]
        text, trained = _brute_rendering([r[1:] for r in rows], who)
        assert [r.block for r in own] == [0, 1, 2, 3] and [r.n_messages for r in own] == [256, 256, 256, 232]
        assert "".join(r.rendered for r in own) == text
        assert [(m.start, m.end) for r in own for m in r.mask] == trained
        assert [text[r.start : r.start + len(r.rendered)] for r in own] == [r.rendered for r in own]


def test_chat_of_ties_and_long_conversations_equals_the_sql(spark, tmp_path):
    roles = ["system", "ann", "bob", "eve"]
    rows = [(1, None if i % 3 else i % 7, roles[i % 3], f"m{i * 7919 % 1409}") for i in range(1400)] + [(1, 5, "eve", "once"), (1, 300, "ann", "later"), (2, 0, "bob", "hi"), (2, 1, "ann", None), (3, 0, "ann", "long " * 200_000), (3, 1, "bob", "short")]
    con = _dialogue(spark, tmp_path, rows)
    columns, want = duck_rows(con, chat.SQL)
    got = chat.op8_chat(spark, str(tmp_path))
    assert sorted(got.columns) == columns and spark_rows(got) == want
    assert got.filter("conv_id = 1 AND participant = 'eve'").agg(F.max("block"), F.sum("n_messages")).first() == (5, len({r[1:] for r in rows if r[0] == 1}))


def test_chat_does_not_depend_on_partitions_and_takes_nothing(spark):
    rows = spark.range(3000).select((F.col("id") % 2).alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.concat(F.lit("r"), F.col("id") % 3).alias("role"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    assert spark_rows(chat.rotate(rows.repartition(1), 100)) == spark_rows(chat.rotate(rows.repartition(7), 100))
    assert chat.rotate(rows, 100).agg(F.max("n_messages"), F.sum("n_trained")).first() == (100, 3000)
    assert chat.rotate(rows.limit(0)).count() == 0


def test_sha_is_of_the_normalised_text(spark):
    row = exact_dedup.exact_dedup(_docs(spark, (1, "é \t b"))).first()
    assert bytes(row.digest).hex() == hashlib.sha256("é b".encode()).hexdigest()
