"""Language ID by Bayesian evidence fusion.

Evidence of a document, all as log probabilities per language, added up:

* text: byte trigrams of its letters, under one smoothed trigram distribution per language. Each trigram of a text
  counts LETTER, a third, as every letter is in three of them;
* the declared markup language and the address suffix (a path segment or top-level domain): how often each value
  goes with each language, learned from the corpus itself by grouped sums of the text-only probabilities;
* the host: a prior per language from the same sums, smoothed towards its domain's, and that towards the
  corpus's, each with the weight of STRENGTH documents.

Beside the labelled languages there is one class for what is none of them, under which all trigrams are equally
likely. A text that it explains best has no language.

Every language that a label names is learned, from every labelled row; every value, suffix, domain and host counts.
The trigram distributions stay a table: documents are scored against LANGS_AT_ONCE languages at a time, one pass of
the texts for each such block, so memory does not grow with the languages. Sums of values and hosts stay distributed
and are joined by a shuffle, or by broadcast where a count shows that there are at most BROADCAST_CELLS numbers. Only
the names of languages and one number for each reach the driver, and a block's distributions on their way out.

Defined results for the unusual: a null or empty text gives no text evidence; null or empty declarations, suffixes
and hosts and those that no document with text shares give none either; without any evidence the language is null,
probability 0; a text that fits no language has a null language and the probability of that; ties go to the
alphabetically first language; rows with null or empty labels are not learned from; texts of any length are read whole;
repeated rows count and are returned each; without labelled rows every language is null; an empty table gives an
empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, table, text_batches, written
from .words import text_bytes

BINS = 1 << 16
#: Weight of one trigram: a letter is in three of them.
LETTER = 1 / 3
#: Languages whose trigram distributions (a quarter of a MB each) a worker holds at a time.
LANGS_AT_ONCE = 64
STRENGTH = 20.0
#: Numbers in a table of values or hosts up to which it is broadcast: 16 MB.
BROADCAST_CELLS = 2_000_000
#: Evidence other than text and host counts only this much, so that a false declaration cannot outweigh a clear text.
TRUST = 0.5

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def trigram_bins(text: str | None) -> np.ndarray:
    """Bins of the byte trigrams of a text's letters, case of A-Z folded; every other run is one space."""
    raw = b" ".join(text_bytes(text).translate(_FOLD).split())
    if not raw:
        return np.zeros(0, np.int64)
    x = np.frombuffer(b" " + raw + b" ", dtype=np.uint8).astype(np.uint32)
    code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


#: Rows of an Arrow batch whose texts are Python objects at a time.
SLICE = 500


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts per label, handed on whenever LANGS_AT_ONCE labels are held."""
    sums: dict[str, np.ndarray] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, x in sums.items():
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(x[at])], names=["lang", "bin", "n"])
        sums.clear()

    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if lang not in sums:
                    if len(sums) == LANGS_AT_ONCE:
                        yield from out()
                    sums[lang] = np.zeros(BINS, np.int64)
                bins = trigram_bins(text)
                if len(bins):
                    sums[lang] += np.bincount(bins, minlength=BINS)
    yield from out()


class TextModel:
    """Log probabilities of trigram bins per language, kept as a table of counts (lang, bin, n)."""

    def __init__(self, langs: list[str], counts: DataFrame | None):
        self.langs, self.counts = langs, counts

    @classmethod
    def fit(cls, labelled: DataFrame, lang_col: str = "lang", text_col: str = "text") -> TextModel:
        """Counts over every labelled row, of every language."""
        rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang IS NOT NULL AND lang <> ''")
        with text_batches(labelled.sparkSession):
            counts = rows.mapInArrow(_count, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
            counts = written(counts, "trigrams")
        return cls(sorted(r["lang"] for r in counts.select("lang").distinct().collect()), counts)

    def block(self, at: int) -> np.ndarray:
        """(languages, BINS) log probabilities of LANGS_AT_ONCE languages from position `at`; the last block has one more."""
        langs = self.langs[at : at + LANGS_AT_ONCE]
        counts = self.counts.filter(F.col("lang").isin(langs)).toPandas()
        smoothed = np.full((len(langs), BINS), 0.5)
        for lang, part in counts.groupby("lang"):
            smoothed[langs.index(lang), part["bin"].to_numpy()] += part["n"].to_numpy()
        logs = np.log(smoothed / smoothed.sum(axis=1, keepdims=True)).astype(np.float32)
        if at + LANGS_AT_ONCE < len(self.langs):
            return logs
        # Behind the last language the class of none, to which all bins are equally likely.
        return np.vstack([logs, np.full((1, BINS), -math.log(BINS), np.float32)])


def evidence(text: str | None, logs: np.ndarray) -> list[float] | None:
    """Log likelihood of a text's trigrams per language of a block; None for no trigram."""
    bins = trigram_bins(text)
    if not len(bins):
        return None
    sums = np.zeros(len(logs))
    for at in range(0, len(bins), 1 << 16):
        sums += logs[:, bins[at : at + (1 << 16)]].sum(axis=1, dtype=np.float64)
    return (sums * LETTER).tolist()


def _scorer(logs: np.ndarray, last: bool):
    """Adds to each row, whose last column is its text, a list of evidence; the text itself goes if `last`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                found = pa.array([evidence(t, logs) for t in part.column(part.num_columns - 1).to_pylist()], pa.list_(pa.float64()))
                keep = part.num_columns - 1
                tail, names = ([], []) if last else ([part.column(keep)], [part.schema.names[keep]])
                yield pa.RecordBatch.from_arrays([*part.columns[:keep], found, *tail], names=[*part.schema.names[:keep], "found", *names])

    return run


def _with_evidence(rows: DataFrame, model: TextModel, keep_text: bool) -> DataFrame:
    """rows, whose last column is a text, written with a column logs: evidence per language, then of no language."""
    text = rows.columns[-1]
    blocks = range(0, len(model.langs), LANGS_AT_ONCE)
    for k, at in enumerate(blocks):
        drop = at == blocks[-1] and not keep_text
        kept = [f for f in rows.schema if f.name != text]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", found array<double>" + ("" if drop else f", `{text}` string")
        before = rows
        with text_batches(rows.sparkSession):
            rows = written(rows.mapInArrow(_scorer(model.block(at), drop), schema).withColumnRenamed("found", f"logs_{k}"), "evidence")
        if k:
            discard(before)
    if not keep_text and not len(blocks):
        rows = rows.drop(text)
    if not len(blocks):
        return rows
    return rows.withColumn("logs", F.concat(*[F.col(f"logs_{k}") for k in range(len(blocks))])).drop(*[f"logs_{k}" for k in range(len(blocks))])


def _normalised(logs: Column) -> Column:
    """Log scores to probabilities."""
    top = F.array_max(logs)
    powers = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda s, x: s + x)
    return F.transform(powers, lambda x: x / total)


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _joined(rows: DataFrame, side: DataFrame, key: str, width: int) -> DataFrame:
    """Left join on key, by broadcast only where a count shows the side, a written table, to be small."""
    most = max(1, BROADCAST_CELLS // width)
    few = side.limit(most + 1).count() <= most
    return rows.join(F.broadcast(side) if few else side.hint("merge"), key, "left")


def identify(docs: DataFrame, model: TextModel, id_col: str, text: Column, declared: Column, suffix: Column, host: Column, domain: Column, keep: tuple[str, ...] = (), keep_text: str | None = None) -> DataFrame:
    """(id, lang, probability, text_lang, *keep) per row of docs, with the text under the name keep_text if that is given."""
    langs = model.langs
    carried = [*keep, *([keep_text] if keep_text else [])]
    picked = docs.select(F.col(id_col).alias("id"), *keep, declared.alias("declared"), suffix.alias("suffix"), host.alias("host"), domain.alias("domain"), text.alias(keep_text or "__text"))
    rows = _with_evidence(picked, model, bool(keep_text))
    if not langs:
        none = F.lit(None).cast("string")
        return rows.select("id", none.alias("lang"), F.lit(0.0).alias("probability"), none.alias("text_lang"), *carried)
    n = len(langs) + 1
    zeros = F.array_repeat(F.lit(0.0), n)
    rows = rows.withColumn("p", _normalised(F.col("logs")))
    # One row per document and class from here on, summed where it stands before it moves.
    each = rows.filter("p IS NOT NULL").select("declared", "suffix", "host", "domain", F.posexplode("p").alias("k", "mass"))

    def sums(*key: str) -> DataFrame:
        """(*key, mass array<double>, rows): summed probabilities of the documents that have a key."""
        held = each.filter(F.col(key[0]).isNotNull() & (F.col(key[0]) != "")).groupBy(*key, "k").agg(F.sum("mass").alias("mass"))
        listed = held.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("k", "mass"))).alias("m"), F.sum("mass").alias("rows"))
        return listed.select(*key, F.transform("m", lambda x: x["mass"]).alias("mass"), "rows")

    total = dict(each.groupBy("k").agg(F.sum("mass")).collect())
    base = np.array([total.get(k, 0.0) for k in range(n)]) + 1.0
    whole = F.array(*[F.lit(x) for x in (base / base.sum()).tolist()])

    def value_logs(key: str) -> DataFrame:
        """(key, key_logs): log P(value | language), smoothed by one document of each value."""
        mass = written(sums(key), "values")
        of = {r["k"]: r for r in mass.select(F.posexplode("mass").alias("k", "m")).groupBy("k").agg(F.sum("m").alias("m"), F.count(F.lit(1)).alias("v")).collect()}
        totals = F.array(*[F.lit((of[k]["m"] + of[k]["v"]) if k in of else 1.0) for k in range(n)])
        logs = F.zip_with("mass", totals, lambda m, t: F.log((m + 1.0) / t) * TRUST)
        return written(mass.select(key, logs.alias(f"{key}_logs")), "values")

    # The hierarchy of priors: corpus, domain, host. Each level's mass is smoothed towards the level above.
    def smoothed(up: Column) -> Column:
        return F.transform(F.zip_with("mass", up, lambda m, u: m + u * STRENGTH), lambda m: m / (F.col("rows") + STRENGTH))

    domains = written(sums("domain").select("domain", smoothed(whole).alias("above")), "domains")
    hosts = _joined(sums("host", "domain"), domains, "domain", n).withColumn("above", F.coalesce("above", whole))
    # A host has one domain, by its address; where a caller gives it several, its largest stands.
    hosts = hosts.groupBy("host").agg(F.max_by(smoothed(F.col("above")), F.struct("rows", "domain")).alias("prior"))
    rows = _joined(rows, written(hosts, "hosts"), "host", n)
    for key in ("declared", "suffix"):
        rows = _joined(rows, value_logs(key), key, n)
    prior = F.transform(F.coalesce("prior", whole), lambda x: F.log(x))
    found = _plus(_plus(F.coalesce("logs", zeros), prior), _plus(F.coalesce("declared_logs", zeros), F.coalesce("suffix_logs", zeros)))
    # The last class has no name.
    named = F.array(*[F.lit(x) for x in langs], F.lit(None).cast("string"))
    first = lambda p: F.element_at(named, F.array_position(p, F.array_max(p)).cast("int"))
    some = F.col("logs").isNotNull() | F.col("prior").isNotNull() | F.col("declared_logs").isNotNull() | F.col("suffix_logs").isNotNull()
    rows = rows.withColumn("post", _normalised(found))
    return rows.select(
        "id",
        F.when(some, first(F.col("post"))).alias("lang"),
        F.when(some, F.array_max("post")).otherwise(0.0).alias("probability"),
        F.when(F.col("p").isNotNull(), first(F.col("p"))).alias("text_lang"),
        *carried,
    )


def markup_text(html: Column) -> Column:
    """Text of a page: without comments, scripts, styles and tags; entities as spaces."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>|&[a-z#0-9]+;", " ")
    return bare


def declared_language(html: Column) -> Column:
    """Primary subtag of the root element's lang attribute, in lower case; null without one."""
    found = F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)", 1))
    return F.when(found != "", found)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, with trigrams learned from every labelled document."""
    from .url_filter import host_of, path_of

    model = TextModel.fit(table(spark, sf_dir, "documents"))
    pages = table(spark, sf_dir, "pages").withColumn("host", host_of(F.col("url")))
    labels = F.split("host", r"\.")
    domain = F.when(F.size(labels) > 2, F.array_join(F.slice(labels, F.size(labels) - 1, 2), ".")).otherwise(F.col("host"))
    # The suffix is a language code at the start of the path, else the top-level domain.
    code = F.regexp_extract(path_of(F.col("url")), r"^/([a-z]{2})(?:/|$)", 1)
    suffix = F.when(code != "", code).otherwise(F.element_at(labels, -1))
    found = identify(pages, model, "page_id", markup_text(F.col("html")), declared_language(F.col("html")), suffix, F.col("host"), domain)
    return found.select(F.col("id").alias("page_id"), "lang", F.round("probability", 6).alias("probability"), "text_lang")


def accepted(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs whose language is found with probability `least`: the label is the declaration, the source the host.

    Rows without a single letter have no text evidence and are rejected, as are rows that stay undecided or fit none.
    """
    model = TextModel.fit(docs)
    columns = docs.columns
    # Columns travel under names of their own, so that none clashes with those of the evidence.
    renamed = docs.select(F.lit(0).alias("__id"), *[F.col(f"`{c}`").alias(f"doc_{k}") for k, c in enumerate(columns)])
    own = {c: f"doc_{k}" for k, c in enumerate(columns)}
    none = F.lit(None).cast("string")
    rest = tuple(own[c] for c in columns if c != "text")
    found = identify(renamed, model, "__id", F.col(own["text"]), F.col(own["lang"]), none, F.col(own["source"]), none, keep=rest, keep_text=own["text"])
    stay = (F.col("probability") >= least) & F.col("lang").isNotNull() & F.col("text_lang").isNotNull()
    return found.filter(stay).select(*[F.col(own[c]).alias(c) for c in columns])
