"""BPE encoding and decoding with a byte-level vocabulary file (tokenizers JSON), by a contiguous rank array.

A text is cut at added tokens, then into pre-tokens by the byte-level pattern. A word's parts lie in one array
and the ranks of adjacent parts in another; the least rank is found by a scan, its boundary deleted and the two
neighbouring ranks refreshed. Words of more than LONG parts, for which scans would be quadratic, keep the ranks
in a heap instead. Distinct words are encoded once per Python worker, in a cache of bounded size.

The vocabulary's path is a parameter; the driver reads the file and broadcasts it (fixed size: the vocabulary).

Defined results for the unusual: a null text is the empty text, which has no tokens; a null id stays null;
repeated rows are encoded each; an empty table gives an empty result; other columns are ignored. Texts of any
length are encoded whole.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: White space as the pre-tokenizer's \s has it (Unicode White_Space).
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Code points that the regex module's newer Unicode tables count as letters or numbers, while
#: those of the tokenizers library count them as neither (found by asking both for every code point).
NEWER = """
    558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A
    11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 16FF4-16FF6 187F8-187FF 18CD6-18CDA
    18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE
    1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""


def _pattern() -> regex.Pattern:
    """The byte-level pre-tokenizer's pattern, its classes spelt out as sets."""
    newer = "".join("-".join(f"\\U{int(x, 16):08x}" for x in r.split("-")) for r in NEWER.split())
    letter, number = rf"[\p{{L}}--[{newer}]]", rf"[\p{{N}}--[{newer}]]"
    other = rf"[[^{SPACE}\p{{L}}\p{{N}}][{newer}]]"
    return regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


WORD = _pattern()
_DOUBLE = re.compile(rf"[{SPACE}][{SPACE}]")
LONG = 128
CACHE = 250_000
_FAR = 1 << 60


def byte_alphabet() -> dict[int, str]:
    """Byte to the printable character that stands for it in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """ranks: (left id, right id) to rank; merged: id by rank; tokens: bytes by id; added: contents with their own ids."""

    ranks: dict[tuple[int, int], int]
    merged: list[int]
    tokens: list[bytes]
    byte_ids: list[int]
    added: dict[str, int] = field(default_factory=dict)

    @classmethod
    def from_json(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError(f"{path}: only byte-level BPE without prefix space, normalizer or fallbacks is read")
        of_char = {c: b for b, c in byte_alphabet().items()}
        vocab: dict[str, int] = model["vocab"]
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens must be plain")
        tokens = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        for token, i in (vocab | added).items():
            known = all(c in of_char for c in token)
            tokens[i] = bytes(of_char[c] for c in token) if known else token.encode()
        ranks, merged = {}, []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            ranks.setdefault((vocab[left], vocab[right]), rank)
            merged.append(vocab[left + right])
        return cls(ranks, merged, tokens, [vocab[c] for _, c in sorted(byte_alphabet().items())], added)


def merge_short(parts: list[int], ranks: dict, merged: list[int]) -> list[int]:
    """Parts of one word after all merges: scan for the least rank, delete its boundary, refresh its neighbours."""
    rank_of = ranks.get
    near = [rank_of(pair, _FAR) for pair in zip(parts, parts[1:])]
    while near:
        best = min(near)
        if best == _FAR:
            break
        k = near.index(best)
        parts[k] = new = merged[best]
        del parts[k + 1], near[k]
        if k:
            near[k - 1] = rank_of((parts[k - 1], new), _FAR)
        if k < len(near):
            near[k] = rank_of((new, parts[k + 1]), _FAR)
    return parts


def merge_long(parts: list[int], ranks: dict, merged: list[int]) -> list[int]:
    """The same for long words: ranks in a heap, boundaries in a linked list."""
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(rank, k, pair) for k, pair in enumerate(zip(parts, parts[1:])) if (rank := ranks.get(pair)) is not None]
    heapq.heapify(heap)

    def offer(k: int) -> None:
        pair = (parts[k], parts[after[k]])
        if (rank := ranks.get(pair)) is not None:
            heapq.heappush(heap, (rank, k, pair))

    while heap:
        rank, k, pair = heapq.heappop(heap)
        j = after[k]
        if not alive[k] or j >= n or (parts[k], parts[j]) != pair:
            continue
        parts[k], alive[j], after[k] = merged[rank], False, after[j]
        if after[k] < n:
            before[after[k]] = k
            offer(k)
        if before[k] >= 0:
            offer(before[k])
    return [x for x, ok in zip(parts, alive) if ok]


class _Cache(dict):
    """Piece of text to its ids as little-endian int32 bytes; ahead: what stands before each piece."""

    def __init__(self, encode, ahead: str, limit: int):
        super().__init__()
        self.encode, self.ahead, self.limit = encode, ahead, limit

    def __missing__(self, piece: str) -> bytes:
        out = self.encode(self.ahead + piece)
        if len(self) < self.limit and len(piece) <= 32:
            self[piece] = out
        return out


class Encoder:
    """Encodes texts with one vocabulary. A piece is a context-free stretch of text, and is encoded once."""

    def __init__(self, vocabulary: Vocabulary, limit: int = CACHE):
        self.v = vocabulary
        self.word = _Cache(self.merge, "", limit)
        self.bare, self.spaced = _Cache(self.words, "", limit // 8), _Cache(self.words, " ", limit)
        self.line_end = self.words("\n")
        self.added = regex.compile("|".join(regex.escape(x) for x in sorted(vocabulary.added, key=len, reverse=True))) if vocabulary.added else None

    def words(self, piece: str) -> bytes:
        found = WORD.findall(piece)
        return self.word[found[0]] if len(found) == 1 else b"".join(map(self.word.__getitem__, found))

    def merge(self, word: str) -> bytes:
        parts = list(map(self.v.byte_ids.__getitem__, word.encode("utf-8", "surrogatepass")))
        if len(parts) > 1:
            parts = (merge_short if len(parts) <= LONG else merge_long)(parts, self.v.ranks, self.v.merged)
        return array("i", parts).tobytes()

    def segment(self, text: str) -> bytes:
        """Ids of a text without added tokens."""
        if _DOUBLE.search(text) is not None:
            return b"".join([self.bare[m.group()] for m in WORD.finditer(text)])
        # White space stands alone everywhere: a space belongs to the piece behind it, a line end is a token.
        out: list[bytes] = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            out.append(self.bare[first])
            out += map(self.spaced.__getitem__, rest)
            out.append(self.line_end)
        return b"".join(out[:-1])

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.added is None or not any(x in text for x in self.v.added):
            return self.segment(text)
        out, at = [], 0
        for m in self.added.finditer(text):
            out += [self.segment(text[at : m.start()]), np.int32(self.v.added[m.group()]).tobytes()]
            at = m.end()
        return b"".join([*out, self.segment(text[at:])])


#: Encoders that this Python worker has made, by vocabulary path: the next task goes on with the same cache.
_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str, shared) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(shared.value)
    return _ENCODERS[path]


def decode_ids(ids: list[int], tokens: list[bytes]) -> str:
    """The text of ids: their bytes as UTF-8, each maximal invalid part as U+FFFD."""
    return b"".join(map(tokens.__getitem__, ids)).decode("utf-8", "replace")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) per row."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.from_json(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, shared)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [encoder.encode(t) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *[len(x) // 4 for x in found]], dtype=np.int64)
                if ends[-1] >= 2**31:
                    raise ValueError("a batch has more than 2^31 tokens; lower spark.sql.execution.arrow.maxRecordsPerBatch")
                values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(found))])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)], names=["id", "ids"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded (id, ids) with a column text, decoded from ids; null ids give a null text."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.from_json(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value.tokens
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = part.column(1)
                # flatten() leaves out what null rows may hide, so lengths come from the rows.
                flat, ends = ids.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *ids.value_lengths().fill_null(0).to_pylist()])
                texts = [decode_ids(flat[a:b].tolist(), tokens) if x else None for a, b, x in zip(ends, ends[1:], ids.is_valid().to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["id", "ids", "text"])

    return encoded.select("id", "ids").mapInArrow(run, f"id {encoded.schema['id'].dataType.simpleString()}, ids array<int>, text string")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed package of public vocabularies keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary_path()
    both = decode(encode(table(spark, sf_dir, "documents"), path), path)
    listed = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return both.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
