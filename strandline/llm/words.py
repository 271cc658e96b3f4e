"""Words and their hashes in numpy: the shared ground of shingles, windows and language models.

A word is a maximal run of bytes other than the six ASCII white-space characters; bytes.split() cuts UTF-8
exactly there. A word's hash is 64 bits of XXH3, looked up in a dictionary of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

_C1 = np.uint64(0xFF51AFD7ED558CCD)
_C2 = np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)
#: Odd multiplier of the polynomial hash over word hashes.
BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3: a bijection that spreads every bit."""
    x = x ^ (x >> _S)
    x = x * _C1
    x ^= x >> _S
    x *= _C2
    x ^= x >> _S
    return x


def text_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


class WordHashes(dict):
    """Word (bytes) to signed 64-bit hash. Beyond `limit` words nothing more is kept, so memory is bounded."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        value -= (value >> 63) << 64
        if len(self) < self.limit:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words)).view(np.uint64)


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` consecutive words, in log2(width) vector steps; empty if there are fewer."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    done, covered, power, have = None, 0, hashes, 1
    factor = BASE
    rest = width
    # Binary decomposition of the width: `power` holds the hashes of runs of `have` words.
    while rest:
        if rest & 1:
            if done is None:
                done, covered = power, have
            else:
                # run(covered) followed by run(have)
                m = len(hashes) - covered - have + 1
                done = done[:m] * factor + power[covered : covered + m]
                covered += have
        rest >>= 1
        if rest:
            m = len(hashes) - 2 * have + 1
            power = power[:m] * factor + power[have : have + m]
            have *= 2
            factor = np.uint64(int(factor) ** 2 % 2**64)
    return mixed(done[:n])


def in_chunks(rows: Iterable[tuple], weight: int, weigh) -> Iterator[list[tuple]]:
    """Consecutive rows in lists of about `weight` in all, so that what is held at once is bounded."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += weigh(row)
        if total >= weight:
            yield held
            held, total = [], 0
    if held:
        yield held
