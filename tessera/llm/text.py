"""Whole texts as bytes in numpy: words, hashes, and slices of Arrow batches with bounded bytes."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are handled at once; a longer text goes alone. The arrays over it take up to a hundred times as much.
SLICE_BYTES = 1 << 18

#: Bytes of an Arrow batch between Spark and Python.
BATCH_BYTES = 2 << 20

#: Calls that free what an operator's tasks remember from one to the next. Workers live on; another operator's task makes the calls.
FORGET: list[Callable[[], None]] = []


def bounded(df: DataFrame) -> DataFrame:
    """df, whose session hands Python batches of a few megabytes: batches of so many rows would be of any size."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    set_to = str(conf.get(key)).rstrip("bB")
    if not set_to.isdigit() or not 0 < int(set_to) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def packed(docs: DataFrame, *more: Column | str) -> DataFrame:
    """docs with all columns in one, row, beside more: no name that an operator adds can clash with theirs. select("row.*") gives docs back."""
    return docs.select(F.struct("*").alias("row"), *more)


WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

#: What parts terms: every ASCII character but letters, and every one but letters and digits.
NO_LETTER = np.zeros(256, bool)
NO_LETTER[:0x80] = ~np.array([chr(c).isalpha() for c in range(0x80)])
NO_LETTER_OR_DIGIT = NO_LETTER.copy()
NO_LETTER_OR_DIGIT[0x30:0x3A] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_rng = np.random.default_rng(20240229)
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        grown = np.full(max(n, 1 << 16), base, np.uint64)
        grown[0] = 1
        _powers[base] = have = np.multiply.accumulate(grown)
        if n > SLICE_BYTES * 4:
            del _powers[base]
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def trim() -> None:
    """Gives freed memory back to the system; workers live on between stages and would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has the call
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """batch in parts with at most limit bytes of text each."""
    while FORGET:
        FORGET.pop()()
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, at = np.cumsum(size), 0
    while at < len(size):
        before = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, before + limit, "right")))
        yield batch.slice(at, end - at)
        at = end
    trim()


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: none), and where each begins, with the end at last."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


class Words:
    """The words of texts: start, end, document and 64-bit hash of each, and each document's first word.

    A word is a longest run of bytes that are not `apart` (white space, unless told otherwise); lower takes A-Z as a-z.
    """

    def __init__(self, texts: pa.Array, apart: np.ndarray = WHITE, lower: bool = False):
        self.data, self.off = raw(texts)
        if lower:
            self.data = LOWER[self.data]
        word = ~apart[self.data]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        full = self.off[:-1] < self.off[1:]
        at, to = self.off[:-1][full], self.off[1:][full] - 1
        first[at], last[to] = word[at], word[to]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, self.off)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self) -> np.ndarray:
        """Equal words have equal hashes; two unequal words collide with odds of about 2^-64."""
        n = len(self.data)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUE[self.data] * _powers_of(_BASE, n), out=total[1:])
        return mix((total[self.end] - total[self.start]) * _powers_of(_INVERSE, n)[self.start]) if n else total[:0]


def windows(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each k words in a row within a document, and each document's first window. A document of 1 to k - 1 words has one window, of all of them."""
    count = np.diff(first)
    n = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    begin = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(first[:-1] - begin[:-1], n) + np.arange(begin[-1])
    end = np.repeat(first[1:], n)
    out = np.full(len(at), 0x2545F4914F6CDD1D, np.uint64)
    for j in range(k):
        use = at + j < end
        step = hashes[np.where(use, at + j, 0)] if len(hashes) else out
        out = np.where(use, mix(out * np.uint64(0xD6E8FEB86659FD93) + step), out)
    return out, begin
