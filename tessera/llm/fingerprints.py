"""Document fingerprints by one-permutation MinHash with optimal densification and packed low-order bits.

The words of a text give shingles of five words (fewer words: one shingle of all). Each shingle is hashed once; the upper
bits of the hash name one of the bins, the rest is its value, and a bin keeps its least value. An empty bin copies a full
one, found by a hash of the bin and the attempt that is the same for every document (optimal densification), so that the
odds that two documents agree in a bin stay their Jaccard similarity. The low-order bits of each bin are packed; unequal
values agree in b bits with odds 2^-b, and `likeness` takes that out again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import Words, bounded, mix, slices, windows

BINS, BITS, SHINGLE = 512, 4, 5
#: Rows of a key range of the sorted pass, and the most ranges; beyond, ranges grow (they are read as a stream).
RANGE_ROWS, MOST_RANGES = 2_000, 20_000
#: Bytes of text that are fingerprinted at once.
PART = 1 << 20
_EMPTY = np.uint64(2**64 - 1)


def _probe(bins: np.ndarray, attempt: int, n: int) -> np.ndarray:
    return (mix(bins.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) % np.uint64(n)).astype(np.int64)


def bin_values(texts: pa.Array, bins: int = BINS, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(documents x bins) least values after densification, and whether each document has a word. bins: a power of two."""
    words = Words(texts)
    h, first = windows(words.hashes(), words.first, shingle)
    shift = np.uint64(64 - bins.bit_length() + 1)
    docs = len(words.count)
    least = np.full(docs * bins, _EMPTY, np.uint64)
    at = np.repeat(np.arange(docs), np.diff(first)) * bins + (h >> shift).astype(np.int64)
    np.minimum.at(least, at, h & ((np.uint64(1) << shift) - np.uint64(1)))
    least = least.reshape(docs, bins)
    full, has = least != _EMPTY, words.count > 0
    out = least.copy()
    doc, empty = np.nonzero(~full & has[:, None])
    attempt = 0
    while len(doc):
        attempt += 1
        source = _probe(empty, attempt, bins)
        found = full[doc, source]
        out[doc[found], empty[found]] = least[doc[found], source[found]]
        doc, empty = doc[~found], empty[~found]
    return out, has


def pack(values: np.ndarray, has: np.ndarray, bits: int = BITS) -> list[str]:
    """Hexadecimal fingerprints; empty where a text has no word. bits: 1, 2, 4 or 8."""
    low = (values & np.uint64(2**bits - 1)).astype(np.uint8)
    spread = np.unpackbits(low[:, :, None], axis=2)[:, :, 8 - bits :].reshape(len(low), -1)
    packed = np.packbits(spread, axis=1)
    return [p.tobytes().hex() if h else "" for p, h in zip(packed, has, strict=True)]


def fingerprints_of(texts: pa.Array, bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE) -> list[str]:
    return pack(*bin_values(texts, bins, shingle), bits)


def likeness_of(a: str, b: str, bits: int = BITS) -> float:
    """Estimated Jaccard similarity, without the agreement that chance gives; two texts without words are alike, one is not like any other."""
    if not a or not b:
        return float(a == b)
    x, y = (np.frombuffer(bytes.fromhex(s), np.uint8) for s in (a, b))
    differ = np.unpackbits(x ^ y).reshape(-1, bits).any(axis=1).mean()
    chance = 2.0**-bits
    return float(min(1.0, max(0.0, (1 - differ - chance) / (1 - chance))))


def fingerprint(text: str = "text", bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE) -> Column:
    """The fingerprint of a column of whole texts; null texts count as empty."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string(), from_pandas=True)], ["t"])
        return pd.Series([f for part in slices(batch, "t", PART) for f in fingerprints_of(part.column(0), bins, bits, shingle)], dtype="object")

    return run(F.coalesce(F.col(text), F.lit("")))


def likeness(a: str, b: str, bits: int = BITS) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([likeness_of(s, t, bits) for s, t in zip(x, y, strict=True)], dtype="float64")

    return run(F.coalesce(F.col(a), F.lit("")), F.coalesce(F.col(b), F.lit("")))


def _in_ranges(docs: DataFrame) -> DataFrame:
    """(range, foreign, doc_id, tie, text): the documents in ranges of descending doc_id, with the head of the next range, flagged foreign, at the end of each.

    The bounds of the ranges (one for some thousand rows, at most MOST_RANGES) and their heads are all that reaches the
    driver. An id with more rows than a range is cut into ranges by the hash of the text, the order of rows of one id.
    """
    lowest = -(2**63)
    keyed = bounded(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("k"), "doc_id", F.coalesce("text", F.lit("")).alias("text")).select("k", "doc_id", "text", F.xxhash64("text").alias("tie"))
    n = docs.count()
    ranges = min(MOST_RANGES, 1 + n // RANGE_ROWS)
    cuts = keyed.agg(F.percentile_approx("k", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] if ranges > 1 and n else None
    bounds, times = np.unique(np.array(cuts or [], np.int64), return_counts=True)
    # an id that is a bound several times over has a range of its own and shares of it; ids between bounds share one range
    parts = np.where(times > 1, times, 0)
    first = np.concatenate([[0], np.cumsum(1 + parts[::-1])])

    @F.pandas_udf("int")
    def range_of(k: pd.Series, tie: pd.Series) -> pd.Series:
        k, tie = k.to_numpy(np.int64), tie.to_numpy(np.int64)
        above = len(bounds) - np.searchsorted(bounds, k, "left")  # bounds at k or over it
        out = first[above]
        if len(bounds):
            at = np.minimum(np.searchsorted(bounds, k), len(bounds) - 1)
            hot = (bounds[at] == k) & (parts[at] > 0)
            share = ((tie.astype(np.float64) / 2.0**64 + 0.5) * parts[at]).astype(np.int64)
            out = np.where(hot, first[len(bounds) - 1 - at] + 1 + np.minimum(share, parts[at] - 1), out)
        return pd.Series(out, dtype="int32")

    order = F.struct((-F.when(F.col("k") > lowest, F.col("k"))).alias("down"), "tie")
    heads = keyed.select("k", "tie", range_of("k", "tie").alias("range")).groupBy("range").agg(F.min_by(F.struct("k", "tie"), F.struct(F.col("k") == lowest, order)).alias("head")).collect()
    heads = {r[0]: tuple(r[1]) for r in heads}
    filled = sorted(heads)
    before = {heads[r]: filled[i - 1] for i, r in enumerate(filled)}
    heads_k = np.array(sorted({k for k, _ in before}), np.int64)

    @F.pandas_udf("int")
    def also(k: pd.Series, tie: pd.Series) -> pd.Series:
        out = np.full(len(k), -1, np.int32)
        ks = k.to_numpy(np.int64)
        if len(heads_k):
            for i in np.flatnonzero(heads_k[np.minimum(np.searchsorted(heads_k, ks), len(heads_k) - 1)] == ks):
                out[i] = before.get((int(ks[i]), int(tie.iat[i])), -1)
        return pd.Series(out)

    places = F.filter(F.array(F.struct(range_of("k", "tie").alias("range"), F.lit(False).alias("foreign")), F.struct(also("k", "tie").alias("range"), F.lit(True).alias("foreign"))), lambda x: x["range"] >= 0)
    rows = keyed.withColumn("place", F.explode(places)).select("place.range", "place.foreign", "k", "doc_id", "tie", "text")
    return rows.repartition("range").sortWithinPartitions("range", "foreign", F.desc("k"), "tie")


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, next_doc_id long"


def fingerprint_edits(docs: DataFrame, bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and the likeness to the next document.

    Documents are in descending order of doc_id, null last, repeated ids by a hash of the text. The edited text is the text
    with its last floor(n/2) code points replaced by as many first ones of the next document (or all, if it has fewer);
    after the last document comes the first. Null texts are empty; a single document is its own next. Other columns of docs
    are not read. Texts are shuffled once, into ranges of doc_id; each range also gets the head of the range after it, so
    that a sorted pass over one range needs no other.
    """
    out_schema = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "next_doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, whose next one is still to come
        for batch in batches:
            for part in slices(batch, "text", PART):
                columns = [part.column(c).to_pylist() for c in ("range", "foreign", "doc_id", "text")]
                prints = fingerprints_of(part.column("text"), bins, bits, shingle)
                rows = ([held] if held else []) + list(zip(*columns, prints, strict=True))
                held = rows[-1]
                pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a[1]]
                texts = [t[: len(t) - len(t) // 2] + b[3][: len(t) // 2] for a, b in pairs for t in (a[3],)]
                edited = []
                whole = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["t"])
                for some in slices(whole, "t", PART):
                    edited += fingerprints_of(some.column(0), bins, bits, shingle)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([a[2] for a, _ in pairs], pa.int64()),
                        pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
                        pa.array([a[4] for a, _ in pairs], pa.string()),
                        pa.array(edited, pa.string()),
                        pa.array([likeness_of(a[4], e, bits) for (a, _), e in zip(pairs, edited, strict=True)], pa.float64()),
                        pa.array([likeness_of(a[4], b[4], bits) for a, b in pairs], pa.float64()),
                        pa.array([b[2] for _, b in pairs], pa.int64()),
                    ],
                    out_schema,
                )

    return _in_ranges(docs).mapInArrow(run, EDITED)
