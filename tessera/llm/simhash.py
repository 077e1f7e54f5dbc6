"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint bit is the majority of that bit over the XXH64 values of a text's word shingles. For a radius r each of the
64 positions gets a nonzero vector of r + 1 bits, and each of the 2^(r+1) - 1 nonzero vectors v gives a mask: the positions
whose vector has an odd product with v. Up to r differing positions span at most r dimensions, so some v is orthogonal to
all of them; under that mask the two fingerprints are equal. Hence every pair within the radius meets in some table, with
about half of the bits as the key, so that few others do.

Equal fingerprints are one node from the start, so copies cost nothing. The fingerprints that meet in a bucket are linked
by growing clusters: one comparison of a member with all that are left, which finds a spanning tree and no list of pairs.
A bucket with very many fingerprints is dealt out again by further sets of masks, which cover all its pairs likewise.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.copies import keep_first
from tessera.llm.text import bounded
from tessera.operators.components import connected_components
from tessera.plans.cut import cut, small

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Sets of masks at most; three of them leave some eight bits free.
LEVELS = 4
#: Rows of a table by fingerprint that may be broadcast; such tables grow with the documents.
FEW = 10_000
#: Distinct fingerprints of a bucket beyond which it is dealt out again.
BUCKET = 20_000


def shingle_hashes(words: list[bytes], k: int = SHINGLE, seed: int = SEED) -> list[int]:
    """XXH64 of every k words joined by spaces, repeats included; of all words if there are fewer, none if there are none."""
    data = b" ".join(words)
    if len(words) <= k:
        return [xxhash.xxh64_intdigest(data, seed)] if words else []
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return [digest(data[a:b], seed) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]


def fingerprint_of(text: str | None, k: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint; zero for a null text or one without words. Only ASCII letters are lower-cased and only ASCII white space parts words."""
    h = np.array(shingle_hashes((text or "").encode().lower().split(), k, seed), ">u8")
    if not len(h):
        return 0
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def simhash(text: str = "text", k: int = SHINGLE, seed: int = SEED) -> Column:
    """The fingerprint as a signed 64-bit integer."""
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint_of(t, k, seed) for t in texts], np.uint64).view(np.int64))

    return run.asNondeterministic()(F.coalesce(F.col(text), F.lit("")))  # else filters on it are pushed below and evaluate it again


def masks(radius: int = RADIUS, shift: int = 0) -> list[int]:
    """The masks of all tables, as signed 64-bit integers. shift gives each position another vector, for a second set."""
    n = (1 << (radius + 1)) - 1
    vectors = [((i * 19 + shift * (1 + i // n) + i // n) % n) + 1 for i in range(64)]
    out = [sum(1 << i for i, m in enumerate(vectors) if bin(m & v).count("1") % 2) for v in range(1, n + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def _dealt(rows: DataFrame, radius: int, level: int) -> DataFrame:
    """rows (key, f) once for each mask of the level's set, with the bucket, the table and the masked fingerprint hashed to a new key. Two buckets of one hash only are compared as one."""
    each = F.array(*[F.xxhash64("key", F.lit(level), F.lit(i), F.col("f").bitwiseAND(F.lit(m))) for i, m in enumerate(masks(radius, 7 * level))])
    return rows.select(F.explode(each).alias("key"), "f")


def cluster(found: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (member, root) that join the distinct fingerprints found wherever a chain of pairs within the radius does."""
    out, left = [], found
    while len(left) > 1:
        root, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            near = np.bitwise_count(left ^ queue.pop()) <= radius
            if near.any():
                more = left[near]
                queue += list(more)
                out += [(int(m), int(root)) for m in more]
                left = left[~near]
    return out


def _links(buckets: DataFrame, radius: int) -> DataFrame:
    """(u, v): the links of all buckets, from rows (key, f) of distinct f."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # the rows of the last bucket, which may go on

        def linked(key: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            edge = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(f)]])
            size = np.diff(edge)
            pairs = edge[:-1][size == 2]
            pairs = pairs[np.bitwise_count(f[pairs] ^ f[pairs + 1]) <= radius]
            links = [x for a, n in zip(edge[:-1][size > 2], size[size > 2], strict=True) for x in cluster(f[a : a + n], radius)]
            u, v = (np.concatenate([f[pairs + j], np.array([x[j] for x in links], np.uint64)]).view(np.int64) for j in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch in batches:
            key = batch.column("key").to_numpy()
            f = batch.column("f").to_numpy().view(np.uint64)
            if not len(f):
                continue
            same = key == key[-1]
            cut_at = len(f) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut_at:
                k = np.concatenate([*(x[0] for x in held), key[:cut_at]])
                yield linked(k, np.concatenate([*(x[1] for x in held), f[:cut_at]]))
                held = []
            elif held and held[-1][0][-1] != key[0]:
                yield linked(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held = []
            held.append((key[cut_at:], f[cut_at:]))
        if held:
            yield linked(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return buckets.repartition("key").sortWithinPartitions("key").mapInArrow(run, "u long, v long")


def near_links(fingerprints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(u, v): links that join all distinct fingerprints f (long) that chains of pairs within the radius join.

    A bucket of more than `bucket` fingerprints is dealt out by another set of masks, again and again; each set leaves
    about half of the bits free, so that buckets of LEVELS sets hold few whatever the input.
    """
    rows, found = _dealt(fingerprints.select(F.lit(0).cast("long").alias("key"), "f"), radius, 0), []
    for level in range(1, LEVELS + 1):
        hot = cut(rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > bucket))
        if level == LEVELS or hot.isEmpty():
            break
        hot = small(hot.select("key"))
        found.append(_links(rows.join(hot, "key", "left_anti"), radius))
        rows = _dealt(rows.join(hot, "key", "left_semi"), radius, level)
    return reduce(DataFrame.unionAll, [*found, _links(rows, radius)]).distinct()


def _marked(docs: DataFrame, k: int, seed: int) -> DataFrame:
    """(doc_id, th, f) of every row; th stands for the text."""
    text = F.coalesce("text", F.lit(""))
    return cut(bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), simhash("text", k, seed).alias("f")))


def _components(marked: DataFrame, radius: int) -> DataFrame:
    """(f, component, least): the fingerprint that stands for the component of each, and the smallest doc_id of f."""
    nodes = cut(marked.groupBy("f").agg(F.min("doc_id").alias("least")))
    linked = connected_components(near_links(nodes.select("f"), radius)).withColumnRenamed("node", "f")
    return cut(nodes.join(linked, "f", "left").select("f", F.coalesce("component", "f").alias("component"), "least"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, k: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, f, component_id) of every document; component_id is the smallest doc_id that a chain of links reaches.

    Null and empty texts have fingerprint zero and are linked like any other. A null doc_id counts as no id: its row has the
    component of the others, or null if none of them has an id. Rows that repeat come back as often. Other columns of docs
    are not read. Sides that one row in a third may meet are cut before they are joined: they are broadcast if they are
    small, else Spark can split the join where it is hot.
    """
    marked = _marked(docs, k, seed)
    roots = _components(marked, radius)
    ids = cut(roots.groupBy("component").agg(F.min("least").alias("component_id")))
    per = cut(roots.join(small(ids, FEW), "component").select("f", "component_id"))
    return marked.join(small(per, FEW), "f").select("doc_id", "f", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, k: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id, and of rows that share it the first by a hash of the text.

    Rows without an id stay; of rows that repeat wholly, or an id and its text, one stays. No column of docs can clash with
    what is added here.
    """
    marked = _marked(docs, k, seed)
    roots = _components(marked, radius)
    rows = cut(marked.filter("doc_id is not null").join(small(roots.select("f", "component"), FEW), "f").groupBy("component", "doc_id", "th").agg(F.count("*").alias("n")))
    return keep_first(docs, rows)
