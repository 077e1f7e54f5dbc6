"""Near copies by the Jaccard similarity of whole texts: MinHash bands find candidates, exact sets of shingles decide.

A text is the set of its five-word shingles, lower-cased (ASCII). ROWS minima under one hash each are a band's key; two texts
of similarity s share a given band with odds s^ROWS, so BANDS bands miss a pair at 0.8 with odds of 0.0004 and nearer ones
less. Texts with equal sets are one node from the start. Only the sets of nodes that share a bucket are shuffled, and a bucket
with the same nodes as another is looked at once. Within a bucket clusters grow from member to member by exact similarities,
over postings of the shingles. A bucket with more than BUCKET_BYTES of sets is cut into chunks, and each two chunks meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import Words, bounded, mix, packed, slices, windows
from tessera.operators.components import connected_components
from tessera.plans.cut import cut, small

SHINGLE, LEAST, BANDS, ROWS = 5, 0.8, 20, 5
BUCKET_BYTES = 4 << 20
#: Rows of one or two numbers that may be broadcast.
NARROW_ROWS = 1_000_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FACTORS = np.random.default_rng(8).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all texts as ascending hashes, and where each text begins, with the end at last. A text of fewer words is one shingle."""
    words = Words(texts)
    words.data = _LOWER[words.data]
    found, begin = windows(words.hashes(), words.first, k)
    doc = np.repeat(np.arange(len(texts)), np.diff(begin))
    by = np.lexsort((found, doc))
    found, doc = found[by], doc[by]
    first = np.ones(len(found), bool)
    first[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
    return found[first], np.searchsorted(doc[first], np.arange(len(texts) + 1))


def _nodes(found: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A number for each set; equal sets have equal ones."""
    return np.array([xxhash.xxh64_intdigest(found[a:b].tobytes()) for a, b in zip(begin[:-1], begin[1:], strict=True)], np.uint64).view(np.int64)


def band_keys(found: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """BANDS keys of each set, a row for each."""
    out = np.zeros((len(begin) - 1, BANDS), np.uint64)
    full = np.flatnonzero(np.diff(begin))
    for b in range(BANDS):
        key = np.full(len(full), b + 1, np.uint64)
        for r in range(ROWS):
            least = np.minimum.reduceat(found * _FACTORS[b * ROWS + r], begin[full]) if len(full) else key
            key = mix(key * np.uint64(0xD6E8FEB86659FD93) + least)
        out[full, b] = key
    return out.view(np.int64)


def _marked(docs: DataFrame) -> DataFrame:
    """(doc_id, th, node, size, bands) of every row; th stands for the text itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found, begin = shingle_sets(part.column("text"))
                bands = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * BANDS, pa.int32()), pa.array(band_keys(found, begin).ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), pa.array(_nodes(found, begin)), pa.array(np.diff(begin).astype(np.int64)), bands], ["doc_id", "th", "node", "size", "bands"])

    return docs.select("doc_id", "th", "text").mapInArrow(run, "doc_id long, th long, node long, size long, bands array<long>")


def _sets(texts: DataFrame) -> DataFrame:
    """(node, found): the set of each text as bytes, once for each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found, begin = shingle_sets(part.column("text"))
                sets = [found[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(_nodes(found, begin)), pa.array(sets, pa.binary())], ["node", "found"])

    return texts.select("text").mapInArrow(run, "node long, found binary").dropDuplicates(["node"])


class _Postings:
    """The members that have each shingle, to count what one set shares with all of them."""

    def __init__(self, sets: list[np.ndarray], members: np.ndarray):
        flat, owner = np.concatenate([sets[m] for m in members]), np.repeat(members, [len(sets[m]) for m in members])
        by = np.argsort(flat, kind="stable")
        self.owner, self.n = owner[by], len(sets)
        self.tokens, first = np.unique(flat[by], return_index=True)
        self.edge = np.append(first, len(flat))

    def shared(self, found: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.tokens, found), len(self.tokens) - 1)
        at = at[self.tokens[at] == found]
        n = self.edge[at + 1] - self.edge[at]
        where = np.repeat(self.edge[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.owner[where], minlength=self.n)


def grow(sets: list[np.ndarray], least: float = LEAST) -> list[tuple[int, int]]:
    """Links (member, root) that join the sets wherever a chain of pairs with a Jaccard similarity of `least` or more does."""
    out, size = [], np.array([len(s) for s in sets])
    left = np.ones(len(sets), bool)
    indexed = None
    for root in range(len(sets)):
        if not left[root]:
            continue
        left[root], queue = False, [root]
        while queue and (n := int(left.sum())):
            if indexed is None or 2 * n < had:
                indexed, had = _Postings(sets, np.flatnonzero(left)), n
            member = queue.pop()
            shared = indexed.shared(sets[member])
            near = np.flatnonzero(left & (shared >= least * (size + size[member] - shared) - 1e-9))
            left[near] = False
            queue += near.tolist()
            out += [(int(m), root) for m in near]
    return out


def _links(buckets: DataFrame, least: float) -> DataFrame:
    """(u, v): the links of all buckets, from rows (key, i, j, node, found)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, sets = None, [], []

        def linked() -> pa.RecordBatch:
            links = grow(sets, least)
            return pa.RecordBatch.from_arrays([pa.array([nodes[x[e]] for x in links], pa.int64()) for e in (0, 1)], ["u", "v"])

        for batch in batches:
            for key, i, j, node, found in zip(*(batch.column(c) for c in ("key", "i", "j", "node", "found")), strict=True):
                at = (key.as_py(), i.as_py(), j.as_py())
                if at != now:
                    if len(sets) > 1:
                        yield linked()
                    now, nodes, sets = at, [], []
                nodes.append(node.as_py())
                sets.append(np.frombuffer(found.as_py(), np.uint64))
        if len(sets) > 1:
            yield linked()

    return buckets.select("key", "i", "j", "node", "found").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "u long, v long")


def copy_links(nodes: DataFrame, docs: DataFrame, least: float = LEAST, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(u, v): links that join all nodes (node, th, size, bands) that chains of pairs found in a band join; docs: th and text."""
    rows = nodes.filter("size > 0").select(F.explode("bands").alias("key"), "node", "size")
    buckets = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.expr("bit_xor(xxhash64(node))").alias("x")).filter("n > 1")
    buckets = cut(buckets.groupBy("n", "x").agg(F.min("key").alias("key"), F.max("size").alias("size")))
    chunks = buckets.select("key", F.ceil(F.col("size") * 8 / bucket_bytes).cast("int").alias("chunks"))
    members = cut(rows.select("key", "node").join(small(chunks, NARROW_ROWS), "key"))
    wanted = cut(members.select("node").distinct().join(nodes.select("node", "th"), "node").select("th"))
    sets = _sets(docs.join(small(wanted, NARROW_ROWS), "th", "left_semi"))
    mine = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    other = F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: c != F.col("mine")))
    met = members.withColumn("mine", mine).withColumn("other", F.explode(other)).select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "node")
    return cut(_links(met.join(sets, "node"), least).distinct())


def keep_first(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs with one row of each component, from rows (component, doc_id, th, n): how many rows of docs have each id and text.

    The smallest doc_id stays, and of its texts that of the least hash. Rows without an id stay. What goes is listed, in
    numbers; texts move only where an id and its text stand on several rows.
    """
    first = cut(rows.groupBy("component").agg(F.min(F.struct("doc_id", "th")).alias("first")))
    judged = cut(rows.join(small(first, NARROW_ROWS), "component").select("doc_id", "th", F.expr("first = struct(doc_id, th)").alias("stays"), "n"))
    keyed = packed(docs, F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    kept = keyed.join(small(judged.filter("not stays").select("doc_id", "th"), NARROW_ROWS), ["doc_id", "th"], "left_anti")
    again = judged.filter("stays and n > 1").select("doc_id", "th")
    if not again.isEmpty():
        again = small(again, NARROW_ROWS)
        kept = kept.join(again, ["doc_id", "th"], "left_anti").unionByName(kept.join(again, ["doc_id", "th"], "left_semi").dropDuplicates(["doc_id", "th"]))
    return kept.select("row.*")


def keep_unlike(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """docs with one row of each group of near copies, that of the smallest doc_id.

    A group is what chains of pairs with a Jaccard similarity of `least` or more join. Texts without words are one group. Rows
    without an id stay and count for no group; of rows that repeat wholly, or an id and its text, one stays. No column of
    docs can clash with what is added here.
    """
    text = F.coalesce("text", F.lit(""))
    read = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")).filter("doc_id is not null")
    marked = cut(_marked(read))
    nodes = cut(marked.groupBy("node").agg(F.min("th").alias("th"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.count("*").alias("n")))
    found = connected_components(copy_links(nodes.drop("n"), read, least))
    groups = cut(found.unionAll(nodes.filter("n > 1").select("node", F.col("node").alias("component")).join(found, "node", "left_anti")))
    return keep_first(docs, cut(marked.select("doc_id", "th", "node").join(small(groups, NARROW_ROWS), "node").groupBy("component", "doc_id", "th").agg(F.count("*").alias("n"))))
