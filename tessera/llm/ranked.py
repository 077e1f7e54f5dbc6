"""Ranked lexical search by the threshold algorithm, with scores in whole numbers.

The documents are dealt out as Spark reads them. A first pass makes the forward index: for each document its number of terms
and the frequencies of the terms that the queries ask for. Document frequencies and lengths are summed from it. A second pass
takes the forward index in shards; a shard sorts its postings by impact, one list a term, and runs the threshold algorithm
for each query: it goes down the query's lists side by side, looks each document that it meets up in the forward index for its
full score, and stops once the sum of the impacts at the depth reached, which no document still unseen can exceed, falls
strictly below the k-th score. The k-th score is carried from shard to shard of a task, so later shards stop sooner. What
tasks find is merged by rank within query.

Queries are taken in blocks of about `block_pairs` (query, term) pairs, so neither the vocabulary that is broadcast nor
what the driver holds grows with their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.text import NO_LETTER_OR_DIGIT, Words, bounded, slices
from tessera.plans.cut import cut

#: Pairs of a query and a term that are searched for in one pass.
BLOCK_PAIRS = 1 << 20
#: Postings of a shard; a document is never split.
SHARD_POSTINGS = 1 << 20
#: Postings of each list that the first round of a search reads; later rounds double the depth.
FIRST_DEPTH = 64
SCALE, LENGTH_SHARE = 1_000_000_000, 90


@dataclass
class Block:
    """Some queries: the hashes of their distinct terms in order, and of each query its key and the places of its terms."""

    hashes: np.ndarray
    queries: list[tuple[int, np.ndarray]]
    weights: np.ndarray | None = None


def query_terms(queries: DataFrame) -> DataFrame:
    """(item_id, item, terms): the distinct term hashes of each different query text of an id; item is a hash of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"), NO_LETTER_OR_DIGIT, lower=True)
                h, first = words.hashes().view(np.int64), words.first
                terms = [np.unique(h[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("item_id"), part.column("item"), pa.array(terms, pa.list_(pa.int64()))], ["item_id", "item", "terms"])

    asked = bounded(queries).select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    return asked.select("item_id", F.xxhash64("item_id", "text").alias("item"), "text").mapInArrow(run, "item_id long, item long, terms array<long>").filter(F.size("terms") > 0)


def forward_index(docs: DataFrame, hashes: np.ndarray) -> DataFrame:
    """(doc_id, n, terms, tfs) of each document with a term: its number of terms, and which of the hashes (by place) it holds, how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"), NO_LETTER_OR_DIGIT, lower=True)
                h = words.hashes().view(np.int64)
                place = np.minimum(np.searchsorted(hashes, h), max(0, len(hashes) - 1))
                asked = np.flatnonzero(hashes[place] == h) if len(hashes) else np.zeros(0, np.int64)
                pairs, tfs = np.unique(words.doc[asked] * len(hashes) + place[asked], return_counts=True)
                has = np.flatnonzero(words.count)
                ends = np.searchsorted(pairs, np.append(has, len(words.count)) * len(hashes)).astype(np.int32)
                as_list = lambda x, ends=ends: pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(has)), pa.array(words.count[has], pa.int64()), as_list(pairs % max(1, len(hashes))), as_list(tfs)],
                    ["doc_id", "n", "terms", "tfs"],
                )

    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


class Shard:
    """Postings of some documents, by document and, sorted by impact, by term."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, n_terms: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray):
        self.ids, self.begin = ids, np.concatenate([[0], np.cumsum(n_terms)])
        self.terms = terms
        doc = np.repeat(np.arange(len(ids)), n_terms)
        self.impact = weights[terms] * ((SCALE * tfs) // (1000 * tfs + 8 * m[doc]))
        order = np.lexsort((-self.impact, terms))
        self.list_docs, self.list_impact = doc[order], self.impact[order]
        self.list_begin = np.searchsorted(terms[order], np.arange(len(weights) + 1))

    def scores(self, docs: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The full scores of documents, looked up by document; wanted tells the query's terms."""
        n = self.begin[docs + 1] - self.begin[docs]
        ends = np.cumsum(n)
        at = np.repeat(self.begin[docs] - ends + n, n) + np.arange(ends[-1] if len(n) else 0)
        sums = np.concatenate([[0], np.cumsum(self.impact[at] * wanted[self.terms[at]])])
        return sums[ends] - sums[ends - n]

    def top(self, terms: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray], first_depth: int = FIRST_DEPTH) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the k best of this shard and of best, by falling score and rising id."""
        begin, end = self.list_begin[terms], self.list_begin[terms + 1]
        wanted = np.zeros(len(self.list_begin) - 1, bool)
        wanted[terms] = True
        seen = np.zeros(len(self.ids), bool)
        done, depth = 0, first_depth
        while (begin + done < end).any():
            met = np.concatenate([self.list_docs[a:b] for a, b in zip(np.minimum(begin + done, end), np.minimum(begin + depth, end), strict=True)])
            new = np.unique(met[~seen[met]])
            seen[new] = True
            got = self.scores(new, wanted)
            best = merged(k, best, (got[got > 0], self.ids[new[got > 0]]))
            # the impact last read of each list; a list that is used up has no more to give
            threshold = self.list_impact[(begin + depth - 1)[begin + depth < end]].sum()
            if len(best[0]) >= k and threshold < best[0][-1]:
                break
            done, depth = depth, depth * 2
        return best


def merged(k: int, *found: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    scores, ids = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


#: Stands for a null doc_id in a shard; it comes last among equal scores.
NO_ID = np.iinfo(np.int64).max


def shards(batches: Iterator[pa.RecordBatch], postings: int) -> Iterator[pa.RecordBatch]:
    """The batches cut and joined to about so many postings each."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        ends, at = np.cumsum(np.diff(batch.column("terms").offsets.to_numpy()).astype(np.int64)), 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + postings - size, "right")))
            held.append(batch.slice(at, to - at))
            size += int(ends[to - 1]) - before
            at = to
            if size >= postings or at < batch.num_rows:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def best_of_tasks(index: DataFrame, block: Block, k: int, postings: int = SHARD_POSTINGS) -> DataFrame:
    """(query, doc_id, score): of each task the k best documents of each query, by the threshold algorithm. index has m instead of n."""
    weights, queries = block.weights, block.queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries)
        for batch in shards(batches, postings):
            ids = batch.column("doc_id").fill_null(NO_ID).to_numpy()
            terms = batch.column("terms")
            shard = Shard(ids, batch.column("m").to_numpy(), np.diff(terms.offsets.to_numpy()), terms.flatten().to_numpy(), batch.column("tfs").flatten().to_numpy().astype(np.int64), weights)
            best = [shard.top(terms, k, found) for (_, terms), found in zip(queries, best, strict=True)]
        n = [len(scores) for scores, _ in best]
        ids = np.concatenate([ids for _, ids in best])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(n)), n), pa.int64()), pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(np.concatenate([s for s, _ in best]), pa.int64())],
            ["query", "doc_id", "score"],
        )

    return bounded(index).mapInArrow(run, "query long, doc_id long, score long")


def ranked(found: DataFrame, by: str, k: int, parts: int) -> DataFrame:
    """The k best rows of each group, with their rank. What tasks found is ranked in parts first, so no group gathers rows of every task."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salted = found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(max(1, parts))))
    best = salted.withColumn("rank", F.row_number().over(Window.partitionBy(by, "part").orderBy(*order))).filter(F.col("rank") <= k).drop("rank", "part")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, k: int = 10, block_pairs: int = BLOCK_PAIRS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): of all rows of docs (doc_id, text) the k with the highest score above 0 for each query (item_id, text).

    Terms are longest runs of letters, digits and characters beyond ASCII, A-Z lower-cased; score as in the weights below. A
    null or empty text has no terms: such a document is never found and does not count towards N, such a query finds nothing.
    Equal scores rank by doc_id, a null doc_id last; rows that repeat are documents of their own and rank one after another.
    A query that repeats (id and text) is one; other texts under the same id are queries of their own and have their own ranks.
    Texts of any length are read whole; other columns are not read. Empty tables give no rows.
    """
    asked = cut(query_terms(queries))
    pairs = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    blocks = -(-pairs // block_pairs)
    found = [_search_block(docs, asked.filter(F.pmod("item", F.lit(blocks)) == b), k, shard_postings) for b in range(blocks)]
    if not found:
        return asked.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _search_block(docs: DataFrame, asked: DataFrame, k: int, shard_postings: int) -> DataFrame:
    rows = [(r.item, r.item_id, r.terms) for r in asked.orderBy("item").collect()]  # about block_pairs terms
    hashes = np.unique(np.concatenate([np.array(t, np.int64) for *_, t in rows])) if rows else np.zeros(0, np.int64)
    block = Block(hashes, [(item, np.searchsorted(hashes, t)) for item, _, t in rows])
    index = cut(forward_index(docs, hashes))
    total = index.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    dfs = index.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # at most one row a term of the block
    block.weights = np.zeros(len(hashes), np.int64)
    for r in dfs:
        block.weights[r["term"]] = floor(1000 * log((2 * total.docs + 2) / (2 * r["count"] + 1)))
    m = F.expr(f"{100 - LENGTH_SHARE} + (cast({LENGTH_SHARE} as decimal(38,0)) * n * {total.docs}) div {max(1, total.terms)}")  # decimal: the product may pass 64 bits
    with_m = index.select("doc_id", m.cast("long").alias("m"), "terms", "tfs")
    places = index.sparkSession.createDataFrame([(i, item_id) for i, (_, item_id, _) in enumerate(rows)], "query long, item_id long")
    best = ranked(best_of_tasks(with_m, block, k, shard_postings), "query", k, int(index.rdd.getNumPartitions() ** 0.5))
    return best.join(F.broadcast(places), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
