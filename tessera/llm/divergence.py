"""How far apart the sources of a language use its words: exact sums over all pairs, by a split of heavy and light terms.

A group is a source within a language. Each gives each kept term of the language a share p in whole billionths, smoothed, so
that a term that the group lacks has the share p0 of the group. For each pair of groups |p - q| is summed over all kept terms.

* Terms in more than `light` groups of the language are heavy: dense tiles, one a block of terms and a pair of blocks of groups, as
  numpy arrays of terms by groups in which what is absent stands at p0.
* A light term is absent from most groups. If it were absent from all, it would give |p0_a - p0_b|: one product a pair. Where a
  alone has it, |p_a - p0_b| stands instead: counted from the distinct shares that a gives its light terms, not term by term.
  What then is still wrong is where both have it: pairs within the term's posting list, of at most `light` groups.

Each part is summed within its task and then over tasks; all numbers are whole, so the order of sums does not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.text import NO_LETTER, Words, bounded, slices
from tessera.plans.cut import cut, small

LEAST_DOCS, SMOOTH, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Groups of a language that a light term is in at most.
LIGHT = 8
#: Terms, and groups on either side, of a dense tile; terms of a block of postings; groups of a block of shares. On average.
TILE_TERMS, TILE_GROUPS, POSTING_TERMS, SHARE_GROUPS = 1_024, 128, 8_192, 64
#: Rows of counts that a task holds before it gives them out.
HELD_ROWS = 1 << 18
#: Hashes of terms in enough documents that may be broadcast (eight bytes each); with more, terms are counted before they are dropped.
MOST_HASHES = 1 << 21


def often_held(docs: DataFrame, least_docs: int, most: int = MOST_HASHES) -> np.ndarray | None:
    """The hashes, in order, of all terms that least_docs documents of any language hold, or None if they are more than most.

    Only a first sieve that drops the many terms of few documents early: terms are kept by their own counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            h, back = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
            return h, np.bincount(back, np.concatenate([df for _, df in held])).astype(np.int64)

        given = lambda h, df: pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(df)], ["h", "df"])
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"), NO_LETTER, lower=True)
                hashes, term = np.unique(words.hashes(), return_inverse=True)
                in_doc = np.unique(words.doc * max(1, len(hashes)) + term)
                held.append((hashes, np.bincount(in_doc % max(1, len(hashes)), minlength=len(hashes))))
                rows += len(hashes)
                if rows >= 2 * HELD_ROWS:
                    held = [summed()]
                    rows = len(held[0][0])
                    if rows >= HELD_ROWS:
                        yield given(*held[0])
                        held, rows = [], 0
        if held:
            yield given(*summed())

    counted = bounded(docs.select("text")).mapInArrow(run, "h long, df long").groupBy("h").agg(F.sum("df").alias("df")).filter(F.col("df") >= least_docs).select("h")
    found = counted.limit(most + 1).toArrow().column("h").to_numpy()
    return np.sort(found.view(np.uint64)) if len(found) <= most else None


def term_counts(docs: DataFrame, only: np.ndarray | None = None) -> DataFrame:
    """(lang, source, term, n, df): occurrences of each term in each group, and how many of the group's documents hold it. only: hashes of the terms asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held(only)
        for batch in batches:
            for part in slices(batch, "text"):
                held.add(part)
                if held.rows >= HELD_ROWS:
                    yield held.given()
        if held.rows:
            yield held.given()

    counted = bounded(docs).mapInArrow(run, "lang string, source string, term string, n long, df long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


class Held:
    """Counts by group and term of the slices so far; a term is kept once, as its bytes at the first place."""

    def __init__(self, only: np.ndarray | None):
        self.only = only
        self.groups: dict[tuple[str, str], int] = {}
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.words: list[tuple[np.ndarray, pa.Array]] = []
        self.rows = 0

    def add(self, part: pa.RecordBatch) -> None:
        words = Words(part.column("text"), NO_LETTER, lower=True)
        if not len(words.start):
            return
        hashes, first, term = np.unique(words.hashes(), return_index=True, return_inverse=True)
        doc = words.doc
        if self.only is not None:
            asked = np.isin(hashes, self.only, assume_unique=True)
            doc, term = doc[asked[term]], (np.cumsum(asked) - 1)[term[asked[term]]]
            hashes, first = hashes[asked], first[asked]
        if not len(hashes):
            return
        group = np.array([self.groups.setdefault(g, len(self.groups)) for g in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), strict=True)], np.int64)
        in_doc, n = np.unique(doc * len(hashes) + term, return_counts=True)
        key, at, back = np.unique(group[in_doc // len(hashes)] * len(hashes) + in_doc % len(hashes), return_index=True, return_inverse=True)
        self.parts.append((key // len(hashes), hashes[key % len(hashes)], np.bincount(back, n).astype(np.int64), np.bincount(back)))
        length = words.end[first] - words.start[first]
        ends = np.concatenate([[0], np.cumsum(length)])
        data = words.data[np.repeat(words.start[first] - ends[:-1], length) + np.arange(ends[-1])]
        self.words.append((hashes, pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(ends), pa.py_buffer(data))))
        self.rows += len(key)

    def given(self) -> pa.RecordBatch:
        group, hashes, n, df = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((hashes, group))
        group, hashes = group[order], hashes[order]
        begin = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (hashes[1:] != hashes[:-1])))
        all_hashes = np.concatenate([h for h, _ in self.words])
        known, at = np.unique(all_hashes, return_index=True)
        terms = pa.concat_arrays([t for _, t in self.words]).take(pa.array(at[np.searchsorted(known, hashes[begin])])).cast(pa.string())
        langs, sources = (pa.array(x, pa.string()).take(pa.array(group[begin])) for x in zip(*self.groups, strict=True))
        out = pa.RecordBatch.from_arrays([langs, sources, terms, pa.array(np.add.reduceat(n[order], begin)), pa.array(np.add.reduceat(df[order], begin))], ["lang", "source", "term", "n", "df"])
        self.__init__(self.only)
        return out


def share(n: Column | str, of: Column | str, terms: Column | str) -> Column:
    """1 + floor(SCALE * (n + SMOOTH) / (of + SMOOTH * terms)), exact; beyond 9e9 occurrences the product passes 64 bits, and decimals take it."""
    n, below = (F.col(n) if isinstance(n, str) else n).cast("long") + SMOOTH, (F.col(of) if isinstance(of, str) else of) + F.col(terms) * SMOOTH
    wide = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * n.cast("decimal(28,0)"), below.cast("decimal(38,0)"))
    return F.lit(1) + F.when(n < 9_000_000_000, F.call_function("div", n * SCALE, below)).otherwise(wide)


def _tables(docs: DataFrame, least_docs: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, terms, counts): groups (lang, source, number, p0), terms (lang, t, held), counts (lang, source, term, t, number, p0, held, q, p) of kept terms.

    t numbers terms; number numbers the groups of a language from 1.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    plain = docs.select(blank("lang"), blank("source"), blank("text"))
    counted = cut(term_counts(plain, often_held(plain, least_docs)))
    by_term = counted.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("df").alias("df"), F.count("*").alias("held")).filter(F.col("df") >= least_docs)
    terms = cut(by_term.select("lang", "term", "lang_n", "held", F.monotonically_increasing_id().alias("t")))
    langs = cut(terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total")))
    kept = terms.join(small(langs), "lang").select("lang", "term", "t", "held", share("lang_n", "lang_total", "kept").alias("q"))
    counts = cut(counted.select("lang", "source", "term", "n").join(small(kept), ["lang", "term"]))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    every = plain.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(small(langs), "lang", "left").fillna(0, ["total", "kept"])
    p0 = F.when(F.col("kept") > 0, share(F.lit(0), "total", "kept")).otherwise(0)
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long")
    groups = cut(every.select("lang", "source", "total", "kept", p0.alias("p0"), number.alias("number")))
    known = counts.join(small(groups), ["lang", "source"])
    return groups.drop("total", "kept"), terms.select("lang", "t", "held"), cut(known.select("lang", "source", "term", "t", "number", "p0", "held", "q", share("n", "total", "kept").alias("p")))


def _pairs(lang, a: np.ndarray, b: np.ndarray, value: np.ndarray) -> pa.Table:
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "value": pa.array(value, pa.int64())})


PAIRS = "lang string, a long, b long, value long"


def dense_pairs(heavy: DataFrame, terms: DataFrame, groups: DataFrame, tile_terms: int = TILE_TERMS, tile_groups: int = TILE_GROUPS) -> DataFrame:
    """Sums over heavy terms (lang, t, number, p) for pairs a < b of groups (lang, number, p0), tile by tile. terms (lang, t): the heavy ones."""
    n_blocks = terms.groupBy("lang").agg(F.ceil(F.count("*") / tile_terms).alias("term_blocks"))
    sides = groups.groupBy("lang").agg(F.floor((F.count("*") - 1) / tile_groups).alias("last"))
    sizes = small(cut(n_blocks.join(sides, "lang")))
    side, block = F.floor((F.col("number") - 1) / tile_groups), F.pmod(F.xxhash64("t"), "term_blocks").alias("block")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("other")
    rows = heavy.join(sizes, "lang").select("lang", block, side.alias("side"), "number", "p", "t", F.lit(None).cast("long").alias("n_terms"), other)
    # a group's header in each tile: its p0, and how many terms the tile's block has, for a term may be absent from both sides
    blocks = terms.join(sizes, "lang").groupBy("lang", block, "last").agg(F.count("*").alias("n_terms"))
    headers = groups.join(blocks, "lang").select("lang", "block", side.alias("side"), "number", F.col("p0").alias("p"), F.lit(None).cast("long").alias("t"), "n_terms", other)
    tiles = rows.unionByName(headers).select("lang", "block", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "number", "p", "t", "n_terms")

    def run(t: pa.Table) -> pa.Table:
        lang = t.column("lang")[0].as_py()
        header = t.column("t").is_null().to_numpy()
        number, p = t.column("number").to_numpy(), t.column("p").to_numpy()
        order = np.argsort(number[header])
        has, p0 = number[header][order], p[header][order]
        terms, term = np.unique(t.column("t").filter(pa.array(~header)).to_numpy(), return_inverse=True)
        dense = np.tile(p0[:, None], (1, len(terms)))
        dense[np.searchsorted(has, number[~header]), term] = p[~header]
        low = (has - 1) // tile_groups == t.column("low")[0].as_py()
        high = (has - 1) // tile_groups == t.column("high")[0].as_py()
        mine, theirs = np.flatnonzero(low), np.flatnonzero(high)
        out = [(has[i], theirs[has[theirs] > has[i]]) for i in mine]
        absent = pc.max(t.column("n_terms")).as_py() - len(terms)
        sums = [np.abs(dense[j] - dense[i]).sum(axis=1) + absent * np.abs(p0[j] - p0[i]) for i, (_, j) in zip(mine, out, strict=True)]
        a = np.repeat([a for a, _ in out], [len(j) for _, j in out]).astype(np.int64)
        return _pairs(lang, a, has[np.concatenate([j for _, j in out])], np.concatenate(sums))

    return tiles.groupBy("lang", "block", "low", "high").applyInArrow(run, PAIRS)


def share_pairs(light: DataFrame, groups: DataFrame, share_groups: int = SHARE_GROUPS) -> DataFrame:
    """(lang, a, b, value), both ways round: what a's light terms (lang, number, p) give if b lacks them, less what they give if both do."""
    shares = light.groupBy("lang", "number", "p").agg(F.count("*").alias("times"))
    block = F.floor((F.col("number") - 1) / share_groups)
    sides = groups.groupBy("lang").agg(F.floor((F.count("*") - 1) / share_groups).alias("last"))
    headers = groups.join(sides, "lang").select("lang", "number", F.col("p0").alias("p"), F.lit(0).cast("long").alias("times"), F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("block"))

    def run(t: pa.Table) -> pa.Table:
        lang = t.column("lang")[0].as_py()
        number, p, times = (t.column(c).to_numpy() for c in ("number", "p", "times"))
        header = times == 0
        order = np.argsort(number[header])
        has, p0 = number[header][order], p[header][order]
        out = []
        for a in np.unique(number[~header]):
            of = ~header & (number == a)
            own, n = p[of], times[of]
            order = np.argsort(own)
            own, n = own[order], n[order]
            count, total = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * own)])
            at = np.searchsorted(own, p0)
            apart = (p0 * count[at] - total[at]) + (total[-1] - total[at]) - p0 * (count[-1] - count[at])
            out.append((np.full(len(has), a), has, apart - count[-1] * np.abs(p0 - p0[np.searchsorted(has, a)])))
        if not out:
            return _pairs(lang, *[np.zeros(0, np.int64)] * 3)
        a, b, value = (np.concatenate(x) for x in zip(*out, strict=True))
        return _pairs(lang, a[a != b], b[a != b], value[a != b])

    return shares.select("lang", "number", "p", "times", block.alias("block")).unionByName(headers).groupBy("lang", "block").applyInArrow(run, PAIRS)


def posting_pairs(light: DataFrame, terms: DataFrame, posting_terms: int = POSTING_TERMS) -> DataFrame:
    """Corrections for pairs a < b that both hold a light term (lang, t, number, p, p0), summed within blocks of terms. terms (lang, t): the light ones."""
    n_blocks = small(cut(terms.groupBy("lang").agg(F.ceil(F.count("*") / posting_terms).alias("term_blocks"))))
    rows = light.join(n_blocks, "lang").select("lang", F.pmod(F.xxhash64("t"), "term_blocks").alias("block"), "t", "number", "p", "p0")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("t", "ascending"), ("number", "ascending")])
        lang, term = t.column("lang")[0].as_py(), t.column("t").to_numpy()
        number, p, p0 = (t.column(c).to_numpy() for c in ("number", "p", "p0"))
        found, step = [], 1
        while step < len(term) and (same := np.flatnonzero(term[step:] == term[:-step])).size:  # the next but step of the same term
            i, j = same, same + step
            found.append((number[i], number[j], np.abs(p[i] - p[j]) - np.abs(p[i] - p0[j]) - np.abs(p[j] - p0[i]) + np.abs(p0[i] - p0[j])))
            step += 1
        if not found:
            return _pairs(lang, *[np.zeros(0, np.int64)] * 3)
        a, b, value = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        begin = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        return _pairs(lang, a[begin], b[begin], np.add.reduceat(value[order], begin))

    return rows.groupBy("lang", "block").applyInArrow(run, PAIRS)


def audit_sources(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, light: int = LIGHT) -> DataFrame:
    """(lang, source, part, item, value, rank): each group's distance to each other source of its language, and the terms it uses most beyond it.

    docs has lang, source and text; null is '' in each. Terms are longest runs of letters and characters beyond ASCII, A-Z
    lower-cased; a language keeps those in at least least_docs of its documents. A language without kept terms has distances
    of 0 and no terms; a group without terms has the smoothed shares. Rows that repeat count each; equal values rank by item.
    Texts are read whole; other columns are not read. An empty table gives no rows.
    """
    groups, terms, counts = _tables(docs, least_docs)
    slim, few = counts.select("lang", "t", "number", "p", "p0", "held"), F.col("held") <= light
    rare, rare_terms = slim.filter(few), terms.filter(few)
    either = dense_pairs(slim.filter(~few), terms.filter(~few), groups).unionByName(posting_pairs(rare, rare_terms))
    both = either.unionByName(either.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    one = share_pairs(rare, groups)
    one = one.unionByName(one.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    corrections = both.unionByName(one).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    absent = rare_terms.groupBy("lang").agg(F.count("*").alias("light_terms"))
    a = groups.join(absent, "lang", "left").select("lang", "source", F.col("number").alias("a"), F.col("p0").alias("p0_a"), F.coalesce("light_terms", F.lit(0)).alias("light_terms"))
    b = groups.select("lang", F.col("source").alias("item"), F.col("number").alias("b"), F.col("p0").alias("p0_b"))
    pairs = a.join(b, "lang").filter("a <> b").join(corrections, ["lang", "a", "b"], "left")
    distance = F.col("light_terms") * F.abs(F.col("p0_a") - F.col("p0_b")) + F.coalesce("value", F.lit(0))
    order = [F.col("value").desc(), F.col("item")]
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)).cast("int")
    near = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", distance.alias("value")).withColumn("rank", rank)
    beyond = counts.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return near.unionByName(beyond.withColumn("rank", rank).filter(F.col("rank") <= top))
