"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with columns and SQL functions only.

Every document gets the exponential key k = -ln(u) / w, u being a hash of the document in (0, 1) and w the weight of its
quality; the smallest keys of a source are a weighted sample without replacement. A source that must give more words than
it has goes through complete epochs first; the rest of its target is the longest prefix of its documents by key that
fits. One more document, the one whose size is nearest to what is then missing, closes the gap.

The prefix sum needs no sort of a whole source: a histogram of word sums over key ranges (one grouped sum, so a hot source
is summed where its rows lie) finds the range in which the budget ends, and only that range is sorted. A source's decision
is a key threshold, so documents are joined with one row per source and their texts are never shuffled.

Rows that repeat have one key. They are summed as one before any sort, and where the prefix ends among them, as many are
taken as fit: those with the smallest ties, a tie being a hash of a row's place in the scan. Which of equal rows that is
makes no difference to the result. Should a second scan deal the rows out otherwise, still about as many have such ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.text import packed
from tessera.plans.cut import cut, small

WORD = "[^\\\\x20\\\\x09-\\\\x0D]+"
#: Documents that a key range holds on average; a range is the most that one task sorts.
RANGE_ROWS = 4_000
REPEATS = (5, 2, 1)


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.expr(f"regexp_count({text}, '{WORD}')"), F.lit(0)).cast("long")


def quality_weight(text: str = "text") -> Column:
    """Between 1/4 and 1: the share of letters and spaces among the characters; documents full of symbols, digits or nothing come last."""
    odd = F.length(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\p{L}\s.,]+", ""))
    return F.lit(1.0) - F.least(F.lit(0.75), 3.0 * odd / F.greatest(F.length(F.coalesce(F.col(text), F.lit(""))), F.lit(1)))


def keyed(docs: DataFrame, seed: int) -> DataFrame:
    """(row, mix_size, mix_source, mix_key, w, tie): docs as one column, with words, source (a string, null as a value of its own), key, weight, and what tells equal rows apart."""
    tie = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()), 11) + 0.5) / float(1 << 53)
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "source", "text"), 11) + 0.5) / float(1 << 53)
    source = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source")))
    return packed(docs, size_of().alias("mix_size"), source.alias("mix_source"), (-F.log(u) / quality_weight()).alias("mix_key"), quality_weight().alias("w"), tie.alias("tie"))


def targets(sources: DataFrame, weights: tuple[int, ...] = REPEATS, most: float = 3.0) -> DataFrame:
    """sources (mix_source, source_size) with target: all sizes shared by weight, none above most times its size.

    Sources in the order of code points, null last, take the weights in turn. The targets that stop are a prefix of the
    sources by most * size / weight, so running sums over the sources replace rounds of sharing anew. This table has a row
    per source and is the only one that is sorted as a whole.
    """
    rank = Window.orderBy(F.col("mix_source").eqNullSafe("n"), "mix_source")
    turn = (F.row_number().over(rank) - 1) % len(weights) + 1
    s = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int"))).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "mix_source")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    s = s.withColumn("stops", F.col("level") * F.col("weight") > F.col("cap"))
    level = F.max(F.when(~F.col("stops"), F.col("level"))).over(whole)
    return s.select("mix_source", "source_size", F.when(F.col("stops"), F.col("cap")).otherwise(level * F.col("weight")).alias("target"), *[c for c in sources.columns if c not in ("mix_source", "source_size")])


def plan(docs: DataFrame, weights: tuple[int, ...] = REPEATS, seed: int = 42) -> DataFrame:
    """One row per source: mix_source, source_size, target, epochs, full_below (ranges under it are taken whole), ranges, rate, last_key, part_key with part_tie, and gap_key with gap_tie."""
    slim = cut(keyed(docs, seed).drop("row"))
    sums = slim.groupBy("mix_source").agg(F.sum("mix_size").alias("source_size"), F.count("*").alias("n"), F.avg("w").alias("rate"))
    aim = targets(sums, weights).withColumn("ranges", F.ceil(F.col("n") / RANGE_ROWS).cast("long"))
    has = F.col("source_size") > 0
    aim = aim.withColumn("epochs", F.when(has, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    aim = cut(aim.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")))
    near = small(aim)
    ranged = slim.join(near, "mix_source").withColumn("range", key_range())
    hist = ranged.groupBy("mix_source", "range", "budget").agg(F.sum("mix_size").alias("words"))
    up = Window.partitionBy("mix_source").orderBy("range")
    hist = hist.withColumn("end", F.sum("words").over(up))
    ends = hist.filter("end > budget").groupBy("mix_source").agg(F.min_by(F.struct("range", (F.col("end") - F.col("words")).alias("base")), "range").alias("x")).select("mix_source", F.col("x.range").alias("full_below"), F.col("x.base").alias("base"))
    ends = cut(ends)
    rest = ranged.join(small(ends), "mix_source").filter("range >= full_below")
    # equal rows as one, which has their words and number
    equal = rest.filter("range = full_below").groupBy("mix_source", "mix_key", "budget", "base").agg(F.sum("mix_size").alias("words"), F.count("*").alias("times"))
    inside = equal.withColumn("sum", F.col("base") + F.sum("words").over(Window.partitionBy("mix_source").orderBy("mix_key")))
    whole = F.col("sum") <= F.col("budget")
    before = F.col("sum") - F.col("words")
    fit = inside.groupBy("mix_source").agg(
        F.max(F.when(whole, F.col("mix_key"))).alias("last_key"),
        F.max(F.when(whole, F.col("sum"))).alias("sum"),
        F.min_by(F.struct("mix_key", "times", F.floor((F.col("budget") - before) * F.col("times") / F.col("words")).alias("part"), (F.col("words") / F.col("times")).alias("each")), F.when(~whole, F.col("mix_key"))).alias("x"),
    )
    ends = cut(ends.join(fit, "mix_source", "left").select("mix_source", "full_below", "base", "last_key", "sum", F.when(F.col("x.part") > 0, F.col("x")).alias("x")))
    parts = cut(ends.filter("x is not null").select("mix_source", F.col("x.mix_key").alias("part_key"), "x.part", "x.times", (F.col("x.part") * F.col("x.each")).alias("part_words")))
    cuts = cut(ends.drop("x").join(part_ties(ranged, parts), "mix_source", "left"))
    left = rest.drop("full_below", "base").join(small(cuts), "mix_source").filter("(range > full_below or last_key is null or mix_key > last_key) and not coalesce(mix_key = part_key and tie <= part_tie, false)")
    left = left.withColumn("gap", F.col("budget") - F.coalesce("sum", "base") - F.coalesce("part_words", F.lit(0.0)))
    closing = left.filter("mix_size > 0 and abs(gap - mix_size) < gap").groupBy("mix_source").agg(F.min(F.struct(F.abs(F.col("gap") - F.col("mix_size")).alias("off"), "mix_key", "tie")).alias("x"))
    closing = cut(closing.select("mix_source", F.col("x.mix_key").alias("gap_key"), F.col("x.tie").alias("gap_tie")))
    # a row without equals needs no tie
    closing = left.join(small(closing), "mix_source").filter("mix_key = gap_key").groupBy("mix_source", "gap_key").agg(F.when(F.count("*") == 1, 1.0).otherwise(F.min("gap_tie")).alias("gap_tie"))
    return aim.join(cuts.drop("base", "sum", "part_words"), "mix_source", "left").join(closing, "mix_source", "left")


def part_ties(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """(mix_source, part_key, part_words, part_tie): the tie up to which `part` of the `times` rows with part_key are taken. Only the range of ties in which it lies is sorted."""
    among = rows.join(small(parts), "mix_source").filter("mix_key = part_key").withColumn("tied", F.floor(F.col("tie") * F.ceil(F.col("times") / RANGE_ROWS)))
    counts = among.groupBy("mix_source", "tied", "part").count()
    counts = counts.withColumn("upto", F.sum("count").over(Window.partitionBy("mix_source").orderBy("tied")))
    at = cut(counts.filter("upto >= part").groupBy("mix_source").agg(F.min_by(F.struct("tied", (F.col("part") - F.col("upto") + F.col("count")).alias("nth")), "tied").alias("x")).select("mix_source", "x.tied", "x.nth"))
    nth = F.row_number().over(Window.partitionBy("mix_source").orderBy("tie"))
    return among.join(small(at), ["mix_source", "tied"]).withColumn("r", nth).filter("r = nth").select("mix_source", "part_key", "part_words", F.col("tie").alias("part_tie"))


def key_range() -> Column:
    return F.least(F.floor((1 - F.exp(-F.col("mix_key") * F.col("rate"))) * F.col("ranges")), F.col("ranges") - 1).cast("long")


def decide(docs: DataFrame, weights: tuple[int, ...] = REPEATS, seed: int = 42) -> DataFrame:
    """(row, mix_size, source_size, target, copies): every row of docs as one column, and the number of times that the mix takes it."""
    decided = small(cut(plan(docs, weights, seed)))
    took = (F.col("full_below").isNull() & (F.col("budget") > 0)) | (key_range() < F.col("full_below")) | ((key_range() == F.col("full_below")) & (F.col("mix_key") <= F.col("last_key"))) | ((F.col("mix_key") == F.col("part_key")) & (F.col("tie") <= F.col("part_tie"))) | ((F.col("mix_key") == F.col("gap_key")) & (F.col("tie") <= F.col("gap_tie")))
    out = keyed(docs, seed).join(decided, "mix_source").withColumn("copies", F.col("epochs") + F.coalesce(took, F.lit(False)).cast("long"))
    return out.select("row", "mix_size", "source_size", "target", "copies")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = REPEATS, seed: int = 42) -> DataFrame:
    """docs with mix_size, source_size, target and copies, the number of times that the mix takes the document.

    Null texts have no words. A null source is a source, the last in order. Documents without words are taken with every
    epoch and with the prefix they fall in, at no cost. Rows that repeat share one key; where a budget ends among them, only as many as fit are taken.
    An empty table gives an empty one. Equal tables and seeds give equal mixes. Columns of docs keep their values, except
    those that bear one of the four names added here.
    """
    return decide(docs.drop("mix_size", "source_size", "target", "copies"), weights, seed).select("row.*", "mix_size", "source_size", "target", "copies")


def take(docs: DataFrame, weights: tuple[int, ...] = REPEATS, seed: int = 42) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; every column keeps its values."""
    return decide(docs, weights, seed).filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
