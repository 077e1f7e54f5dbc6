"""Best-fit packing by a plan over the histogram of lengths.

Texts are tokenised where they lie; only the longer ones are cut, into full pieces and a rest. How many pieces there are of
each length, at most `length` numbers, is all that the plan reads: best-fit decreasing, done for all pieces of a length at
once. Bins that are filled alike are one run of sequence ids with one number of free tokens; from the longest length to the
shortest, the pieces of a length go to the run with the least room that holds one, as many to each of its bins as fit, and what
no run holds opens new bins. This gives just what best-fit decreasing gives piece by piece. The plan is a table of slots: so
many places from rank a on of one length, in these sequences at this offset. Pieces are numbered within their length, and take
the slot of their rank by a join on length and rank.

Ranks come from a count for each length and bucket, prefix sums over the buckets, and row numbers within a bucket, so a length
that a third of all documents have is still many small sorts.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.packing import END, GATHERED, tokenized_pieces
from tessera.plans.cut import cut

LENGTH = 4096
#: Pieces of a length that are numbered in one sort, on average.
BUCKET_ROWS = 2_048
#: Ranks of a slot table's row that a join handles at once.
STEP = 1_024
SLOTS = "length long, first long, last long, per_bin long, sequence_id long, offset long"


def plan(histogram: dict[int, int], capacity: int = LENGTH) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first, last, per_bin, sequence_id, offset) for ranks first to last of a length.

    Rank r of a row lies in sequence sequence_id + (r - first) // per_bin at offset + (r - first) % per_bin * length.
    """
    runs: dict[int, list[tuple[int, int]]] = {}  # free tokens: (first bin, bins)
    frees: list[int] = []  # the keys of runs, in order
    slots, bins = [], 0

    def keep(free: int, first: int, n: int) -> None:
        if free and n:
            if free not in runs:
                runs[free] = []
                insort(frees, free)
            runs[free].append((first, n))

    for size in sorted(histogram, reverse=True):
        left, rank = histogram[size], 0
        while left:
            at = bisect_left(frees, size)
            if at < len(frees):
                free = frees[at]
                first, n = runs[free].pop()
                if not runs[free]:
                    del runs[free]
                    del frees[at]
            else:
                free, first, n = capacity, bins, -(-left // (capacity // size))
                bins += n
            per_bin = free // size
            full = min(n, left // per_bin)
            if full:
                slots.append((size, rank, rank + full * per_bin - 1, per_bin, first, capacity - free))
                rank, left = rank + full * per_bin, left - full * per_bin
                keep(free - per_bin * size, first, full)
            if left and full < n:  # the last bin takes the rest
                slots.append((size, rank, rank + left - 1, left, first + full, capacity - free))
                keep(free - left * size, first + full, 1)
                left, full = 0, full + 1
            keep(free, first + full, n - full)
    return slots


def numbered(pieces: DataFrame, histogram: dict[int, int], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """pieces with rank, from 0 without gaps within each length. Give it a checkpointed frame."""
    spark = pieces.sparkSession
    counts = spark.createDataFrame([(size, max(1, -(-n // bucket_rows))) for size, n in histogram.items()], "length long, buckets long")
    dealt = pieces.join(F.broadcast(counts), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tie", "nth", "start"), "buckets")).drop("buckets")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "tie", "nth", "start"))
    return dealt.withColumn("within", within).join(base, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("within") - 1).drop("bucket", "within", "base")


def pack_best_fit(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, bucket_rows: int = BUCKET_ROWS, gather: int = GATHERED) -> DataFrame:
    """The pieces of all documents (doc_id, text) with their sequence and offset.

    doc_id, piece, start, length, ids_crc32, sequence_id, offset: a document is its ids and the end id; one longer than
    length is cut into pieces of just that and a rest. A null or empty text is the end id alone. Rows that repeat are
    documents of their own, a null doc_id stays null. Pieces lie without gaps from offset 0 of their sequence; sequence ids
    are dense. Pieces of equal length take their slots in an order by hash of the row, so reruns agree. Texts of any length
    are tokenised whole; other columns are not read. An empty table gives no pieces.
    """
    pieces = cut(tokenized_pieces(docs, tokenizer, length, end, gather=gather))
    histogram = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most length rows
    slots = docs.sparkSession.createDataFrame(plan(histogram, length), SLOTS)
    # a slot row of many ranks meets pieces by length and step of ranks: neither side has a hot key
    steps = slots.withColumn("step", F.explode(F.sequence(F.floor(F.col("first") / STEP), F.floor(F.col("last") / STEP))))
    ranked = numbered(pieces, histogram, bucket_rows).withColumn("step", F.floor(F.col("rank") / STEP))
    placed = ranked.join(steps, ["length", "step"]).filter("rank between first and last")
    nth = F.col("rank") - F.col("first")
    return placed.select(
        "doc_id",
        (F.col("start") / length).cast("int").alias("piece"),
        "start",
        "length",
        "ids_crc32",
        (F.col("sequence_id") + F.floor(nth / F.col("per_bin"))).alias("sequence_id"),
        (F.col("offset") + nth % F.col("per_bin") * F.col("length")).alias("offset"),
    )
