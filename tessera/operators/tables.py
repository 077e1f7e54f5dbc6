"""Changes of tables without MERGE: upserts, deletes by file, pruning, change detection, versioned writes, retention."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.plans.cut import cut


def upsert(stored: DataFrame, changes: DataFrame, keys: list[str], seq: str | None = None) -> DataFrame:
    """stored with the rows of changes in place of those with the same keys; of several changes to a key the last by seq counts."""
    if seq:
        order = Window.partitionBy(*keys).orderBy(F.desc(seq))
        changes = changes.withColumn("tessera_r", F.row_number().over(order)).filter("tessera_r = 1").drop("tessera_r", seq)
    return stored.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def delete_file(symbols: DataFrame, links: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the symbols of files (path) and their outgoing links."""
    gone = symbols.join(files.select(F.col("path").alias("file_path")), "file_path", "left_semi").select("id")
    return symbols.join(gone, "id", "left_anti"), links.join(gone.withColumnRenamed("id", "from_id"), "from_id", "left_anti")


def clear_files(symbols: DataFrame, links: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As delete_file, and without links into them."""
    gone = symbols.join(files.select(F.col("path").alias("file_path")), "file_path", "left_semi").select("id")
    kept, links = delete_file(symbols, links, files)
    return kept, links.join(gone.withColumnRenamed("id", "to_id"), "to_id", "left_anti")


def prune(rows: DataFrame, live: DataFrame, column: str = "file_path", always: str = "(external)") -> DataFrame:
    """Rows whose path is live (path); nothing changes if live is empty."""
    if live.isEmpty():
        return rows
    paths = live.select(F.col("path").alias(column)).unionAll(live.sparkSession.createDataFrame([(always,)], f"{column} string"))
    return rows.join(paths, column, "left_semi")


def changed_files(files: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, change): new, changed or gone, by (path, hash)."""
    both = files.select("path", F.col("hash").alias("now")).join(stored.select("path", F.col("hash").alias("then")), "path", "full_outer")
    change = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("now") != F.col("then"), "changed")
    return both.select("path", change.alias("change")).filter("change is not null")


def refresh(stored_facts: DataFrame, new_facts: DataFrame, live: DataFrame, changed: DataFrame) -> DataFrame:
    """Facts after an incremental run: those of unchanged live files, and the new ones of changed files."""
    kept = stored_facts.join(changed.select("path"), "path", "left_anti").join(live.select("path"), "path", "left_semi")
    return kept.unionByName(new_facts.join(changed.select("path"), "path", "left_semi"))


def newest(rows: DataFrame, group: list[str], by: str, most: int = 10, tie: str = "id") -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc(by), F.desc(tie))
    return rows.withColumn("tessera_r", F.row_number().over(order)).filter(F.col("tessera_r") <= most).drop("tessera_r")


def _numbered(rows: DataFrame, order: list[str], size: str) -> DataFrame:
    """rows with tessera_i (from 1, in order) and tessera_upto (the sum of size up to and with the row), range by range."""
    ranged = cut(rows.repartitionByRange(*order).withColumn("tessera_range", F.spark_partition_id()))
    sums = ranged.groupBy("tessera_range").agg(F.sum(size).alias("size"), F.count("*").alias("n"))
    until = Window.orderBy("tessera_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = sums.select("tessera_range", F.coalesce(F.sum("size").over(until), F.lit(0)).alias("tessera_size"), F.coalesce(F.sum("n").over(until), F.lit(0)).alias("tessera_n"))
    within = Window.partitionBy("tessera_range").orderBy(*order)
    upto = F.col("tessera_size") + F.sum(size).over(within.rowsBetween(Window.unboundedPreceding, 0))
    joined = ranged.join(F.broadcast(before), "tessera_range")
    return joined.withColumn("tessera_i", F.col("tessera_n") + F.row_number().over(within)).withColumn("tessera_upto", upto).drop("tessera_size", "tessera_n", "tessera_range")


def _next_starts(numbered: DataFrame, budget: int) -> DataFrame:
    """(i, next): for a chunk that starts at row i (tessera_i, tessera_upto, size), the first row that it has no room for, or null.

    The sums up to each row and the sums at which each start is full are merged in ranges of their common order: what is
    looked for is the next row's sum after a start's, in its range or else the first of a later one.
    """
    ends = numbered.select(F.col("tessera_upto").alias("at"), F.lit(0).alias("start"), F.col("tessera_i").alias("i"))
    starts = numbered.select((F.col("tessera_upto") - F.col("tessera_own") + budget).alias("at"), F.lit(1).alias("start"), F.col("tessera_i").alias("i"))
    merged = cut(ends.unionAll(starts).repartitionByRange("at", "start").withColumn("range", F.spark_partition_id()))
    found = F.when(F.col("start") == 0, F.col("i"))
    firsts = merged.groupBy("range").agg(F.min(found).alias("first"))
    later = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    after = firsts.select("range", F.min("first").over(later).alias("after"))
    back = Window.partitionBy("range").orderBy(F.desc("at"), F.desc("start"), F.desc("i")).rowsBetween(Window.unboundedPreceding, -1)
    within = merged.withColumn("within", F.min(found).over(back)).filter("start = 1").join(F.broadcast(after), "range")
    full = F.coalesce("within", "after")
    return within.select("i", F.when(full.isNotNull(), F.greatest(full, F.col("i") + 1)).alias("next"))


def chunks(files: DataFrame, size: str, order: str | list[str], budget: int) -> DataFrame:
    """files with chunk, from 0: a new one at each file that no longer fits within budget behind those before it; a larger file is alone.

    Where a chunk ends depends on where it starts, so starts are followed by pointer doubling: round k marks what lies up to
    2^k chunks behind what is marked, so a million chunks take twenty joins and no task walks along all files. Rows of equal
    order may stand in any order; a null size counts as 0.
    """
    order = [order] if isinstance(order, str) else order
    numbered = cut(_numbered(files.withColumn("tessera_own", F.coalesce(F.col(size), F.lit(0)).cast("long")), order, "tessera_own"))
    last = numbered.agg(F.max("tessera_i")).first()[0] or 0
    jump = cut(_next_starts(numbered, budget).filter(F.col("next") <= last))
    marked = numbered.filter("tessera_i = 1").select(F.col("tessera_i").alias("i"))
    while not jump.isEmpty():
        marked = cut(marked.unionAll(marked.join(jump, "i").select(F.col("next").alias("i"))))
        jump = cut(jump.join(jump.select(F.col("i").alias("next"), F.col("next").alias("then")), "next").select("i", F.col("then").alias("next")))
    starts = marked.select(F.col("i").alias("tessera_i"), F.lit(1).cast("long").alias("tessera_start"))
    told = numbered.join(starts, "tessera_i", "left").withColumn("tessera_start", F.coalesce("tessera_start", F.lit(0)))
    counted = _numbered(told.withColumn("tessera_j", F.col("tessera_i")).drop("tessera_i", "tessera_upto"), ["tessera_j"], "tessera_start")
    return counted.withColumn("chunk", F.col("tessera_upto") - 1).drop("tessera_i", "tessera_j", "tessera_upto", "tessera_own", "tessera_start")


class Versions:
    """A set of tables that change together: a run writes them all to a new folder and then publishes its name.

    The pointer is a one-row table whose newest row counts, so readers see all tables of a run or none.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def publish(self, tables: dict[str, DataFrame]) -> str:
        version = uuid.uuid4().hex
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{version}/{name}")
        number = self._number() + 1
        self.spark.createDataFrame([(number, version)], "number long, version string").coalesce(1).write.mode("append").parquet(f"{self.root}/_pointer_")
        return version

    def _pointer(self) -> DataFrame:
        return self.spark.read.schema("number long, version string").parquet(f"{self.root}/_pointer_")

    def _number(self) -> int:
        try:
            return self._pointer().agg(F.max("number")).first()[0] or 0
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return 0
            raise

    def read(self, name: str) -> DataFrame:
        version = self._pointer().agg(F.max_by("version", "number")).first()[0]
        return self.spark.read.parquet(f"{self.root}/{version}/{name}")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
