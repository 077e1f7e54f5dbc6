"""Joins of lines and line ranges with symbol spans: spans and lines meet by file and bucket of lines, not by file alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines of a bucket. A span is listed once for each bucket that it meets, so a long file is many small joins.
BUCKET = 64


def _bucket(line: Column) -> Column:
    return F.floor(line / BUCKET)


def _buckets(first: Column, last: Column) -> Column:
    return F.explode(F.sequence(_bucket(first), _bucket(F.greatest(first, last))))


def near_spans(lines: DataFrame, symbols: DataFrame, reach: int = 0) -> DataFrame:
    """(file_path, line, id, start_line, end_line): each distinct line with the spans in whose buckets, widened by reach lines, it lies."""
    spans = symbols.select("file_path", "id", "start_line", "end_line", _buckets(F.col("start_line") - reach, F.col("end_line") + reach).alias("bucket"))
    asked = lines.select("file_path", "line").distinct().withColumn("bucket", _bucket(F.col("line")))
    return asked.join(spans, ["file_path", "bucket"]).drop("bucket")


def inside() -> Column:
    return (F.col("line") >= F.col("start_line")) & (F.col("line") <= F.col("end_line"))


def innermost(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_path, line, id): the smallest symbol whose span holds the line; of equals, the one that starts last, then the first id."""
    order = F.struct(F.col("end_line") - F.col("start_line"), -F.col("start_line"), F.col("id"))
    return near_spans(lines, symbols).filter(inside()).groupBy("file_path", "line").agg(F.min_by("id", order).alias("id"))


def nearest_span(lines: DataFrame, symbols: DataFrame, reach: int = 3) -> DataFrame:
    """(file_path, line, id): a symbol whose span holds the line, else one that starts at most reach lines away; the nearest start, then the first id."""
    away = F.abs(F.col("start_line") - F.col("line"))
    order = F.struct(F.when(inside(), 0).otherwise(1), away, F.col("id"))
    return near_spans(lines, symbols, reach).filter(inside() | (away <= reach)).groupBy("file_path", "line").agg(F.min_by("id", order).alias("id"))


def changed_symbols(hunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols whose span meets a hunk (file_path, from_line, to_line), with it. A pair meets in the first bucket that both have."""
    spans = symbols.withColumn("tessera_bucket", _buckets(F.col("start_line"), F.col("end_line")))
    asked = hunks.withColumn("tessera_bucket", _buckets(F.col("from_line"), F.col("to_line")))
    both = spans.join(asked, ["file_path", "tessera_bucket"]).filter((F.col("start_line") <= F.col("to_line")) & (F.col("end_line") >= F.col("from_line")))
    return both.filter(F.col("tessera_bucket") == _bucket(F.greatest("start_line", "from_line"))).drop("tessera_bucket")
