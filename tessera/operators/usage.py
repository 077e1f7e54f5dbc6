"""Roll-ups of links, tool usage and metric histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import lookup


def confidence_bands(links: DataFrame) -> DataFrame:
    """One row; zeros for no links."""
    c = F.col("confidence")
    return links.agg(F.count_if(c >= 0.9).alias("high"), F.count_if((c >= 0.7) & (c < 0.9)).alias("medium"), F.count_if(c < 0.7).alias("low"))


def by_tool(rows: DataFrame) -> DataFrame:
    return rows.groupBy("tool").agg(F.count("*").alias("calls"), F.avg("duration_ms").cast("int").alias("avg_ms"), F.sum("tokens_out").alias("tokens_out"), F.sum("tokens_saved").alias("tokens_saved"))


def by_day(rows: DataFrame, days: int) -> DataFrame:
    """The newest days, oldest first."""
    return rows.groupBy(F.to_date("called_at").alias("day")).agg(F.count("*").alias("calls")).orderBy(F.desc("day")).limit(days).orderBy("day")


def dedupe_links(raw: DataFrame) -> DataFrame:
    """One row per (from_id, to_id, type): first line, distinct lines in order, best confidence."""
    return raw.groupBy("from_id", "to_id", "type").agg(F.min("line").alias("first_line"), F.array_sort(F.collect_set("line")).alias("lines"), F.max("confidence").alias("confidence"))


def quality_metrics(rows: DataFrame, symbols: DataFrame, links: DataFrame, most_dead: int = 100) -> DataFrame:
    """(metric, value): token efficiency (TER), leverage (LR), dead exports (DCER, of at most most_dead), context time (CTR)."""
    used = rows.agg(F.sum("tokens_out").cast("double").alias("o"), F.sum("tokens_saved").cast("double").alias("s")).withColumn("t", F.col("o") + F.col("s"))
    exported = symbols.agg(F.count_if("exported").cast("double").alias("exported"))
    dead = lookup.dead_code(links, symbols).limit(most_dead).agg(F.count("*").cast("double").alias("dead"))
    wide = used.crossJoin(exported).crossJoin(dead)  # one row each
    ter = F.when(F.coalesce("t", F.lit(0.0)) == 0, 1.0).otherwise(F.col("o") / F.col("t"))
    lr = F.when(F.coalesce("t", F.lit(0.0)) == 0, 0.0).otherwise(F.col("s") / F.col("t"))
    minutes = F.when(F.col("t") > 0, F.greatest(F.lit(5.0), 45 * (1 - ter))).otherwise(45.0)
    values = {"TER": ter, "LR": lr, "DCER": F.when(F.col("exported") > 0, F.col("dead") / F.col("exported")).otherwise(0.0), "CTR": 1 - minutes / 45}
    return wide.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.round(v, 6).alias("value")) for k, v in values.items()])).alias("m")).select("m.*")


def metric_trend(history: DataFrame) -> DataFrame:
    """(name, current, previous, delta) from (id, name, value, recorded_at); ties by id."""
    newest = Window.partitionBy("name").orderBy(F.desc("recorded_at"), F.desc("id"))
    ranked = history.withColumn("r", F.row_number().over(newest)).filter("r <= 2")
    out = ranked.groupBy("name").agg(F.max(F.when(F.col("r") == 1, F.col("value"))).alias("current"), F.max(F.when(F.col("r") == 2, F.col("value"))).alias("previous"))
    return out.withColumn("delta", F.col("current") - F.col("previous"))


def metric_snapshot(symbols: DataFrame, links: DataFrame) -> DataFrame:
    s = symbols.agg(F.count("*").alias("symbols"), F.count_if("exported").alias("exported"), F.count_distinct("file_path").alias("files"))
    wide = s.crossJoin(links.agg(F.count("*").alias("links"), F.count_if(F.col("confidence") < 0.7).alias("ambiguous")))  # one row each
    return wide.select([F.col(c).cast("double") for c in ("symbols", "links", "exported", "files", "ambiguous")]).unpivot([], ["symbols", "links", "exported", "files", "ambiguous"], "metric_name", "value")


def metric_history(history: DataFrame, name: str, days: int, now: str) -> DataFrame:
    return history.filter((F.col("name") == name) & (F.col("recorded_at") >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days))))


def context_sides(refs: DataFrame, heat: DataFrame, target: str, most: int) -> DataFrame:
    """(side, id, heat): up to most neighbours on each side, hottest first."""
    into = refs.filter(F.col("to_id") == target).select(F.lit("in").alias("side"), F.col("from_id").alias("id"))
    out = refs.filter(F.col("from_id") == target).select(F.lit("out").alias("side"), F.col("to_id").alias("id"))
    ranked = into.unionAll(out).distinct().join(heat, "id").withColumn("r", F.row_number().over(Window.partitionBy("side").orderBy(F.desc("heat"), "id")))
    return ranked.filter(F.col("r") <= most).select("side", "id", "heat")
