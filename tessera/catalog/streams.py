"""Streaming forms run over the event table as a source, to the end, and compared with their batch forms."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog.memory import FOLD
from tessera.catalog.registry import query
from tessera.plans.cut import checkpoint_dir
from tessera.sources import adapter
from tessera.streaming import flows

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream: the folder is the source and the file its one batch."""
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", "events*.parquet").option("recursiveFileLookup", "true").parquet(sf_dir)


def _run(spark: SparkSession, df: DataFrame, mode: str = "append") -> DataFrame:
    """Runs the stream over all there is and reads what it wrote to the shared folder."""
    out = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    q = df.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/rows")


@query("i10_annotation_stream", "select id, confidence, case when run = 1 then 'created' when confidence >= 0.8 and before_it < 0.8 then 'promoted' else 'confidence_up' end as event from folded", FOLD)
def i10_annotation_stream(spark, sf_dir):
    e = _stream(spark, sf_dir).select(F.concat(F.lit("u"), F.col("user_id")).alias("symbol"), F.col("event_type").alias("key"), (F.col("event_id") % 3).cast("string").alias("value"), "ts", F.col("event_id").alias("id"))
    return _run(spark, flows.annotate(e)).select("id", "confidence", "event")


BURSTS = {
    "changes": "select 'src/f' || (user_id % 50) || '.ts' as path, ts, user_id % 5 as repo from events",
    "opened": "select *, case when ts - lag(ts) over (partition by repo order by ts) <= interval 1 hour then 0 else 1 end as opens from changes",
    "bursts": "select *, sum(opens) over (partition by repo order by ts rows unbounded preceding) as burst from opened",
}


@query("i07_debounced_changes", "select repo, min(ts) as from_time, max(ts) + interval 1 hour as to_time, string_agg(distinct path, ',' order by path) as paths from bursts group by repo, burst", BURSTS)
def i07_debounced_changes(spark, sf_dir):
    """All bursts: those that the stream emits, and those that it holds open when its source ends."""
    of = lambda e: e.select(F.concat(F.lit("src/f"), F.col("user_id") % 50, F.lit(".ts")).alias("path"), "ts", (F.col("user_id") % 5).alias("repo"))
    emitted = _run(spark, flows.debounced(of(_stream(spark, sf_dir)), "1 hour", "1 day"))
    left = flows.last_bursts(of(adapter.table(spark, sf_dir, "events")), emitted, "1 hour")
    return emitted.unionByName(left).select("repo", "from_time", "to_time", F.array_join("paths", ",").alias("paths"))


@query("i08_refresh_batches", "select distinct 'src/f' || (user_id % 50) || '.ts' as path from events")
def i08_refresh_batches(spark, sf_dir):
    out = f"{checkpoint_dir(spark).rstrip('/')}/refresh-{uuid.uuid4().hex}"
    e = _stream(spark, sf_dir).select(F.concat(F.lit("src/f"), F.col("user_id") % 50, F.lit(".ts")).alias("path"))
    flows.refresh(e, lambda paths: paths.write.mode("append").parquet(f"{out}/paths"), f"{out}/state").awaitTermination()
    return spark.read.schema("path string").parquet(f"{out}/paths").distinct()
