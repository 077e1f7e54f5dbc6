"""Structured Streaming forms: debounced change feeds, incremental refresh in micro-batches, annotation state, rate limits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.memory import PROMOTED, START, STEP


def debounced(changes: DataFrame, quiet: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """(repo, from_time, to_time, paths): bursts of changes (repo, path, ts), each ended by a quiet spell of its repository."""
    burst = changes.withWatermark("ts", late).groupBy("repo", F.session_window("ts", quiet).alias("w"))
    return burst.agg(F.array_sort(F.collect_set("path")).alias("paths")).select("repo", F.col("w.start").alias("from_time"), F.col("w.end").alias("to_time"), "paths")


def last_bursts(changes: DataFrame, emitted: DataFrame, quiet: str = "2 seconds") -> DataFrame:
    """The bursts that a finished stream still held open: those of changes (repo, path, ts), read as a table, after the last that was emitted of their repository."""
    over = emitted.groupBy("repo").agg(F.max("to_time").alias("over"))
    rest = changes.join(over, "repo", "left").filter("over is null or ts >= over").drop("over")
    burst = rest.groupBy("repo", F.session_window("ts", quiet).alias("w")).agg(F.array_sort(F.collect_set("path")).alias("paths"))
    return burst.select("repo", F.col("w.start").alias("from_time"), F.col("w.end").alias("to_time"), "paths")


def refresh(changes: DataFrame, apply: Callable[[DataFrame], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Runs apply on the distinct paths of each micro-batch, one at a time; a batch that was done before a restart is not done again. every: how often; otherwise once, for all there is."""
    done: set[int] = set()

    def batch(df: DataFrame, epoch: int) -> None:
        if epoch not in done:
            apply(df.select("path").distinct())
            done.add(epoch)

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


ANNOTATED = "symbol string, key string, value string, confidence double, event string, id long"


#: How pandas holds a time that is missing; such rows come last.
NO_TIME = pd.NaT.value


def _annotate(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """All annotations of one symbol: a call for each key would cost more than its few events."""
    held = dict(zip(state.get[0], zip(state.get[1], state.get[2], strict=True), strict=True)) if state.exists else {}
    # groups are many and short: their rows are handled as lists, which costs less than frames
    rows = []
    for batch in batches:
        ts = batch["ts"].to_numpy("datetime64[us]").astype("int64").tolist()
        rows += zip(ts, batch["id"].tolist(), batch["key"].tolist(), batch["value"].tolist(), strict=True)
    out = []
    for _, at, key, new in sorted(rows, key=lambda r: (r[0] == NO_TIME, r[0], r[1])):
        value, before = held.get(key, (None, -1.0))
        if before >= 0 and new == value:
            confidence = min(before + STEP, 1.0)
            event = "promoted" if confidence >= PROMOTED > before else "confidence_up"
        else:
            confidence, event = START, "created"
        held[key] = (new, confidence)
        out.append((group[0], key, new, confidence, event, at))
    state.update((list(held), [v for v, _ in held.values()], [c for _, c in held.values()]))
    yield pd.DataFrame(out, columns=["symbol", "key", "value", "confidence", "event", "id"])


STATE = "keys array<string>, latest array<string>, confidences array<double>"


def annotate(events: DataFrame) -> DataFrame:
    """A row for each event (symbol, key, value, ts, id) with the confidence after it: the streaming form of `memory.fold`. Events of a key must come in order from batch to batch. The state of a symbol is a row for its keys, of which there are few."""
    return events.groupBy("symbol").applyInPandasWithState(_annotate, ANNOTATED, STATE, "append", GroupStateTimeout.NoTimeout)


def over_rate(hits: DataFrame, most: int = 60, window: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """(client, window_start, n): windows in which a client (client, ts) comes more than most times."""
    counted = hits.withWatermark("ts", late).groupBy("client", F.window("ts", window).alias("w")).agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") > most).select("client", F.col("w.start").alias("window_start"), "n")
