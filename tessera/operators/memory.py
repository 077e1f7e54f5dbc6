"""Agent memory: annotations whose confidence grows when they are confirmed and decays when they are not, sessions, edit checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("purpose", "bug", "security", "test", "performance", "convention", "dependency", "note")
START, STEP, PROMOTED = 0.5, 0.1, 0.8


def ladder(start: float = START) -> list[float]:
    """Confidence after 1, 2, ... equal values in a row, added up step by step."""
    out = [start]
    while out[-1] < 1.0:
        out.append(min(out[-1] + STEP, 1.0))
    return out


def fold(events: DataFrame) -> DataFrame:
    """events (symbol, key, value, ts, id) with run, confidence and event: what each one does to the annotation of its symbol and key.

    An annotation begins, and begins anew with another value, at START; the same value again adds STEP, up to 1. event is
    created, confidence_up, or promoted when the confidence passes PROMOTED. A run of equal values is an island of rows, so
    the state after each row is its place in the island, and no state is carried from row to row. Null values are a value.
    """
    order = Window.partitionBy("symbol", "key").orderBy("ts", "id")
    rung = ladder()
    marked = events.withColumn("fresh", F.when(F.row_number().over(order) == 1, 1).otherwise(F.when(F.lag("value").over(order).eqNullSafe(F.col("value")), 0).otherwise(1)))
    marked = marked.withColumn("island", F.sum("fresh").over(order))
    marked = marked.withColumn("run", F.row_number().over(Window.partitionBy("symbol", "key", "island").orderBy("ts", "id")))
    steps = F.array(*[F.lit(x) for x in rung])
    at = lambda n: F.element_at(steps, F.least(n, F.lit(len(rung))).cast("int"))
    marked = marked.withColumn("confidence", at(F.col("run")))
    event = F.when(F.col("run") == 1, "created").when((F.col("confidence") >= PROMOTED) & (at(F.greatest(F.col("run") - 1, F.lit(1))) < PROMOTED), "promoted").otherwise("confidence_up")
    return marked.withColumn("event", event).drop("fresh", "island")


def annotations(events: DataFrame) -> DataFrame:
    """(symbol, key, value, confidence, created_at, updated_at): the state after all events."""
    newest = F.struct("ts", "id")
    return fold(events).groupBy("symbol", "key").agg(F.max_by("value", newest).alias("value"), F.max_by("confidence", newest).alias("confidence"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"))


def adjust(rows: DataFrame, by: float) -> DataFrame:
    """rows with confidence moved by `by` within [0, 1], and changed."""
    new = F.least(F.greatest(F.col("confidence") + by, F.lit(0.0)), F.lit(1.0))
    return rows.withColumn("changed", new != F.col("confidence")).withColumn("confidence", new)


def _age(now: str) -> Column:
    return F.datediff(F.lit(now).cast("timestamp"), F.col("updated_at"))


def stale(rows: DataFrame, days: int, below: float, now: str) -> DataFrame:
    return rows.filter((F.col("updated_at") < F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days))) & (F.col("confidence") < below))


def decay(rows: DataFrame, now: str, days: int = 30, fresh_days: int = 90) -> DataFrame:
    """rows with confidence and action: annotations older than days lose STEP, or are archived (0) below 0.3; trusted ones younger than fresh_days stay."""
    limit = lambda d: F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(d))
    c = F.col("confidence")
    old = (F.col("updated_at") < limit(days)) & (c < 1.0)
    action = F.when(~old | ((c >= 0.9) & (F.col("updated_at") > limit(fresh_days))), "keep").when(c < 0.3, "archive").otherwise("decay")
    return rows.withColumn("action", action).withColumn("confidence", F.when(F.col("action") == "archive", 0.0).when(F.col("action") == "decay", F.greatest(c - STEP, F.lit(0.0))).otherwise(c))


def promotable(rows: DataFrame) -> DataFrame:
    c = F.col("confidence")
    return rows.filter(c >= PROMOTED).withColumn("severity", F.when(c >= 0.95, "CRITICAL").when(c >= 0.9, "HIGH").otherwise("MEDIUM"))


def recall(rows: DataFrame, symbol: str | None = None, key: str | None = None, most: int = 50) -> DataFrame:
    """Newest and most trusted first; symbol and key together have no limit."""
    for name, value in (("symbol", symbol), ("key", key)):
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    rows = rows.orderBy(F.desc("confidence"), F.desc("updated_at"), "symbol", "key")
    return rows if symbol is not None and key is not None else rows.limit(most)


def live(rows: DataFrame, now: str) -> DataFrame:
    """Rows that have not expired."""
    return rows.filter(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now).cast("timestamp")))


def is_stale_symbol(rows: DataFrame, hashes: DataFrame) -> DataFrame:
    """rows (symbol, symbol_hash) with stale: whether the symbol's hash (symbol, hash) differs now; unknown symbols are not stale."""
    return rows.join(hashes, "symbol", "left").withColumn("stale", F.coalesce(F.col("hash") != F.col("symbol_hash"), F.lit(False))).drop("hash")


def sessions(events: DataFrame) -> DataFrame:
    """(session, agent, started, ended, steps) from (session, step, agent)."""
    return events.groupBy("session").agg(F.min_by("agent", "step").alias("agent"), F.min("step").alias("started"), F.max("step").alias("ended"), F.count("*").alias("steps"))


def edit_checks(events: DataFrame) -> DataFrame:
    """The edits of (session, step, action) with allowed: a check is used up by the first edit after it."""
    order = Window.partitionBy("session").orderBy("step")
    return events.withColumn("allowed", F.coalesce(F.lag("action").over(order) == "check", F.lit(False))).filter("action = 'edit'")


def audit(events: DataFrame) -> DataFrame:
    """(session, symbols): distinct symbols that a session checked, in order."""
    return events.groupBy("session").agg(F.array_sort(F.collect_set("symbol")).alias("symbols"))


def over_rate(hits: DataFrame, most: int, seconds: int = 60) -> DataFrame:
    """(client, window_start, n): fixed windows with more than most hits (client, ts)."""
    w = F.window("ts", f"{seconds} seconds")
    return hits.groupBy("client", w.alias("w")).agg(F.count("*").alias("n")).filter(F.col("n") > most).select("client", F.col("w.start").alias("window_start"), "n")
