"""Annotations, sessions, edit checks and rate limits over the event tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog.registry import query
from tessera.operators import memory
from tessera.sources import adapter


def _events(spark, sf_dir):
    return adapter.table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id")).alias("symbol"), F.col("event_type").alias("key"), (F.col("event_id") % 3).cast("string").alias("value"), "ts", F.col("event_id").alias("id")
    )


STEPS = "[" + ", ".join(f"{x!r}e0" if "e" not in repr(x) else repr(x) for x in memory.ladder()) + "]"
FOLD = {
    "marked": "select *, case when lag(value) over w is not distinct from value and row_number() over w > 1 then 0 else 1 end as fresh from ann window w as (partition by symbol, key order by ts, event_id)",
    "islands": "select *, sum(fresh) over (partition by symbol, key order by ts, event_id) as island from marked",
    "runs": "select *, row_number() over (partition by symbol, key, island order by ts, event_id) as run from islands",
    "folded": f"select symbol, key, value, ts, event_id as id, run, {STEPS}[least(run, {len(memory.ladder())})] as confidence, {STEPS}[least(greatest(run - 1, 1), {len(memory.ladder())})] as before_it from runs",
    "states": "select symbol, key, arg_max(value, (ts, id)) as value, arg_max(confidence, (ts, id)) as confidence, min(ts) as created_at, max(ts) as updated_at from folded group by 1, 2",
}


@query("i10_annotation_fold", "select id, run, confidence, case when run = 1 then 'created' when confidence >= 0.8 and before_it < 0.8 then 'promoted' else 'confidence_up' end as event from folded", FOLD)
def i10_annotation_fold(spark, sf_dir):
    return memory.fold(_events(spark, sf_dir)).select("id", F.col("run").cast("long").alias("run"), "confidence", "event")


@query("i10_annotations", "select symbol, key, value, confidence, updated_at from states", FOLD)
def i10_annotations(spark, sf_dir):
    return memory.annotations(_events(spark, sf_dir)).select("symbol", "key", "value", "confidence", "updated_at")


@query("i11_history", "select id, run, ts from folded where symbol = 'u3' order by ts, id", FOLD)
def i11_history(spark, sf_dir):
    return memory.fold(_events(spark, sf_dir).filter("symbol = 'u3'")).select("id", F.col("run").cast("long").alias("run"), "ts").orderBy("ts", "id")


@query("i12_adjust", "select symbol, key, least(greatest(confidence - 0.1e0, 0e0), 1e0) as confidence, least(greatest(confidence - 0.1e0, 0e0), 1e0) <> confidence as changed from states", FOLD)
def i12_adjust(spark, sf_dir):
    return memory.adjust(memory.annotations(_events(spark, sf_dir)), -0.1).select("symbol", "key", "confidence", "changed")


LATER = "2024-03-15 00:00:00"


@query(
    "i13_decay",
    f"""select symbol, key, action, case action when 'archive' then 0e0 when 'decay' then greatest(confidence - 0.1e0, 0e0) else confidence end as confidence from (select *, case when not (updated_at < timestamp '{LATER}' - interval 30 day and confidence < 1e0)
      or (confidence >= 0.9 and updated_at > timestamp '{LATER}' - interval 90 day) then 'keep' when confidence < 0.3 then 'archive' else 'decay' end as action from states) x""",
    FOLD,
)
def i13_decay(spark, sf_dir):
    return memory.decay(memory.annotations(_events(spark, sf_dir)), LATER).select("symbol", "key", "action", "confidence")


@query("i14_stale", f"select symbol, key from states where updated_at < timestamp '{adapter.NOW}' - interval 14 day and confidence < 0.6", FOLD)
def i14_stale(spark, sf_dir):
    return memory.stale(memory.annotations(_events(spark, sf_dir)), 14, 0.6, adapter.NOW).select("symbol", "key")


@query("i15_promotable", "select key, severity, count(*) as n from (select key, case when confidence >= 0.95 then 'CRITICAL' when confidence >= 0.9 then 'HIGH' else 'MEDIUM' end as severity from folded where confidence >= 0.8) x group by 1, 2", FOLD)
def i15_promotable(spark, sf_dir):
    return memory.promotable(memory.fold(_events(spark, sf_dir))).groupBy("key", "severity").agg(F.count("*").alias("n"))


@query("i16_live", f"select event_id from (select event_id, case when event_id % 3 = 0 then null else ts + interval 20 day end as expires_at from events) x where expires_at is null or expires_at > timestamp '{adapter.NOW}'")
def i16_live(spark, sf_dir):
    e = adapter.table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("ts") + F.expr("interval 20 days")).alias("expires_at"))
    return memory.live(e, adapter.NOW).select("event_id")


@query("i17_sessions", "select conv_id as session, arg_min(role, turn) as agent, min(turn) as started, max(turn) as ended, count(*) as steps from (select distinct conv_id, turn, role from conversations) c group by 1")
def i17_sessions(spark, sf_dir):
    c = adapter.table(spark, sf_dir, "conversations").selectExpr("conv_id as session", "turn as step", "role as agent").distinct()
    return memory.sessions(c)


STEPS_OF = "select distinct conv_id, turn from conversations"
ACTIONS = f"select conv_id as session, turn as step, case when (conv_id + turn * turn) % 3 = 0 then 'check' else 'edit' end as action, 's' || (conv_id * 7 + turn) % 5 as symbol from ({STEPS_OF}) d"


@query("i18_edit_checks", "select session, step, allowed from (select *, coalesce(lag(action) over (partition by session order by step) = 'check', false) as allowed from actions) x where action = 'edit'", {"actions": ACTIONS})
def i18_edit_checks(spark, sf_dir):
    return memory.edit_checks(spark.sql(ACTIONS.replace("from conversations", f"from parquet.`{sf_dir}/conversations.parquet`"))).select("session", "step", "allowed")


@query("i19_session_audit", "select session, array_to_string(list_sort(list(distinct symbol)), ',') as symbols from actions where action = 'check' group by 1", {"actions": ACTIONS})
def i19_session_audit(spark, sf_dir):
    rows = spark.sql(ACTIONS.replace("from conversations", f"from parquet.`{sf_dir}/conversations.parquet`"))
    return memory.audit(rows.filter("action = 'check'")).select("session", F.array_join("symbols", ",").alias("symbols"))


@query("i22_rate_limit", "select user_id as client, time_bucket(interval 1 day, ts) as window_start, count(*) as n from events group by 1, 2 having count(*) > 3")
def i22_rate_limit(spark, sf_dir):
    hits = adapter.table(spark, sf_dir, "events").select(F.col("user_id").alias("client"), "ts")
    return memory.over_rate(hits, 3, 86400)


@query("a15_annotation_counts", "select session, count(*) as n, count(*) filter (action = 'check') as checks from actions group by 1", {"actions": ACTIONS})
def a15_annotation_counts(spark, sf_dir):
    rows = spark.sql(ACTIONS.replace("from conversations", f"from parquet.`{sf_dir}/conversations.parquet`"))
    return rows.groupBy("session").agg(F.count("*").alias("n"), F.count_if(F.col("action") == "check").alias("checks"))


@query("o08_recall", "select symbol, key, confidence from states where key = 'click' order by confidence desc, updated_at desc, symbol, key limit 50", FOLD)
def o08_recall(spark, sf_dir):
    return memory.recall(memory.annotations(_events(spark, sf_dir)), key="click").select("symbol", "key", "confidence")


@query("j17_stale_symbols", "select a.doc_id, coalesce(a.h <> b.h, false) as stale from (select doc_id, substr(sha256(text), 1, 16) as h from documents) a left join (select doc_id, case when doc_id % 5 = 0 then 'x' else substr(sha256(text), 1, 16) end as h from documents where doc_id % 4 <> 0) b using (doc_id)")
def j17_stale_symbols(spark, sf_dir):
    d = adapter.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("symbol"), F.substring(F.sha2("text", 256), 1, 16).alias("symbol_hash"))
    now = d.filter("symbol % 4 <> 0").select("symbol", F.when(F.col("symbol") % 5 == 0, "x").otherwise(F.col("symbol_hash")).alias("hash"))
    return memory.is_stale_symbol(d, now).select(F.col("symbol").alias("doc_id"), "stale")


@query("f28_valid_keys", "select key, key in ('bug', 'test') as valid, count(*) as n from (select case event_id % 4 when 0 then 'bug' when 1 then 'test' when 2 then 'nonsense' else event_type end as key from events) x group by 1")
def f28_valid_keys(spark, sf_dir):
    i = F.col("event_id") % 4
    key = F.when(i == 0, "bug").when(i == 1, "test").when(i == 2, "nonsense").otherwise(F.col("event_type"))
    rows = adapter.table(spark, sf_dir, "events").select(key.alias("key"))
    return rows.groupBy("key").agg(F.count("*").alias("n")).select("key", F.col("key").isin(*memory.KEYS).alias("valid"), "n")
