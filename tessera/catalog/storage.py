"""Scans, upserts, deletes and incremental refresh."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog.registry import query
from tessera.functions import paths
from tessera.operators import tables
from tessera.sources import adapter


@query("s05_languages", "select case split_part(file_path, '.', -1) when 'ts' then 'typescript' end as language, count(*) as n from symbols group by 1")
def s05_languages(spark, sf_dir):
    return adapter.symbols(spark, sf_dir).groupBy(paths.language(F.col("file_path")).alias("language")).agg(F.count("*").alias("n"))


@query("s02_listed_files", "select id from symbols where file_path in ('src/geo/n1.ts', 'src/supply/s0.ts')")
def s02_listed_files(spark, sf_dir):
    listed = spark.createDataFrame([("src/geo/n1.ts",), ("src/supply/s0.ts",)], "file_path string")
    return adapter.symbols(spark, sf_dir).join(listed, "file_path", "left_semi").select("id")


@query(
    "s04_byte_chunks",
    "select doc_id, chunk from chunked",
    {
        "files": "select doc_id, row_number() over (order by doc_id) as i, octet_length(encode(coalesce(text, ''))) as size from documents",
        "chunked": """select doc_id, i, size as used, cast(0 as bigint) as chunk from files where i = 1
          union all select f.doc_id, f.i, case when c.used + f.size > 20000 then f.size else c.used + f.size end, c.chunk + case when c.used + f.size > 20000 then 1 else 0 end from chunked c join files f on f.i = c.i + 1""",
    },
)
def s04_byte_chunks(spark, sf_dir):
    d = adapter.table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("size"))
    return tables.chunks(d, "size", "doc_id", 20_000).select("doc_id", "chunk")


@query("s07_symbol_scan", "select id, name, kind, file_path, start_line, end_line, exported, parent_id from symbols")
def s07_symbol_scan(spark, sf_dir):
    return adapter.symbols(spark, sf_dir)


@query("s07_link_scan", "select from_id, to_id, type, confidence from links")
def s07_link_scan(spark, sf_dir):
    return adapter.links(spark, sf_dir)


UPSERT = "select n_nationkey as key, case when n_nationkey % 5 = 0 then n_nationkey * 2 else n_regionkey end as value from nation union all select 100, 7"


@query("s08_upsert", UPSERT)
def s08_upsert(spark, sf_dir):
    n = adapter.table(spark, sf_dir, "nation")
    stored = n.select(F.col("n_nationkey").alias("key"), F.col("n_regionkey").alias("value"))
    fives = n.filter("n_nationkey % 5 = 0")
    changes = fives.select(F.col("n_nationkey").alias("key"), F.lit(-1).alias("value"), F.lit(1).alias("seq")).unionAll(fives.select("n_nationkey", F.col("n_nationkey") * 2, F.lit(2))).unionAll(spark.createDataFrame([(100, 7, 1)], "key int, value int, seq int"))
    return tables.upsert(stored, changes, ["key"], "seq")


FILE = "src/supply/s1.ts"


@query("s10_delete_file", f"select count(*) as links, (select count(*) from symbols where file_path <> '{FILE}') as symbols from links where from_id not in (select id from symbols where file_path = '{FILE}')")
def s10_delete_file(spark, sf_dir):
    gone = spark.createDataFrame([(FILE,)], "path string")
    s, l = tables.delete_file(adapter.symbols(spark, sf_dir), adapter.links(spark, sf_dir), gone)
    return l.agg(F.count("*").alias("links")).crossJoin(s.agg(F.count("*").alias("symbols")))  # one row each


@query("s11_clear_files", f"select count(*) as links, (select count(*) from symbols where file_path <> '{FILE}') as symbols from links where from_id not in (select id from symbols where file_path = '{FILE}') and to_id not in (select id from symbols where file_path = '{FILE}')")
def s11_clear_files(spark, sf_dir):
    gone = spark.createDataFrame([(FILE,)], "path string")
    s, l = tables.clear_files(adapter.symbols(spark, sf_dir), adapter.links(spark, sf_dir), gone)
    return l.agg(F.count("*").alias("links")).crossJoin(s.agg(F.count("*").alias("symbols")))  # one row each


@query("s12_prune", "select id from symbols where file_path like 'src/geo/%'")
def s12_prune(spark, sf_dir):
    s = adapter.symbols(spark, sf_dir)
    return tables.prune(s, s.filter("file_path like 'src/geo/%'").select(F.col("file_path").alias("path")).distinct()).select("id")


@query("s13_truncate", "select id from symbols where false")
def s13_truncate(spark, sf_dir):
    return adapter.symbols(spark, sf_dir).limit(0).select("id")


@query("s16_snapshot_retention", "select event_id from (select event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) x where r <= 10")
def s16_snapshot_retention(spark, sf_dir):
    return tables.newest(adapter.table(spark, sf_dir, "events"), ["user_id"], "ts", 10, "event_id").select("event_id")


@query("s20_verified_findings", "select s.id, s.start_line <= f.lines as located from symbols s left join (select file_path, max(end_line) - 20 as lines from symbols group by 1) f using (file_path)")
def s20_verified_findings(spark, sf_dir):
    s = adapter.symbols(spark, sf_dir)
    size = s.groupBy("file_path").agg((F.max("end_line") - 20).alias("lines"))
    return s.join(size, "file_path", "left").select("id", (F.col("start_line") <= F.col("lines")).alias("located"))


NOW_FILES = "select doc_id, substr(sha256(text), 1, 16) as hash from documents where doc_id % 11 <> 0"
THEN_FILES = "select doc_id, case when doc_id % 7 = 0 then 'old' else substr(sha256(text), 1, 16) end as hash from documents where doc_id % 13 <> 0"


@query("i01_changed_files", "select coalesce(n.doc_id, t.doc_id) as doc, case when t.doc_id is null then 'new' when n.doc_id is null then 'gone' else 'changed' end as change from cur n full join prev t on n.doc_id = t.doc_id where t.doc_id is null or n.doc_id is null or n.hash <> t.hash", {"cur": NOW_FILES, "prev": THEN_FILES})
def i01_changed_files(spark, sf_dir):
    d = adapter.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.substring(F.sha2("text", 256), 1, 16).alias("hash"))
    stored = d.filter("path % 13 <> 0").withColumn("hash", F.when(F.col("path") % 7 == 0, "old").otherwise(F.col("hash")))
    return tables.changed_files(d.filter("path % 11 <> 0"), stored).withColumnRenamed("path", "doc")


REFRESH = "select doc_id as path, case when doc_id % 7 = 0 or doc_id % 13 = 0 then n_chars else n_chars + 1 end as fact from documents where doc_id % 11 <> 0"


@query("i02_incremental_facts", REFRESH)
def i02_incremental_facts(spark, sf_dir):
    d = adapter.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("fact"), F.lit("h").alias("hash"))
    live = d.filter("path % 11 <> 0")
    stored = d.filter("path % 13 <> 0").withColumn("fact", F.col("fact") + 1).withColumn("hash", F.when(F.col("path") % 7 == 0, "old").otherwise(F.col("hash")))
    changed = tables.changed_files(live, stored).filter("change <> 'gone'")
    return tables.refresh(stored.select("path", "fact"), live.select("path", "fact"), live, changed)


@query("i23_schema_growth", "select event_id, event_type, cast(null as double) as value from events where event_id % 2 = 0 union all select event_id, event_type, value from events where event_id % 2 = 1")
def i23_schema_growth(spark, sf_dir):
    e = adapter.table(spark, sf_dir, "events")
    old, new = e.filter("event_id % 2 = 0").select("event_id", "event_type"), e.filter("event_id % 2 = 1").select("event_id", "event_type", "value")
    return tables.union_all([old, new])


HASHED = "select doc_id, source, case when doc_id % 7 = 0 then 'new' || (doc_id % 3) else substr(sha256(text), 1, 8) end as hash from documents"


@query("s09_file_rows", f"select doc_id, hash, coalesce(source, 'none') as zone from ({HASHED}) x")
def s09_file_rows(spark, sf_dir):
    """Hashes and zones of files after an upsert of every seventh hash; the zone stays."""
    d = adapter.table(spark, sf_dir, "documents")
    stored = d.select("doc_id", F.substring(F.sha2("text", 256), 1, 8).alias("hash"))
    changes = d.filter("doc_id % 7 = 0").select("doc_id", F.concat(F.lit("new"), F.col("doc_id") % 3).alias("hash"))
    zones = d.select("doc_id", F.coalesce("source", F.lit("none")).alias("zone"))
    return tables.upsert(stored, changes, ["doc_id"]).join(zones, "doc_id").select("doc_id", "hash", "zone")


@query("i03_live_facts", "select l_orderkey % 3 = 0 as kept_old, count(*) as n from lineitem where l_orderkey % 4 <> 0 group by 1")
def i03_live_facts(spark, sf_dir):
    """Facts of line items by order: orders whose number four divides are gone, and two in three of the others are read again."""
    facts = adapter.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), "l_linenumber")
    live = facts.filter("path % 4 <> 0").select("path").distinct()
    changed = live.filter("path % 3 <> 0")
    now = tables.refresh(facts.withColumn("old", F.lit(True)), facts.withColumn("old", F.lit(False)), live, changed)
    return now.groupBy(F.col("old").alias("kept_old")).agg(F.count("*").alias("n"))
