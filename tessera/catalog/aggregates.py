"""Counts, sums and rankings over symbols, links and usage; filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.catalog.registry import TEST, _like, query
from tessera.functions import paths
from tessera.operators import enrich, lookup, usage
from tessera.sources import adapter


@query("a01_stats", "select (select count(*) from symbols) as symbols, (select count(*) from links) as links, (select count(distinct file_path) from symbols) as files")
def a01_stats(spark, sf_dir):
    s = adapter.symbols(spark, sf_dir).agg(F.count("*").alias("symbols"), F.count_distinct("file_path").alias("files"))
    return s.crossJoin(adapter.links(spark, sf_dir).agg(F.count("*").alias("links"))).select("symbols", "links", "files")  # one row each


BANDS = "select count(*) filter (confidence >= 0.9) as high, count(*) filter (confidence >= 0.7 and confidence < 0.9) as medium, count(*) filter (confidence < 0.7) as low from links where type <> 'contains'"


@query("a02_confidence_distribution", BANDS)
def a02_confidence_distribution(spark, sf_dir):
    return usage.confidence_bands(adapter.links(spark, sf_dir).filter("type <> 'contains'"))


@query("a04_referenced_by_heat", "select e.id, e.heat, count(*) as n from enriched e join links l on l.to_id = e.id and l.type <> 'contains' where e.exported and e.kind <> 'section' group by e.id, e.heat having count(*) > 1 order by e.heat desc, e.id limit 200")
def a04_referenced_by_heat(spark, sf_dir):
    links, symbols = adapter.links(spark, sf_dir), adapter.symbols(spark, sf_dir)
    n = links.filter("type <> 'contains'").groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("n")).filter("n > 1")
    return enrich.enrich(symbols, links).filter("exported and kind <> 'section'").join(n, "id").select("id", "heat", "n").orderBy(F.desc("heat"), "id").limit(200)


@query(
    "a05_test_only_referenced",
    f"""select s.id from symbols s join (select l.to_id, bool_and(coalesce(regexp_matches(f.file_path, '(?i)\\.(ts|tsx|js|jsx|mjs|cjs|py|go|rb|java|php|rs)$') and regexp_matches(f.file_path, '[/\\\\]tests?[/\\\\]|\\.(?i:test|spec)\\.'), false)) as only_tests
      from links l left join symbols f on f.id = l.from_id where l.type <> 'contains' group by 1) x on x.to_id = s.id and x.only_tests where s.exported and s.kind <> 'section' and not {_like('s.file_path', paths.FRAMEWORK_LIKE)}""",
)
def a05_test_only_referenced(spark, sf_dir):
    return lookup.test_only(adapter.links(spark, sf_dir), adapter.symbols(spark, sf_dir)).select("id")


@query("a06_usage_by_tool", "select tool, count(*) as calls, cast(trunc(avg(duration_ms)) as int) as avg_ms, cast(sum(tokens_out) as bigint) as tokens_out, cast(sum(tokens_saved) as bigint) as tokens_saved from tool_usage group by tool")
def a06_usage_by_tool(spark, sf_dir):
    return usage.by_tool(adapter.tool_usage(spark, sf_dir))


@query("a06_usage_by_day", "select * from (select cast(called_at as date) as day, count(*) as calls from tool_usage group by 1 order by 1 desc limit 30) d order by day")
@query("f14_day_bucket", "select * from (select cast(called_at as date) as day, count(*) as calls from tool_usage group by 1 order by 1 desc limit 30) d order by day")
def a06_usage_by_day(spark, sf_dir):
    return usage.by_day(adapter.tool_usage(spark, sf_dir), 30)


@query("a06_usage_recent", "select id, tool, called_at from tool_usage order by called_at desc, id desc limit 50")
def a06_usage_recent(spark, sf_dir):
    return adapter.tool_usage(spark, sf_dir).select("id", "tool", "called_at").orderBy(F.desc("called_at"), F.desc("id")).limit(50)


@query("a06_usage_totals", "select count(*) as calls, count(distinct tool) as tools, count(distinct repo) as repos, cast(sum(tokens_saved) as bigint) as saved from tool_usage where repo <> 'u1'")
def a06_usage_totals(spark, sf_dir):
    return adapter.tool_usage(spark, sf_dir).filter("repo <> 'u1'").agg(F.count("*").alias("calls"), F.count_distinct("tool").alias("tools"), F.count_distinct("repo").alias("repos"), F.sum("tokens_saved").alias("saved"))


@query("a07_dependent_files", f"select l.to_id as id, count(distinct s.file_path) as files, count(distinct s.file_path) filter (not {TEST.replace('file_path', 's.file_path')}) as production_files from links l join symbols s on s.id = l.from_id where l.type <> 'contains' group by 1")
def a07_dependent_files(spark, sf_dir):
    seen = enrich.with_files(adapter.links(spark, sf_dir), adapter.symbols(spark, sf_dir)).filter("from_file is not null")
    return seen.groupBy(F.col("to_id").alias("id")).agg(F.count_distinct("from_file").alias("files"), F.count_distinct(F.when(~paths.is_test_file(F.col("from_file")), F.col("from_file"))).alias("production_files"))


@query("a08_fans", "select coalesce(i.id, o.id) as id, coalesce(i.n, 0) as fan_in, coalesce(o.n, 0) as fan_out from (select to_id as id, count(*) as n from fan group by 1) i full join (select from_id as id, count(*) as n from fan group by 1) o on o.id = i.id")
def a08_fans(spark, sf_dir):
    into, out = enrich.fans(adapter.links(spark, sf_dir), adapter.symbols(spark, sf_dir))
    return into.join(out, "id", "full_outer").fillna(0)


@query("a09_caller_files", "select id, runtime_files, type_files, test_files from callers")
def a09_caller_files(spark, sf_dir):
    return enrich.caller_files(adapter.links(spark, sf_dir), adapter.symbols(spark, sf_dir))


COVERAGE = f"""select count(distinct file_path) filter (test) as test_files, count(*) filter (exported and not test) as exported,
  (select count(distinct to_id) from links where type <> 'contains' and from_id in (select id from marked where test) and to_id not in (select id from marked where test)) as tested from marked"""
MARKED = {"marked": f"select id, file_path, exported, {TEST} as test from symbols"}


@query("a10_test_coverage", COVERAGE, MARKED)
def a10_test_coverage(spark, sf_dir):
    return enrich.coverage(adapter.symbols(spark, sf_dir), adapter.links(spark, sf_dir)).drop("coverage_pct")


@query("a11_coverage_pct", f"select case when exported > 0 then cast(floor(100.0 * tested / exported + 0.5) as bigint) else 0 end as coverage_pct from ({COVERAGE}) c", MARKED)
def a11_coverage_pct(spark, sf_dir):
    return enrich.coverage(adapter.symbols(spark, sf_dir), adapter.links(spark, sf_dir)).select("coverage_pct")


@query("a12_file_edges", "select file_a, file_b, weight from file_edges")
def a12_file_edges(spark, sf_dir):
    return enrich.file_edges(adapter.symbols(spark, sf_dir), adapter.links(spark, sf_dir))


@query("a12_strong_degrees", "select file, count(*) as degree from (select file_a as file from file_edges where weight >= 2 union all select file_b from file_edges where weight >= 2) x group by file")
def a12_strong_degrees(spark, sf_dir):
    return enrich.strong_degrees(enrich.file_edges(adapter.symbols(spark, sf_dir), adapter.links(spark, sf_dir)))


@query("a13_common_folder", "select kind, folder, n from (select kind, split_part(file_path, '/', -2) as folder, count(*) as n, row_number() over (partition by kind order by count(*) desc, split_part(file_path, '/', -2)) as r from symbols group by 1, 2) x where r = 1")
def a13_common_folder(spark, sf_dir):
    s = adapter.symbols(spark, sf_dir).groupBy("kind", paths.directory_segment(F.col("file_path")).alias("folder")).agg(F.count("*").alias("n"))
    return s.withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "folder"))).filter("r = 1").drop("r")


@query("a16_confidence_histogram", "select case when confidence < 0.4 then 'unsure' when confidence < 0.7 then 'low' when confidence < 0.9 then 'medium' else 'high' end as band, count(*) as n from links group by 1")
def a16_confidence_histogram(spark, sf_dir):
    c = F.col("confidence")
    return adapter.links(spark, sf_dir).groupBy(F.when(c < 0.4, "unsure").when(c < 0.7, "low").when(c < 0.9, "medium").otherwise("high").alias("band")).agg(F.count("*").alias("n"))


@query("a19_dedupe_links", "select from_id, to_id, type, arg_min(line, line) as first_line, list_sort(list(distinct line)) as lines, max(confidence) as confidence from (select 'o' || l_orderkey as from_id, 'p' || (l_partkey % 50) as to_id, 'references' as type, l_linenumber as line, (35 + 10 * (l_suppkey % 7)) / 1e2 as confidence from lineitem) x group by 1, 2, 3")
def a19_dedupe_links(spark, sf_dir):
    raw = adapter.table(spark, sf_dir, "lineitem").selectExpr("'o' || l_orderkey as from_id", "'p' || (l_partkey % 50) as to_id", "'references' as type", "l_linenumber as line", "(35 + 10 * (l_suppkey % 7)) / 1e2D as confidence")
    return usage.dedupe_links(raw)


AREA = "case when len(string_split(file_path, '/')) <= 1 then 'root' when split_part(file_path, '/', 1) = 'src' then case when len(string_split(file_path, '/')) > 2 then split_part(file_path, '/', 2) else 'root' end else split_part(file_path, '/', 1) end"


@query("a20_areas", f"select {AREA} as area, count(distinct file_path) as files, count(*) as symbols, count(*) filter (exported) as exported from symbols group by 1")
@query("f22_area_name", f"select {AREA} as area, count(distinct file_path) as files, count(*) as symbols, count(*) filter (exported) as exported from symbols group by 1")
def a20_areas(spark, sf_dir):
    s = adapter.symbols(spark, sf_dir)
    return s.groupBy(paths.area(F.col("file_path")).alias("area")).agg(F.count_distinct("file_path").alias("files"), F.count("*").alias("symbols"), F.count_if("exported").alias("exported"))


@query("a20_cross_area", f"select a.area as area, b.area as used_area, count(*) as n from refs l join (select id, {AREA} as area from symbols) a on a.id = l.from_id join (select id, {AREA} as area from symbols) b on b.id = l.to_id where a.area <> b.area group by 1, 2")
def a20_cross_area(spark, sf_dir):
    s = adapter.symbols(spark, sf_dir).select("id", paths.area(F.col("file_path")).alias("area"))
    refs = adapter.references(spark, sf_dir)
    wide = refs.join(s.select(F.col("id").alias("from_id"), "area"), "from_id").join(s.select(F.col("id").alias("to_id"), F.col("area").alias("used_area")), "to_id")
    return wide.filter("area <> used_area").groupBy("area", "used_area").agg(F.count("*").alias("n"))


@query("a21_dependents", "select to_id as id, count(distinct from_id) as dependents from refs group by 1")
def a21_dependents(spark, sf_dir):
    return adapter.references(spark, sf_dir).groupBy(F.col("to_id").alias("id")).agg(F.count_distinct("from_id").alias("dependents"))


@query(
    "a22_quality_metrics",
    """select 'TER' as metric, round(case when t = 0 then 1e0 else o / t end, 6) as value from u union all select 'LR', round(case when t = 0 then 0e0 else sv / t end, 6) from u
      union all select 'DCER', round(d.dead / x.exported, 6) from dead d, exp x union all select 'CTR', round(1e0 - case when t > 0 then greatest(5e0, 45e0 * (1e0 - o / t)) else 45e0 end / 45e0, 6) from u""",
    {
        "u": "select cast(sum(tokens_out) as double) as o, cast(sum(tokens_saved) as double) as sv, cast(sum(tokens_out) + sum(tokens_saved) as double) as t from tool_usage",
        "dead": f"select cast(least(count(*), 100) as double) as dead from symbols s where s.exported and s.id not in (select to_id from links where type <> 'contains') and not {_like('s.file_path', paths.FRAMEWORK_LIKE)}",
        "exp": "select cast(count(*) as double) as exported from symbols where exported",
    },
)
def a22_quality_metrics(spark, sf_dir):
    return usage.quality_metrics(adapter.tool_usage(spark, sf_dir), adapter.symbols(spark, sf_dir), adapter.links(spark, sf_dir))


@query("a24_resolution_states", "select case when confidence >= 0.9 then 'resolved' when confidence >= 0.7 then 'probable' else 'ambiguous' end as state, count(*) as n from refs group by 1")
@query("f10_resolution_state", "select case when confidence >= 0.9 then 'resolved' when confidence >= 0.7 then 'probable' else 'ambiguous' end as state, count(*) as n from refs group by 1")
def a24_resolution_states(spark, sf_dir):
    return adapter.references(spark, sf_dir).groupBy(paths.resolution_state(F.col("confidence")).alias("state")).agg(F.count("*").alias("n"))


@query("a25_metric_trend", "select name, current, previous, current - previous as delta from (select event_type as name, max(value) filter (r = 1) as current, max(value) filter (r = 2) as previous from (select event_type, value, row_number() over (partition by event_type order by ts desc, event_id desc) as r from events) x group by 1) y")
def a25_metric_trend(spark, sf_dir):
    e = adapter.table(spark, sf_dir, "events").selectExpr("event_type as name", "value", "ts as recorded_at", "event_id as id")
    return usage.metric_trend(e)


@query("a26_metric_snapshot", "select 'symbols' as metric_name, cast(count(*) as double) as value from symbols union all select 'links', cast(count(*) as double) from links union all select 'exported', cast(count(*) filter (exported) as double) from symbols union all select 'files', cast(count(distinct file_path) as double) from symbols union all select 'ambiguous', cast(count(*) filter (confidence < 0.7) as double) from links")
def a26_metric_snapshot(spark, sf_dir):
    return usage.metric_snapshot(adapter.symbols(spark, sf_dir), adapter.links(spark, sf_dir))


@query("i20_metric_history", f"select event_id as id, event_type as name, value, ts as recorded_at from events where event_type = 'purchase' and ts >= timestamp '{adapter.NOW}' - interval 10 day")
@query("f15_relative_time", f"select event_id as id, event_type as name, value, ts as recorded_at from events where event_type = 'purchase' and ts >= timestamp '{adapter.NOW}' - interval 10 day")
def i20_metric_history(spark, sf_dir):
    e = adapter.table(spark, sf_dir, "events").selectExpr("event_id as id", "event_type as name", "value", "ts as recorded_at")
    return usage.metric_history(e, "purchase", 10, adapter.NOW)


@query("o01_top_hubs", "select id, name, heat from enriched where exported order by heat desc, id limit 20")
def o01_top_hubs(spark, sf_dir):
    e = enrich.enrich(adapter.symbols(spark, sf_dir), adapter.links(spark, sf_dir))
    return e.filter("exported").select("id", "name", "heat").orderBy(F.desc("heat"), "id").limit(20)


@query("o02_entrypoints", "select id, name, heat from enriched where exported and role = 'entrypoint' order by heat desc, id limit 50")
def o02_entrypoints(spark, sf_dir):
    e = enrich.enrich(adapter.symbols(spark, sf_dir), adapter.links(spark, sf_dir))
    return e.filter("exported and role = 'entrypoint'").select("id", "name", "heat").orderBy(F.desc("heat"), "id").limit(50)


@query("o03_file_page", "select id, name, start_line from symbols where file_path = 'src/supply/s1.ts' order by start_line, id limit 10 offset 5")
def o03_file_page(spark, sf_dir):
    return adapter.symbols(spark, sf_dir).filter("file_path = 'src/supply/s1.ts'").select("id", "name", "start_line").orderBy("start_line", "id").offset(5).limit(10)


@query("o07_context_sides", "select side, id, heat from (select x.side, e.id, e.heat, row_number() over (partition by x.side order by e.heat desc, e.id) as r from (select distinct 'in' as side, from_id as id from refs where to_id = 'n3' union select 'out', to_id from refs where from_id = 'n3') x join enriched e on e.id = x.id) y where r <= 50")
def o07_context_sides(spark, sf_dir):
    links, refs = adapter.links(spark, sf_dir), adapter.references(spark, sf_dir)
    e = enrich.enrich(adapter.symbols(spark, sf_dir), links).select("id", "heat")
    return usage.context_sides(refs, e, "n3", 50)


@query("f01_lookups", "select 'name' as by_what, id from symbols where name = 'order_7' union all select 'file', id from symbols where file_path = 'src/geo/n2.ts' union all select 'id', id from symbols where id = 'c3'")
def f01_lookups(spark, sf_dir):
    s = adapter.symbols(spark, sf_dir)
    part = lambda name, c: s.filter(c).select(F.lit(name).alias("by_what"), "id")
    return part("name", F.col("name") == "order_7").unionAll(part("file", F.col("file_path") == "src/geo/n2.ts")).unionAll(part("id", F.col("id") == "c3"))


@query("f02_like_tests", f"select file_path, count(*) as n from symbols where {_like('file_path', paths.TEST_LIKE)} group by 1")
def f02_like_tests(spark, sf_dir):
    return adapter.symbols(spark, sf_dir).filter(paths.any_like(F.col("file_path"), paths.TEST_LIKE)).groupBy("file_path").agg(F.count("*").alias("n"))


#: Paths of 18 shapes, one for each part.
SHAPES = "(values (0, 'app/x#/page.tsx', 'Page'), (1, 'web#/app/metadata.ts', 'metadata'), (2, 'src/contests/a#.ts', 'a'), (3, 'test/a#.md', 'b'), (4, 'src/test/b#.py', 'c'), (5, 'test_x#.py', 'd'), (6, 'a#/test_y.py', 'e'), (7, 'x#_test.go', 'f'), (8, 'src/__tests__/g#.ts', 'g'), (9, 'A#.Test.ts', 'h'), (10, 'b#.spec.jsx', 'i'), (11, 'lib/fixtures/j#.ts', 'j'), (12, 'dist/k#.ts', 'k'), (13, 'docs/l#.md', 'l'), (14, 'api/m#.py', 'm'), (15, 'src#/routes/+page.svelte', 'n'), (16, 'n#.vue', 'o'), (17, 'noext#', 'p')) as v(i, shape, name)"
SAMPLE = f"select replace(v.shape, '#', '' || p_partkey) as file_path, v.name from {{part}} join {SHAPES} on p_partkey % 18 = v.i"


@query(
    "f03_f08_path_predicates",
    f"""select file_path, {_like('file_path', paths.FRAMEWORK_LIKE)} or ({_like('file_path', ('app/%', '%/app/%'))} and name in ('metadata', 'viewport', 'revalidate', 'dynamic', 'runtime')) as framework, {TEST} as test,
      regexp_matches(file_path, '\\.(test|spec)\\.[jt]sx?$|^tests?[/\\\\]|__tests__[/\\\\]|_test\\.(go|py|rb|rs|java|php)$|(^|/)test_[^/]*\\.py$') as shown,
      regexp_matches(file_path, '(?i)\\.(ts|tsx|js|jsx|mjs|cjs|py|go|rb|java|php|rs)$') and regexp_matches(file_path, '[/\\\\]tests?[/\\\\]|\\.(?i:test|spec)\\.') as stored,
      contains(file_path, '/test/') or contains(file_path, '.test.') or contains(file_path, '.spec.') as plan, {TEST} or regexp_matches(file_path, '(^|[/\\\\])fixtures[/\\\\]') as fixture,
      regexp_matches(file_path, '(^|/)(node_modules|dist|build|coverage|__pycache__|\\.venv|\\.git)/') or not regexp_matches(file_path, '(?i)\\.(ts|tsx|js|jsx|mjs|cjs|py|go|rs|rb|php|java|vue)$') as non_source from sample""",
    {"sample": SAMPLE.format(part="part")},
)
def f03_f08_path_predicates(spark, sf_dir):
    p = F.col("file_path")
    return spark.sql(SAMPLE.format(**adapter.spark_names(sf_dir))).select(
        p, paths.is_framework_entry(p, F.col("name")).alias("framework"), paths.is_test_file(p).alias("test"), paths.is_test_file_shown(p).alias("shown"), paths.is_test_file_stored(p).alias("stored"),
        paths.is_test_plan_file(p).alias("plan"), paths.is_fixture_or_test(p).alias("fixture"), paths.is_non_source(p).alias("non_source"),
    )


@query("f09_globs", "select file_path from sample where regexp_matches(lower(file_path), '^src/.*/[^/]*\\.(?:ts|py)$')", {"sample": SAMPLE.format(part="part")})
def f09_globs(spark, sf_dir):
    return spark.sql(SAMPLE.format(**adapter.spark_names(sf_dir))).filter(F.col("file_path").rlike(paths.glob_to_regex("src/**/*.{ts,py}"))).select("file_path")


@query("f11_json", "select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k from events")
def f11_json(spark, sf_dir):
    return adapter.table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint", {"mode": "PERMISSIVE"})["k"].alias("k"))


@query("f12_int_lists", "select l_orderkey, array_to_string(list_sort(list(l_linenumber)), ',') as lines, cast(sum(l_linenumber) as bigint) as total from lineitem group by 1")
def f12_int_lists(spark, sf_dir):
    text = adapter.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list("l_linenumber")), ",").alias("lines"))
    numbers = F.transform(F.split("lines", ","), lambda x: x.try_cast("bigint"))
    return text.select("l_orderkey", "lines", F.aggregate(numbers, F.lit(0).cast("bigint"), lambda a, b: a + b).alias("total"))


@query("f13_file_hash", "select doc_id, substr(sha256(text), 1, 16) as hash from documents")
def f13_file_hash(spark, sf_dir):
    return adapter.table(spark, sf_dir, "documents").select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("hash"))


@query("f16_truncated_average", "select tool, coalesce(cast(trunc(avg(duration_ms)) as int), 0) as avg_ms, case when avg(duration_ms) > 50 then 'slow' else 'fast' end as pace from tool_usage group by 1")
def f16_truncated_average(spark, sf_dir):
    mean = F.avg("duration_ms")
    return adapter.tool_usage(spark, sf_dir).groupBy("tool").agg(F.coalesce(mean.cast("int"), F.lit(0)).alias("avg_ms"), F.when(mean > 50, "slow").otherwise("fast").alias("pace"))


@query("f17_qualified_names", "select s.id, p.name || '.' || s.name as qualified from symbols s join symbols p on p.id = s.parent_id")
def f17_qualified_names(spark, sf_dir):
    s = adapter.symbols(spark, sf_dir)
    parents = s.select(F.col("id").alias("parent_id"), F.col("name").alias("parent"))
    return s.join(parents, "parent_id").select("id", F.concat_ws(".", "parent", "name").alias("qualified"))


@query("f18_text_functions", "select doc_id, lower(substr(trim(text), 1, 20)) as head, len(string_split(text, chr(10))) as lines, rpad(lang, 4, '.') as lang4, case when strpos(text, '.') > 0 then len(string_split(substr(text, 1, strpos(text, '.')), chr(10))) end as line_of_dot from documents")
def f18_text_functions(spark, sf_dir):
    d = adapter.table(spark, sf_dir, "documents")
    dot = F.instr("text", ".")
    return d.select(
        "doc_id", F.lower(F.substring(F.trim("text"), 1, 20)).alias("head"), F.size(F.split("text", "\n")).cast("long").alias("lines"), F.rpad("lang", 4, ".").alias("lang4"),
        F.when(dot > 0, F.size(F.split(F.substr("text", F.lit(1), dot), "\n")).cast("long")).alias("line_of_dot"),
    )


@query("f19_math", "select p_partkey, round(log2(p_size + 1.0), 6) as l2, round(sqrt(p_retailprice), 6) as root, round(ln(p_retailprice), 6) as nat, xor(p_partkey, 40503) as mixed, (p_partkey * 16777619) % 4294967296 as product, greatest(p_size, 10) as most from part")
def f19_math(spark, sf_dir):
    p = adapter.table(spark, sf_dir, "part")
    return p.select("p_partkey", F.round(F.log2(F.col("p_size") + 1.0), 6).alias("l2"), F.round(F.sqrt("p_retailprice"), 6).alias("root"), F.round(F.ln("p_retailprice"), 6).alias("nat"), F.col("p_partkey").bitwiseXOR(F.lit(40503)).alias("mixed"), (F.col("p_partkey") * 16777619 % 4294967296).alias("product"), F.greatest("p_size", F.lit(10)).alias("most"))


@query("f20_redaction", "select n_name, case when length(n_name) <= 8 then '****' else left(n_name, 2) || '****' || right(n_name, 2) || ' [redacted]' end as shown from nation")
def f20_redaction(spark, sf_dir):
    return adapter.table(spark, sf_dir, "nation").select("n_name", paths.redact(F.col("n_name")).alias("shown"))


@query("f23_domain_segments", "select distinct file_path, split_part(file_path, '/', -2) as leaf from symbols")
def f23_domain_segments(spark, sf_dir):
    return adapter.symbols(spark, sf_dir).select("file_path", paths.directory_segment(F.col("file_path")).alias("leaf")).distinct()


#: Patterns that users may ask for, by the number of an event.
SHAPES = ["'(' || event_type || '+)+'", "event_type || '.*' || user_id", "'(' || event_type || '|b)*'", "'(((' || event_type || ')))' || '(x)'", "'((((' || event_type || '))))'", "'^[a-z]+$' || event_id", "repeat(event_type, 40)", "'(a)' || '(' || event_type || '[\\\\1])*'", "'(a\\\\1' || event_type || '){2}'"]


@query(
    "f24_regex_guard",
    "select event_id, pattern, safe from (select event_id, case " + " ".join(f"when event_id % 9 = {i} then {shape}" for i, shape in enumerate(SHAPES)).replace("\\\\", "\\") + " end as pattern, event_id % 9 in (1, 3, 5) or (event_id % 9 = 6 and length(event_type) <= 5) as safe from events) x",
)
def f24_regex_guard(spark, sf_dir):
    shape = F.coalesce(*[F.when(F.col("event_id") % 9 == i, F.expr(shape)) for i, shape in enumerate(SHAPES)])
    return adapter.table(spark, sf_dir, "events").select("event_id", shape.alias("pattern"), paths.is_safe_pattern(shape).alias("safe"))


CODE = "select replace(v.shape, '#', '' || p_partkey) as line from {part} join (values (0, 'import os#'), (1, '  from a# import b'), (2, 'use std::io#;'), (3, 'const x# = require(1)'), (4, 'export async function f#() {{'), (5, 'class A#:'), (6, 'pub fn g#()'), (7, 'return import#'), (8, '')) as v(i, shape) on p_partkey % 9 = v.i"


@query("f25_line_scopes", "select line, regexp_matches(ltrim(line), '^(import\\s|from\\s|require\\(|use\\s|include\\s|require_relative|require\\s)') as imports, regexp_matches(ltrim(line), '^(export\\s+)?(async\\s+)?(function|class|interface|type|enum|struct|trait|const|let|var|def|fn|pub\\s+fn|pub\\s+struct|pub\\s+enum|module)\\s') as defines from code", {"code": CODE.format(part="part")})
def f25_line_scopes(spark, sf_dir):
    t = F.ltrim("line")
    return spark.sql(CODE.format(**adapter.spark_names(sf_dir))).select("line", t.rlike(paths.IMPORT_LINE).alias("imports"), t.rlike(paths.DEFINITION_LINE).alias("defines"))


@query("f26_formats", "select id, name || ' [' || kind || ']' as short, name || ' [' || kind || '] ' || file_path || ':' || start_line as full_text from symbols where kind = 'interface'")
def f26_formats(spark, sf_dir):
    return adapter.symbols(spark, sf_dir).filter("kind = 'interface'").select("id", F.format_string("%s [%s]", "name", "kind").alias("short"), F.format_string("%s [%s] %s:%d", "name", "kind", "file_path", "start_line").alias("full_text"))


@query("f27_token_estimate", "select doc_id, cast(ceil(length(text) / 4e0) as bigint) as tokens, cast(ceil(length(text) / 4e0) as bigint) * case lang when 'en' then 2 when 'de' then 4 else 1 end as saved from documents")
def f27_token_estimate(spark, sf_dir):
    tokens = F.ceil(F.length("text") / 4.0).cast("bigint")
    return adapter.table(spark, sf_dir, "documents").select("doc_id", tokens.alias("tokens"), (tokens * F.when(F.col("lang") == "en", 2).when(F.col("lang") == "de", 4).otherwise(1)).alias("saved"))


@query("f29_clamp", "select event_id, least(greatest(value / 100e0, 0e0), 1e0) as confidence from events")
def f29_clamp(spark, sf_dir):
    return adapter.table(spark, sf_dir, "events").select("event_id", F.least(F.greatest(F.col("value") / 100.0, F.lit(0.0)), F.lit(1.0)).alias("confidence"))


@query("u01_union_distinct", "select from_id as id from refs union select to_id from refs")
def u01_union_distinct(spark, sf_dir):
    r = adapter.references(spark, sf_dir)
    return r.select(F.col("from_id").alias("id")).union(r.select("to_id")).distinct()


@query("u02_union_all", "select count(*) as n, count(distinct id) as ids from (select from_id as id from refs union all select to_id from refs union all select id from symbols union all select parent_id from symbols where parent_id is not null) x")
def u02_union_all(spark, sf_dir):
    r, s = adapter.references(spark, sf_dir), adapter.symbols(spark, sf_dir)
    every = r.select(F.col("from_id").alias("id")).unionAll(r.select("to_id")).unionAll(s.select("id")).unionAll(s.filter("parent_id is not null").select("parent_id"))
    return every.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


@query("u03_merged_lists", "select c_mktsegment, count(distinct x) as n from (select c_mktsegment, c_nationkey as x from customer union select c_mktsegment, cast(c_custkey % 40 as int) from customer) y group by 1")
def u03_merged_lists(spark, sf_dir):
    c = adapter.table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.collect_set("c_nationkey").alias("a"), F.collect_set((F.col("c_custkey") % 40).cast("int")).alias("b"))
    return c.select("c_mktsegment", F.size(F.array_union("a", "b")).cast("long").alias("n"))


@query("u04_symmetric_difference", "select o.name from (select n_name as name from nation where n_nationkey % 2 = 0) o full join (select n_name as name from nation where n_nationkey % 3 = 0) n on o.name = n.name where n.name is null union select n.name from (select n_name as name from nation where n_nationkey % 2 = 0) o right join (select n_name as name from nation where n_nationkey % 3 = 0) n on o.name = n.name where o.name is null")
def u04_symmetric_difference(spark, sf_dir):
    n = adapter.table(spark, sf_dir, "nation")
    old, new = (n.filter(c).select(F.col("n_name").alias("name")) for c in ("n_nationkey % 2 = 0", "n_nationkey % 3 = 0"))
    return old.subtract(new).union(new.subtract(old))


@query("u06_distinct_files", "select distinct file_path from symbols")
def u06_distinct_files(spark, sf_dir):
    return adapter.symbols(spark, sf_dir).select("file_path").distinct()
