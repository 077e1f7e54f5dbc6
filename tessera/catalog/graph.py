"""Traversals and joins over the code graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog.registry import TEST, _like, query
from tessera.functions import paths
from tessera.operators import enrich, lookup, spans, traverse
from tessera.sources import adapter

START, METHOD_NATION, ORDER_ID = "n3", "n7", "o5"


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return adapter.links(spark, sf_dir), adapter.symbols(spark, sf_dir)


def _one(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id string")


def _walk_sql(near: str, far: str, types: tuple[str, ...], depth: int, starts: str) -> str:
    kinds = ", ".join(f"'{t}'" for t in types)
    return f"""select {far} as id, 1 as depth, type as via from links where {near} in ({starts}) and type in ({kinds})
      union select l.{far}, w.depth + 1, l.type from links l join walked w on l.{near} = w.id where l.type in ({kinds}) and w.depth < {depth}"""


HYDRATED = "select distinct s.id, s.name, s.kind, s.file_path, w.depth, w.via from walked w join symbols s on s.id = w.id"


@query("t01_upstream", HYDRATED, {"walked": _walk_sql("to_id", "from_id", traverse.IMPACT, 3, f"'{START}'")})
def t01_upstream(spark, sf_dir):
    links, symbols = _graph(spark, sf_dir)
    return traverse.hydrate(traverse.walk(links, _one(spark, START), traverse.IMPACT, 3), symbols)


def _simple_sql(types: tuple[str, ...], depth: int, start: str) -> str:
    kinds = ", ".join(f"'{t}'" for t in types)
    return f"""select to_id as id, 1 as depth, type as via, [to_id] as path from links where from_id = '{start}' and type in ({kinds})
      union select l.to_id, w.depth + 1, l.type, list_append(w.path, l.to_id) from links l join walked w on l.from_id = w.id where l.type in ({kinds}) and w.depth < {depth} and not list_contains(w.path, l.to_id)"""


@query("t02_downstream", HYDRATED, {"walked": _simple_sql(traverse.IMPACT, 3, ORDER_ID)})
def t02_downstream(spark, sf_dir):
    links, symbols = _graph(spark, sf_dir)
    return traverse.hydrate(traverse.simple_walk(links, _one(spark, ORDER_ID), traverse.IMPACT, 3), symbols)


@query("t03_downstream_exec", HYDRATED, {"walked": _simple_sql(traverse.EXECUTION, 3, ORDER_ID)})
def t03_downstream_exec(spark, sf_dir):
    links, symbols = _graph(spark, sf_dir)
    return traverse.hydrate(traverse.simple_walk(links, _one(spark, ORDER_ID), traverse.EXECUTION, 3), symbols)


@query(
    "t04_type_hierarchy",
    "select distinct 'descendant' as side, s.id, s.name, s.kind, w.depth, w.via from walked w join symbols s on s.id = w.id union all select distinct 'ancestor', s.id, s.name, s.kind, w.depth, w.via from climbed w join symbols s on s.id = w.id",
    {"walked": _walk_sql("to_id", "from_id", traverse.HIERARCHY, 10, f"'{METHOD_NATION}'"), "climbed": _walk_sql("from_id", "to_id", traverse.HIERARCHY, 10, f"'{METHOD_NATION}'").replace("walked", "climbed")},
)
def t04_type_hierarchy(spark, sf_dir):
    links, symbols = _graph(spark, sf_dir)
    start = _one(spark, METHOD_NATION)
    side = lambda name, up: traverse.hydrate(traverse.walk(links, start, traverse.HIERARCHY, 10, up), symbols).select(F.lit(name).alias("side"), "id", "name", "kind", "depth", "via")
    return side("descendant", True).unionAll(side("ancestor", False))


@query(
    "t05_shortest_path",
    "select array_to_string(path, '>') as path, cast(len(path) - 1 as bigint) as hops from routes where path[-1] = 'r1' order by hops, 1 limit 1",
    {
        "steps": "select distinct from_id, to_id from links where type <> 'contains' union select to_id, from_id from links where type = 'contains'",
        "routes": f"""select [from_id, to_id] as path from links where from_id = '{ORDER_ID}' and type <> 'contains'
          union select list_append(r.path, s.to_id) from routes r join steps s on s.from_id = r.path[-1] where len(r.path) <= 5 and r.path[-1] <> 'r1' and not list_contains(r.path, s.to_id)""",
    },
)
def t05_shortest_path(spark, sf_dir):
    return traverse.shortest_path(adapter.links(spark, sf_dir), ORDER_ID, "r1")


@query(
    "t06_trace_to_entrypoints",
    "select array_to_string(path, '>') as path, cast(len(path) - 1 as bigint) as hops from routes r where path[1] not in (select to_id from links where type in ('calls', 'imports')) and path[1] in (select id from symbols where exported) order by hops, 1 limit 5",
    {"routes": "select ['c1'] as path union select list_prepend(l.from_id, r.path) from routes r join links l on l.to_id = r.path[1] where l.type in ('calls', 'imports') and len(r.path) <= 8 and not list_contains(r.path, l.from_id)"},
)
def t06_trace_to_entrypoints(spark, sf_dir):
    links, symbols = _graph(spark, sf_dir)
    return traverse.entry_paths(links, symbols, "c1")


@query(
    "t07_test_impact",
    f"select distinct s.file_path from walked w join symbols s on s.id = w.id where {_like('s.file_path', paths.IMPACT_LIKE)} union select s.file_path from links l join symbols s on s.id = l.from_id where l.to_id in ('c1', 'c2', 'n3') and {_like('s.file_path', paths.IMPACT_LIKE)}",
    {"walked": _walk_sql("to_id", "from_id", ("calls", "imports", "extends", "implements"), 5, "'c1', 'c2', 'n3'")},
)
def t07_test_impact(spark, sf_dir):
    links, symbols = _graph(spark, sf_dir)
    return lookup.test_impact(links, symbols, _one(spark, "c1", "c2", "n3"))


@query(
    "t08_file_clusters",
    "select file, min(to_file) as cluster from reach group by file",
    {
        "hubs": "select file from (select file_a as file from file_edges where weight >= 2 union all select file_b from file_edges where weight >= 2) x group by file having count(*) > 8",
        "joined": "select file_a as a, file_b as b from file_edges where weight >= 2 and file_a not in (select file from hubs) and file_b not in (select file from hubs)",
        "both_ways": "select a, b from joined union select b, a from joined",
        "reach": "select distinct file_path as file, file_path as to_file from symbols union select r.file, e.b from reach r join both_ways e on e.a = r.to_file",
    },
)
def t08_file_clusters(spark, sf_dir):
    links, symbols = _graph(spark, sf_dir)
    return enrich.file_clusters(symbols, links)


CLUSTERS = {
    "hubs": "select file from (select file_a as file from file_edges where weight >= 2 union all select file_b from file_edges where weight >= 2) x group by file having count(*) > 8",
    "joined": "select file_a as a, file_b as b from file_edges where weight >= 2 and file_a not in (select file from hubs) and file_b not in (select file from hubs)",
    "both_ways": "select a, b from joined union select b, a from joined",
    "reach": "select distinct file_path as file, file_path as to_file from symbols union select r.file, e.b from reach r join both_ways e on e.a = r.to_file",
}
GENERAL = "(" + ", ".join(f"'{x}'" for x in enrich.GENERIC_FOLDERS) + ")"


@query(
    "t09_domains",
    f"""select o.file, case when size > greatest({enrich.MOST_FILES}, floor({enrich.MOST_SHARE}e0 * n_files)) then case when o.leaf in {GENERAL} and o.parent is not null then o.parent || '/' || o.leaf else o.leaf end
      when best in {GENERAL} and size > 1 and best_parent is not null then best_parent || '/' || best else best end as domain
      from outlines o join sizes z on z.cluster = o.cluster join leaves l on l.cluster = o.cluster left join parents p on p.cluster = o.cluster, (select count(*) as n_files from outlines) t""",
    {
        **CLUSTERS,
        "outlines": "select file, min(to_file) as cluster, split_part(file, '/', -2) as leaf, case when len(string_split(file, '/')) >= 3 then split_part(file, '/', -3) end as parent from reach group by file",
        "sizes": "select cluster, count(*) as size from outlines group by cluster",
        "leaves": "select cluster, leaf as best from (select cluster, leaf, row_number() over (partition by cluster order by count(*) desc, leaf) as r from outlines group by cluster, leaf) x where r = 1",
        "parents": "select cluster, parent as best_parent from (select o.cluster, o.parent, row_number() over (partition by o.cluster order by count(*) desc, o.parent) as r from outlines o join leaves l on l.cluster = o.cluster and l.best = o.leaf where o.parent is not null group by o.cluster, o.parent) x where r = 1",
    },
)
def t09_domains(spark, sf_dir):
    links, symbols = _graph(spark, sf_dir)
    return enrich.domains(enrich.file_clusters(symbols, links))


@query("t10_t12_enriched", "select id, fan_in, fan_out, runtime_files, type_files, test_files, role, heat, importance from enriched")
def t10_t12_enriched(spark, sf_dir):
    links, symbols = _graph(spark, sf_dir)
    return enrich.enrich(symbols, links).select("id", "fan_in", "fan_out", "runtime_files", "type_files", "test_files", "role", "heat", "importance")


@query("t10_roles", "select role, count(*) as n from enriched group by role")
def t10_roles(spark, sf_dir):
    links, symbols = _graph(spark, sf_dir)
    return enrich.enrich(symbols, links).groupBy("role").agg(F.count("*").alias("n"))


@query("t11_heat", "select heat, count(*) as n from enriched group by heat")
def t11_heat(spark, sf_dir):
    links, symbols = _graph(spark, sf_dir)
    return enrich.enrich(symbols, links).groupBy("heat").agg(F.count("*").alias("n"))


@query("t12_importance", "select importance, count(*) as n from enriched group by importance")
def t12_importance(spark, sf_dir):
    links, symbols = _graph(spark, sf_dir)
    return enrich.enrich(symbols, links).groupBy("importance").agg(F.count("*").alias("n"))


SIMILAR = """select id, floor(s * 100 + 0.5) / 100 as similarity from (
  select n.id, count(*) filter (n.other in (select other from near where id = 'o1')) / cast(count(*) + (select count(*) from near where id = 'o1') - count(*) filter (n.other in (select other from near where id = 'o1')) as double) as s
  from near n join symbols y on y.id = n.id and y.exported where n.id <> 'o1' group by n.id) x where s >= 0.15 order by similarity desc, id limit 10"""
NEAR = {
    "own": "select from_id as id, to_id as other from links where type <> 'contains' union select to_id, from_id from links where type <> 'contains'",
    "near": "select id, other from own union select l.from_id, o.other from links l join symbols s on s.id = l.from_id and s.kind in ('class', 'struct', 'trait') join own o on o.id = l.to_id where l.type = 'contains'",
}


@query("t13_similar", SIMILAR, NEAR)
def t13_similar(spark, sf_dir):
    links, symbols = _graph(spark, sf_dir)
    return traverse.similar(links, symbols, "o1")


@query("v10_find_similar", SIMILAR.replace("'o1'", "'o3'"), NEAR)
def v10_find_similar(spark, sf_dir):
    """As t13, of another function."""
    links, symbols = _graph(spark, sf_dir)
    return traverse.similar(links, symbols, "o3")


@query("j14_shared_neighbours", "select n.id, count(*) as shared from near n join (select other from near where id = 'c5') t on t.other = n.other join symbols y on y.id = n.id and y.exported where n.id <> 'c5' group by n.id", NEAR)
def j14_shared_neighbours(spark, sf_dir):
    """Every exported candidate with what it shares with the target: a join on neighbours, not of all pairs."""
    links, symbols = _graph(spark, sf_dir)
    return traverse.candidates(traverse.neighbours(links, symbols), "c5").join(symbols.filter("exported").select("id"), "id", "left_semi")


@query("u05_jaccard", "select a.id, count(*) filter (b.other is not null) as shared, count(*) as size from near a left join (select other from near where id = 'c5') b on b.other = a.other group by a.id", NEAR)
def u05_jaccard(spark, sf_dir):
    links, symbols = _graph(spark, sf_dir)
    near = traverse.neighbours(links, symbols)
    mine = near.filter("id = 'c5'").select("other", F.lit(True).alias("mine"))
    return near.join(mine, "other", "left").groupBy("id").agg(F.count("mine").alias("shared"), F.count("*").alias("size"))


@query(
    "t16_cross_file_impact",
    f"select distinct s.id, s.file_path, w.depth from walked w join symbols s on s.id = w.id where s.id not in ('c1', 'c2') and not {TEST.replace('file_path', 's.file_path')}",
    {"walked": _walk_sql("to_id", "from_id", traverse.IMPACT, 2, "'c1', 'c2'")},
)
def t16_cross_file_impact(spark, sf_dir):
    links, symbols = _graph(spark, sf_dir)
    return lookup.cross_file_impact(links, symbols, _one(spark, "c1", "c2"))


@query(
    "t17_indirect_coverage",
    "select s.id, coalesce(bool_or(c.node in (select id from tested)), false) as tested from symbols s left join chain c on c.id = s.id where s.kind = 'class' group by s.id",
    {"chain": "select id, id as node from symbols where kind = 'class' union select c.id, s.parent_id from chain c join symbols s on s.id = c.node where s.parent_id is not null and not s.exported"},
)
def t17_indirect_coverage(spark, sf_dir):
    links, symbols = _graph(spark, sf_dir)
    return lookup.indirect_coverage(symbols, lookup.tested_by_like(links, symbols)).filter("kind = 'class'").select("id", "tested")


@query("j01_hydrate", "select l.from_id, l.to_id, l.type, s.name as to_name, s.file_path as to_file from links l join symbols s on s.id = l.to_id where l.type in ('extends', 'implements')")
def j01_hydrate(spark, sf_dir):
    links, symbols = _graph(spark, sf_dir)
    return links.filter("type in ('extends', 'implements')").join(symbols.select(F.col("id").alias("to_id"), F.col("name").alias("to_name"), F.col("file_path").alias("to_file")), "to_id").select("from_id", "to_id", "type", "to_name", "to_file")


DEAD = f"select s.id, s.name, s.kind, s.file_path, s.start_line from symbols s where s.exported and s.kind <> 'section' and s.id not in (select to_id from links where type <> 'contains') and not {_like('s.file_path', paths.FRAMEWORK_LIKE)}"


@query("j03_dead_code", DEAD)
def j03_dead_code(spark, sf_dir):
    links, symbols = _graph(spark, sf_dir)
    return lookup.dead_code(links, symbols)


@query("o04_dead_code_top", DEAD + " and s.kind = 'function' order by s.file_path, s.start_line, s.id limit 50")
def o04_dead_code_top(spark, sf_dir):
    links, symbols = _graph(spark, sf_dir)
    return lookup.dead_code(links, symbols, "function").orderBy("file_path", "start_line", "id").limit(50)


GAPS = "select id, name, heat from enriched where exported and heat > 0 and id not in (select id from tested)"


@query("j04_coverage_gaps", GAPS)
def j04_coverage_gaps(spark, sf_dir):
    links, symbols = _graph(spark, sf_dir)
    return lookup.coverage_gaps(links, symbols).select("id", "name", "heat")


@query("k05_gap_risk", f"select id, heat, case when heat > 80 then 'CRITICAL' when heat > 50 then 'HIGH' when heat > 30 then 'MEDIUM' else 'LOW' end as risk from ({GAPS}) g order by heat desc, id limit 100")
def k05_gap_risk(spark, sf_dir):
    links, symbols = _graph(spark, sf_dir)
    gaps = lookup.coverage_gaps(links, symbols)
    risk = F.when(F.col("heat") > 80, "CRITICAL").when(F.col("heat") > 50, "HIGH").when(F.col("heat") > 30, "MEDIUM").otherwise("LOW")
    return gaps.select("id", "heat", risk.alias("risk")).orderBy(F.desc("heat"), "id").limit(100)


#: Two symbols of a component for each part, with a link from the customer's side that imports or calls its module.
VUE = {
    "vs": "select 'p' || p_partkey || '.vue#class' as id, 'P' || p_partkey as name, 'class' as kind, 'p' || p_partkey || case when p_partkey % 5 = 0 then '.ts' else '.vue' end as file_path from {part} union all select 'p' || p_partkey || '.vue#module:_top:0', '_top', 'module', 'p' || p_partkey || case when p_partkey % 5 = 0 then '.ts' else '.vue' end from {part}",
    "vl": "select 'c' || (p_partkey % 9) as from_id, 'p' || p_partkey || '.vue#module:_top:0' as to_id, case p_partkey % 3 when 0 then 'imports' when 1 then 'calls' else 'references' end as type from {part}",
}


@query("j05_component_roots", "select id from vs s where file_path like '%.vue' and kind = 'class' and exists (select 1 from vs t join vl l on l.to_id = t.id and l.type = 'imports' where t.file_path = s.file_path and t.kind = 'module' and t.name = '_top')", {k: v.format(part="part") for k, v in VUE.items()})
def j05_component_roots(spark, sf_dir):
    symbols, links = (spark.sql(VUE[k].format(**adapter.spark_names(sf_dir))) for k in ("vs", "vl"))
    return lookup.component_roots(links, symbols).select("id")


@query("j06_domain_stats", "select split_part(s.file_path, '/', 2) as zone, count(distinct s.file_path) as files, count(c.id) as symbols from symbols s left join (select id from symbols where exported) c on c.id = s.id group by 1")
@query("a03_domain_stats", "select split_part(s.file_path, '/', 2) as zone, count(distinct s.file_path) as files, count(c.id) as symbols from symbols s left join (select id from symbols where exported) c on c.id = s.id group by 1")
def j06_domain_stats(spark, sf_dir):
    symbols = adapter.symbols(spark, sf_dir)
    files = symbols.select("id", "file_path", F.split("file_path", "/")[1].alias("zone"))
    return lookup.domain_stats(files, symbols.filter("exported").select("id"))


LINES = "select file_path, start_line + (start_line % 13) as line from symbols where kind in ('class', 'method', 'function') and start_line % 5 = 1"
INNER = "select file_path, line, id from (select l.file_path, l.line, s.id, row_number() over (partition by l.file_path, l.line order by s.end_line - s.start_line, s.start_line desc, s.id) as r from (select distinct * from ({lines}) q) l join symbols s on s.file_path = l.file_path and l.line between s.start_line and s.end_line) x where r = 1"


@query("j07_innermost_span", INNER.format(lines=LINES))
def j07_innermost_span(spark, sf_dir):
    symbols = adapter.symbols(spark, sf_dir)
    lines = symbols.filter("kind in ('class', 'method', 'function') and start_line % 5 = 1").select("file_path", (F.col("start_line") + F.col("start_line") % 13).alias("line")).distinct()
    return spans.innermost(lines, symbols)


@query(
    "j08_nearest_span",
    """select file_path, line, id from (select l.file_path, l.line, s.id, row_number() over (partition by l.file_path, l.line order by case when l.line between s.start_line and s.end_line then 0 else 1 end, abs(s.start_line - l.line), s.id) as r
      from (select distinct file_path, start_line - 2 as line from symbols where kind = 'method') l join symbols s on s.file_path = l.file_path and (l.line between s.start_line and s.end_line or abs(s.start_line - l.line) <= 3)) x where r = 1""",
)
def j08_nearest_span(spark, sf_dir):
    symbols = adapter.symbols(spark, sf_dir)
    lines = symbols.filter("kind = 'method'").select("file_path", (F.col("start_line") - 2).alias("line")).distinct()
    return spans.nearest_span(lines, symbols)


@query("j13_member_links", "select distinct c.from_id as holder, l.type, l.to_id as other from links c join symbols s on s.id = c.from_id and s.kind in ('class', 'interface') join links l on l.from_id = c.to_id and l.type <> 'contains' where c.type = 'contains'")
def j13_member_links(spark, sf_dir):
    links, symbols = _graph(spark, sf_dir)
    holders = symbols.filter("kind in ('class', 'interface')").select(F.col("id").alias("holder"))
    members = links.filter("type = 'contains'").select(F.col("from_id").alias("holder"), F.col("to_id").alias("from_id")).join(holders, "holder", "left_semi")
    return links.filter("type <> 'contains'").join(members, "from_id").select("holder", "type", F.col("to_id").alias("other")).distinct()


TWO = {"legacy": "select from_id, to_id, type, confidence from refs where type = 'extends'", "scoped": "select from_id, to_id, type, confidence + case when confidence > 0.8 then 0.08 else 0e0 end as confidence from refs where type = 'extends' and from_id not like '%7' union all select 'x1', 'x2', 'calls', 0.5e0"}
DIFF = """select coalesce(l.from_id, s.from_id) as from_id, coalesce(l.to_id, s.to_id) as to_id, coalesce(l.type, s.type) as type, case when s.from_id is null then 'legacy' when l.from_id is null then 'scoped' else 'changed' end as side
  from legacy l full join scoped s on s.from_id = l.from_id and s.to_id = l.to_id and s.type = l.type where l.from_id is null or s.from_id is null or abs(l.confidence - s.confidence) > 0.05"""


def _two(spark, sf_dir):
    legacy = adapter.references(spark, sf_dir).filter("type = 'extends'")
    scoped = legacy.filter("from_id not like '%7'").withColumn("confidence", F.col("confidence") + F.when(F.col("confidence") > 0.8, 0.08).otherwise(0.0))
    return legacy, scoped.unionAll(spark.createDataFrame([("x1", "x2", "calls", 0.5)], scoped.schema))


@query("j18_resolution_diff", DIFF, TWO)
def j18_resolution_diff(spark, sf_dir):
    return lookup.resolution_diff(*_two(spark, sf_dir))


@query("r21_parity", f"select round(1.0e0 - count(*) / cast((select count(*) from legacy) as double), 6) as rate, 1.0e0 - count(*) / cast((select count(*) from legacy) as double) >= 0.99 as reached from ({DIFF}) d", TWO)
def r21_parity(spark, sf_dir):
    legacy, scoped = _two(spark, sf_dir)
    return lookup.parity(legacy, scoped)


SNAP = "select 'gone' as change, o.id from old_snapshot o where o.id not in (select id from new_snapshot) union all select 'new', n.id from new_snapshot n where n.id not in (select id from old_snapshot)"
SNAPS = {"old_snapshot": "select distinct from_id as id from links where to_id = 'n3' and type <> 'contains' and from_id not like '%5'", "new_snapshot": "select distinct from_id as id from links where to_id = 'n3' and type <> 'contains' and from_id not like '%1'"}


@query("j19_snapshot_diff", SNAP, SNAPS)
@query("k11_compare_impact", SNAP, SNAPS)
def j19_snapshot_diff(spark, sf_dir):
    into = adapter.links(spark, sf_dir).filter("to_id = 'n3' and type <> 'contains'").select(F.col("from_id").alias("id")).distinct()
    return lookup.snapshot_diff(into.filter("id not like '%5'"), into.filter("id not like '%1'"))


RISK_SCORE = """cast(case when not exported and dependents = 0 then 0 when not exported and dependents <= 1 then floor(base * 0.4 + 0.5) when not exported and dependents <= 3 then floor(base * 0.65 + 0.5) else floor(base + 0.5) end as bigint)"""
RISK = {
    "risk_base": "select *, (least(heat * 0.3e0, 15e0) + dependents * 3 + case role when 'hub' then 10 when 'entrypoint' then 5 else 0 end) * case when not tested and exported then 1.5e0 else 1e0 end + case when exported and dependents > 0 then 3 else 0 end as base from risk_in",
    "risk": f"select *, {RISK_SCORE} as score from risk_base",
    "leveled": "select *, case when role = 'hub' and not tested and dependents > 10 or score >= 50 then 'CRITICAL' when score >= 30 then 'HIGH' when score >= 10 or not tested then 'MEDIUM' else 'LOW' end as level from risk",
}


@query("k01_symbol_risk", "select id, dependents, tested, score from risk", RISK)
def k01_symbol_risk(spark, sf_dir):
    links, symbols = _graph(spark, sf_dir)
    return lookup.risk(links, symbols).select("id", "dependents", "tested", "score")


@query("k02_risk_level", "select level, count(*) as n from leveled group by level", RISK)
def k02_risk_level(spark, sf_dir):
    links, symbols = _graph(spark, sf_dir)
    return lookup.risk(links, symbols).groupBy("level").agg(F.count("*").alias("n"))


@query("k04_review_symbol", "select id, cast(floor(0.4e0 * heat + 35 * least(dependents / 10e0, 1e0) + case when tested then 0 else 25 end + 0.5) as bigint) as score, case when floor(0.4e0 * heat + 35 * least(dependents / 10e0, 1e0) + case when tested then 0 else 25 end + 0.5) > 75 then 'CRITICAL' when floor(0.4e0 * heat + 35 * least(dependents / 10e0, 1e0) + case when tested then 0 else 25 end + 0.5) > 50 then 'HIGH' when floor(0.4e0 * heat + 35 * least(dependents / 10e0, 1e0) + case when tested then 0 else 25 end + 0.5) > 25 then 'MEDIUM' else 'LOW' end as level from risk_in where kind = 'class'")
def k04_review_symbol(spark, sf_dir):
    links, symbols = _graph(spark, sf_dir)
    return lookup.review_symbol(lookup.risk_inputs(links, symbols)).filter("kind = 'class'").select("id", "score", "level")


@query("k06_review_one", "select id, score, level from leveled where id = 'c1'", RISK)
def k06_review_one(spark, sf_dir):
    links, symbols = _graph(spark, sf_dir)
    return lookup.risk(links, symbols).filter("id = 'c1'").select("id", "score", "level")


@query(
    "k07_edit_gates",
    f"""select id, strict > 5 as impact_blocked, guard > 5 as guard_blocked from (select s.id, count(distinct f.file_path) as strict, count(distinct f.file_path) filter (not {TEST.replace('file_path', 'f.file_path')}) as guard
      from symbols s left join links l on l.to_id = s.id and l.type <> 'contains' left join symbols f on f.id = l.from_id group by s.id) x""",
)
def k07_edit_gates(spark, sf_dir):
    links, symbols = _graph(spark, sf_dir)
    return lookup.edit_gates(links, symbols)


HUNKS = "select 'src/supply/s1.ts' as file_path, 15 as from_line, 60 as to_line union all select 'src/geo/n2.ts', 100, 140"
CHANGED = "select distinct s.id from hunks h join symbols s on s.file_path = h.file_path and s.start_line <= h.to_line and s.end_line >= h.from_line"


@query("k08_detect_changes", "select c.id, coalesce(d.dependents, 0) as dependents from changed c left join dependents d on d.id = c.id", {"hunks": HUNKS, "changed": CHANGED})
def k08_detect_changes(spark, sf_dir):
    links, symbols = _graph(spark, sf_dir)
    return spans.changed_symbols(spark.sql(HUNKS), symbols).select("id").distinct().join(lookup.dependent_files(links, symbols), "id", "left").fillna(0)


REVIEW = {**RISK, "hunks": HUNKS, "changed": CHANGED, "reviewed": "select l.* from leveled l join changed c on c.id = l.id"}


@query("k03_review_pr", "select id, score, level, dependents, tested from reviewed", REVIEW)
def k03_review_pr(spark, sf_dir):
    links, symbols = _graph(spark, sf_dir)
    return lookup.review(links, symbols, spark.sql(HUNKS)).select("id", "score", "level", "dependents", "tested")


@query("a23_review_rollup", "select cast(sum(score) as bigint) as total, count(*) filter (level in ('HIGH', 'CRITICAL')) as hotspots, count(*) filter (not tested) as untested, coalesce(bool_or(role = 'hub' and not tested and dependents > 10), false) as critical_hub from reviewed", REVIEW)
def a23_review_rollup(spark, sf_dir):
    links, symbols = _graph(spark, sf_dir)
    return lookup.review_rollup(lookup.review(links, symbols, spark.sql(HUNKS)))


@query("k09_test_doubles", "select l.from_id as id, l.to_id as dependency, case when d.file_path = s.file_path and d.kind not in ('interface', 'type', 'enum') then 'spy' when l.type = 'imports' then 'stub' else 'mock' end as double_kind from links l join symbols s on s.id = l.from_id join symbols d on d.id = l.to_id where l.type <> 'contains' and s.kind in ('interface', 'type')")
def k09_test_doubles(spark, sf_dir):
    links, symbols = _graph(spark, sf_dir)
    return lookup.test_doubles(links, symbols).filter("kind in ('interface', 'type')").select("id", "dependency", "double_kind")


@query("k10_overview", "select 'callers' as part, count(*) as n from (select distinct id from walked) w union all select 'members', count(*) from links where from_id = 'n3' and type = 'contains' union all select 'dependents', coalesce(max(dependents), 0) from dependents where id = 'n3'", {"walked": _walk_sql("to_id", "from_id", traverse.IMPACT, 3, "'n3'")})
def k10_overview(spark, sf_dir):
    links, symbols = _graph(spark, sf_dir)
    return lookup.overview(links, symbols, "n3")


@query("k12_orchestrate", f"select 'gap' as part, id from (select id from ({GAPS}) g order by heat desc, id limit 10) a union all select 'dead', id from (select id from ({DEAD}) d order by file_path, start_line, id limit 10) b")
def k12_orchestrate(spark, sf_dir):
    links, symbols = _graph(spark, sf_dir)
    gaps = lookup.coverage_gaps(links, symbols).orderBy(F.desc("heat"), "id").limit(10)
    dead = lookup.dead_code(links, symbols).orderBy("file_path", "start_line", "id").limit(10)
    return gaps.select(F.lit("gap").alias("part"), "id").unionAll(dead.select(F.lit("dead").alias("part"), "id"))
