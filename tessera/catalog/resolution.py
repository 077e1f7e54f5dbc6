"""Resolution of facts to links. The facts come from the star-schema tables, as a project whose files import, call and extend each other; the same SQL makes them for both engines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.catalog.registry import query
from tessera.functions import names
from tessera.operators import resolve
from tessera.plans.cut import cut
from tessera.sources import adapter

#: Symbols with names that many share: functions and methods are called alike in many files.
CODE = """select id, case kind when 'function' then 'order_' || ((start_line - 1) / 10 % 50) when 'method' then 'm' || ((start_line - 1) / 10 % 10) when 'type' then 't' || ((start_line - 1) / 10 % 97) else name end as name, kind, file_path, exported, parent_id, start_line from symbols"""
INDEX = "src/geo/index.ts"
FACTS = {
    "code": CODE.replace("(start_line - 1) / 10", "cast(floor((start_line - 1) / 1e1) as int)"),
    # file, name, source, line: an index names every other nation and passes on all of one file through another
    "reexports": f"select '{INDEX}' as file, n_name as name, 'src/geo/n' || (n_nationkey % 5) || '.ts' as source, n_nationkey as line from nation where n_nationkey % 2 = 0 union all select '{INDEX}', '*', 'src/geo/mid.ts', 90 union all select 'src/geo/mid.ts', '*', 'src/geo/n1.ts', 1",
    # file_path, target, name, alias, kind, line
    "imports": f"""select distinct o.file_path, c.file_path as target, c.name, case when x.o_custkey % 4 = 0 then 'A' || x.o_custkey end as alias, 'named' as kind, cast(x.o_custkey % 90 as int) as line from orders x join symbols o on o.id = 'o' || x.o_orderkey join symbols c on c.id = 'c' || x.o_custkey
      union all select distinct c.file_path, n.file_path, 'd', cast(null as VARCHAR), 'default', 1 from symbols c join symbols n on n.id = c.parent_id where c.kind = 'class'
      union all select distinct s.file_path, n.file_path, '*', cast(null as VARCHAR), 'wildcard', 2 from symbols s join symbols n on n.id = s.parent_id where s.kind = 'method'
      union all select distinct s.file_path, '{INDEX}', n.name, cast(null as VARCHAR), 'named', 3 from symbols s join symbols n on n.id = s.parent_id where s.kind = 'method'
      union all select distinct o.file_path, n.file_path, 'dn', cast(null as VARCHAR), 'default', 5 from orders x join symbols o on o.id = 'o' || x.o_orderkey join symbols c on c.id = 'c' || x.o_custkey join symbols n on n.id = c.parent_id
      union all select distinct o.file_path, 'src/supply/s' || (x.o_custkey % 3) || '.ts', n.name, cast(null as VARCHAR), 'named', 7 from orders x join symbols o on o.id = 'o' || x.o_orderkey join symbols c on c.id = 'c' || x.o_custkey join symbols n on n.id = c.parent_id where x.o_orderkey % 11 = 10
      union all select distinct file_path, cast(null as VARCHAR), 'far' || (start_line % 3), cast(null as VARCHAR), 'named', 6 from symbols where kind = 'function'
      union all select distinct file_path, cast(null as VARCHAR), case when start_line % 20 < 10 then 'lib' || (start_line % 7) else './gone' || (start_line % 7) end, cast(null as VARCHAR), 'default', 4 from symbols where kind = 'type'""",
    # call_id, file_path, scope_id, name, receiver, line, argument
    "calls": """select cast(x.o_orderkey as bigint) as call_id, o.file_path, o.id as scope_id,
        case x.o_orderkey % 8 when 0 then case when x.o_custkey % 4 = 0 then 'A' || x.o_custkey else c.name end when 1 then 'order_' || (x.o_orderkey % 60) when 2 then 'm' || (x.o_custkey % 12) when 3 then 'm' || (x.o_custkey % 10) when 4 then 'm' || (x.o_custkey % 10) when 5 then 'print' when 6 then 'nobody' else 'shadow' end as name,
        case x.o_orderkey % 8 when 2 then 'any' when 3 then 'v' when 4 then n.name end as receiver, o.start_line as line, false as argument
      from orders x join symbols o on o.id = 'o' || x.o_orderkey join symbols c on c.id = 'c' || x.o_custkey join symbols n on n.id = c.parent_id
      union all select cast(-start_line as bigint), file_path, id, 'm' || (start_line % 7), 'this', start_line, false from symbols where kind = 'method'
      union all select cast(x.o_orderkey + 1000000000 as bigint), o.file_path, o.id,
        case x.o_orderkey % 11 when 2 then 'nothing' when 3 then 'nothing' when 4 then case when x.o_custkey % 4 = 0 then 'A' || x.o_custkey else c.name end when 5 then 'order_' || (x.o_orderkey % 60) when 7 then 'get' when 8 then 'far' || (x.o_orderkey % 3) else 'm' || (x.o_custkey % 10) end,
        case x.o_orderkey % 11 when 0 then 'this.f' when 1 then lower(substring(n.name, 1, 1)) || substring(n.name, 2) when 2 then case when x.o_custkey % 4 = 0 then 'A' || x.o_custkey else c.name end when 3 then 'dn' when 6 then 'dn' when 7 then o.name when 10 then n.name end,
        o.start_line, x.o_orderkey % 11 in (4, 5)
      from orders x join symbols o on o.id = 'o' || x.o_orderkey join symbols c on c.id = 'c' || x.o_custkey join symbols n on n.id = c.parent_id
      union all select cast(start_line + 2000000000 as bigint), file_path, id, 't' || (start_line * 7 % 97), cast(null as VARCHAR), start_line, false from symbols where kind = 'type'""",
    "locals": "select scope_id, name from calls where name = 'shadow' and call_id % 16 = 7",
    # file_path, name, type_name, scope_id
    "bindings": """select distinct o.file_path, 'v' as name, n.name as type_name, cast(null as VARCHAR) as scope_id from symbols o join symbols n on n.id = 'n' || (o.start_line % 3) where o.kind = 'function'
      union all select o.file_path, 'f', n.name, o.id from symbols o join symbols n on n.id = 'n' || (o.start_line % 5) where o.kind = 'function' and o.start_line % 3 = 0""",
    # file_path, child, parent, type, line
    "heritage": "select c.file_path, c.name as child, case when c.start_line % 11 = 0 then 'Ghost' || (c.start_line % 5) else n.name end as parent, 'extends' as type, c.start_line as line from symbols c join symbols n on n.id = c.parent_id where c.kind = 'class'",
    # file_path, scope_id, type_name, line, kind
    "typed": "select distinct o.file_path, o.id as scope_id, p.p_name as type_name, o.start_line as line, case when o.start_line % 20 < 10 then 'type-annotation' else 'return-annotation' end as kind from lineitem l join symbols o on o.id = 'o' || l.l_orderkey join part p on p.p_partkey = l.l_partkey where l.l_linenumber = 1",
    "assigned": "select distinct file_path, 'w' || (start_line % 9) as name, 'v' as source from symbols where kind = 'function' and start_line % 3 = 0",
    "results": "select distinct file_path, case when start_line % 5 = 0 then 'v' else 'z' || (start_line % 9) end as name, 'make' || (start_line % 4) as callee from symbols where kind = 'function'",
    "returned": "select 'make' || (n_nationkey % 3) as callee, n_name as type_name from nation",
}


def _facts(spark, sf_dir) -> dict[str, DataFrame]:
    """The facts as frames; each may use those before it."""
    tables = adapter.spark_names(sf_dir)
    symbols = adapter.symbols(spark, sf_dir)
    ctes = {"symbols": adapter._fill(adapter.SYMBOLS, "string", tables)} | {t: f"select * from {tables[t]}" for t in ("orders", "nation", "lineitem", "part")} | {k: v.replace("VARCHAR", "string") for k, v in FACTS.items()}

    def frame(name: str) -> DataFrame:
        order, need = list(ctes), set()

        def add(n: str) -> None:
            if n not in need:
                need.add(n)
                for other in order:
                    if other != n and other in ctes[n].replace(",", " ").replace("(", " ").split():
                        add(other)

        add(name)
        return spark.sql("with " + ", ".join(f"{n} as ({ctes[n]})" for n in order if n in need) + f" select * from {name}")

    return {k: frame(k) for k in FACTS} | {"symbols": symbols}


LINK = ["from_id", "to_id", "confidence", "reason"]
CHAIN = {
    "names": "select distinct target || '#' || name as key, target as file, name from imports where kind = 'named'",
    "exports": "select file_path, name, id from code where exported",
    "followed": """select key, file, name, 0 as hop from names union all
      select key, coalesce((select min(source) from reexports r where r.file = f.file and r.name = f.name), (select min(source) from reexports r where r.file = f.file and r.name = '*')), name, hop + 1
      from followed f where hop < 6 and file is not null and not exists (select 1 from exports e where e.file_path = f.file and e.name = f.name)""",
    "chain": "select f.key, min(e.id) as target_id from followed f join exports e on e.file_path = f.file and e.name = f.name group by f.key",
}
IMPORTED = {
    **FACTS, **CHAIN,
    "mains": "select file_path, id from (select file_path, id, row_number() over (partition by file_path order by case kind when 'class' then 0 when 'function' then 1 else 2 end, start_line, id) as r from code where exported) x where r = 1",
    "import_links": """select file_path || '#module:_top:0' as from_id, coalesce(m.id, target || '#module:_top:0') as to_id, case when m.id is null then 0.6e0 else 0.85e0 end as confidence, case when m.id is null then 'import-default-module' else 'import-default' end as reason, 'imports' as type
        from (select * from imports where kind = 'default' and target is not null) i left join (select file_path as file, id from mains) m on m.file = i.target
      union all select file_path || '#module:_top:0', c.target_id, 0.95e0, 'import-named', 'imports' from imports i join chain c on c.key = i.target || '#' || i.name where i.kind = 'named'
      union all select i.file_path || '#module:_top:0', e.id, 0.65e0, 'import-wildcard', 'imports' from imports i join exports e on e.file_path = i.target where i.kind = 'wildcard'""",
}


def _imports(t: dict[str, DataFrame], kinds: str = "kind is not null") -> DataFrame:
    return resolve.import_links(t["imports"].filter(kinds), t["code"], t["reexports"])


@query("r01_r03_import_links", "select from_id, to_id, confidence, reason from import_links", IMPORTED)
def r01_r03_import_links(spark, sf_dir):
    return _imports(_facts(spark, sf_dir)).select(*LINK)


@query("r18_wildcard_expansion", "select from_id, to_id, confidence, reason from import_links where reason = 'import-wildcard'", IMPORTED)
def r18_wildcard_expansion(spark, sf_dir):
    return _imports(_facts(spark, sf_dir), "kind = 'wildcard'").select(*LINK)


@query("j10_import_bindings", "select file_path, coalesce(alias, name) as local_name, target, name as exported_name from imports where kind = 'named'", FACTS)
def j10_import_bindings(spark, sf_dir):
    return _facts(spark, sf_dir)["imports"].filter("kind = 'named'").select("file_path", F.coalesce("alias", "name").alias("local_name"), "target", F.col("name").alias("exported_name"))


@query("j12_reexport_chain", "select key, target_id from chain", IMPORTED)
def j12_reexport_chain(spark, sf_dir):
    t = _facts(spark, sf_dir)
    names = t["imports"].filter("kind = 'named'").select(F.concat_ws("#", "target", "name").alias("key"), F.col("target").alias("file"), "name").distinct()
    return resolve.follow_reexports(names, t["reexports"], t["code"].filter("exported"))


@query("t15_reexport_chain", f"select n_name as name, target_id from nation join chain on key = '{INDEX}#' || n_name", IMPORTED)
def t15_reexport_chain(spark, sf_dir):
    """What the index passes on: half of the nations by name, those of one file through a second hop, the rest not at all."""
    t = _facts(spark, sf_dir)
    names = adapter.table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), F.lit(INDEX).alias("file"), F.col("n_name").alias("name"))
    used = t["imports"].filter((F.col("target") == INDEX) & (F.col("kind") == "named")).select("name").distinct()
    return resolve.follow_reexports(names.join(used, "name", "left_semi"), t["reexports"], t["code"].filter("exported")).withColumnRenamed("key", "name")


@query("r04_unresolved", "select case when starts_with(name, '.') or starts_with(name, '/') then 'unresolved' else 'external' end as state, count(*) as n from imports where target is null group by 1", FACTS)
def r04_unresolved(spark, sf_dir):
    return _facts(spark, sf_dir)["imports"].filter("target is null").groupBy(resolve.state_of(F.col("name")).alias("state")).agg(F.count("*").alias("n"))


def _listed(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_GLOBAL = _listed(names.GLOBALS)
#: Every way to a symbol of every call, of which the first wins.
CALLED = {
    **IMPORTED,
    "boundnames": "select file_path, coalesce(alias, name) as local, max(row(line, target, case when alias <> name then name end, kind = 'default')) as b from imports where kind <> 'wildcard' and target is not null group by 1, 2",
    "bound": "select file_path, local, b[2] as target, b[3] as real, b[4] as main from boundnames",
    "faraway": "select distinct file_path, coalesce(alias, name) as name from imports where kind <> 'wildcard' and target is null",
    "asked": "select c.*, exists (select 1 from locals l where l.scope_id = c.scope_id and l.name = c.name) as held, exists (select 1 from faraway f where f.file_path = c.file_path and f.name = c.name) as far, o.parent_id as around, regexp_replace(c.file_path, '[^/]*$', '') as folder, regexp_replace(c.receiver, '^(this|self)[.]', '') as variable from calls c left join symbols o on o.id = c.scope_id",
    "targets": "select s.*, p.name as parent_name, count(*) over (partition by s.name) as n, regexp_replace(s.file_path, '[^/]*$', '') as folder from code s left join (select id, name from code where kind in ('class', 'interface', 'struct', 'trait')) p on p.id = s.parent_id",
    "reach": "select distinct file_path, target from imports where target is not null",
    "infile": "select file_path, name, arg_min(type_name, row(scope_id is not null, type_name)) as type_name from bindings group by 1, 2",
    "vartypes": """select a.call_id, coalesce((select min(type_name) from bindings b where b.file_path = a.file_path and b.name = a.variable and b.scope_id = a.scope_id), (select min(type_name) from bindings b where b.file_path = a.file_path and b.name = a.variable and b.scope_id = a.around), f.type_name) as type_name
      from asked a left join infile f on f.file_path = a.file_path and f.name = a.variable where a.receiver is not null""",
    "pairs": "select a.*, t.id, t.file_path as to_file, t.start_line, t.parent_id, t.parent_name, t.n, t.kind, t.folder as to_folder from asked a join targets t on t.name = a.name",
    "ways": f"""select call_id, 0 as tier, e.id, e.file_path as to_file, e.start_line from asked a join bound b on b.file_path = a.file_path and b.local = a.name join code e on e.file_path = b.target and e.name = b.real and e.exported where a.receiver is null
      union all select call_id, case when name in {_GLOBAL} or far then 1 else 2 end, id, to_file, start_line from pairs where n = 1 and not (receiver is not null and name in {_listed(names.METHODS)}) and not argument and not (receiver is null and held)
      union all select call_id, 3, id, to_file, start_line from pairs where receiver in ('this', 'self') and parent_id = around
      union all select call_id, 4, p.id, to_file, start_line from pairs p join bound b on b.file_path = p.file_path and b.local = p.receiver and b.main join (select file_path as file, id as main_id from mains) m on m.file = b.target where p.parent_id = m.main_id
      union all select p.call_id, 5, id, to_file, start_line from pairs p join vartypes v on v.call_id = p.call_id and v.type_name = p.parent_name where starts_with(p.receiver, 'this.') or starts_with(p.receiver, 'self.')
      union all select call_id, case when p.parent_name = p.receiver then 6 else 7 end, id, to_file, start_line from pairs p join bound b on b.file_path = p.file_path and b.local = p.receiver where p.to_file = b.target
      union all select p.call_id, 8, id, to_file, start_line from pairs p join vartypes v on v.call_id = p.call_id and v.type_name = p.parent_name
      union all select call_id, 9, id, to_file, start_line from pairs where parent_name = upper(receiver[1]) || receiver[2:]
      union all select call_id, 10, p.id, to_file, start_line from pairs p join (select file_path as file, name as here, min(id) as here_id from code where kind in ('class', 'struct', 'trait') group by 1, 2) h on h.file = p.file_path and h.here = p.receiver where p.parent_id = h.here_id
      union all select call_id, 11, id, to_file, start_line from pairs where receiver is null and to_file = file_path
      union all select call_id, 12, id, to_file, start_line from pairs p join bound b on b.file_path = p.file_path and b.local = p.name where receiver is null and to_file = b.target
      union all select call_id, 13, id, to_file, start_line from pairs p join reach r on r.file_path = p.file_path and r.target = p.to_file where receiver is null and not held
      union all select call_id, 14, id, to_file, start_line from pairs where receiver is null and not held and to_folder = folder
      union all select call_id, 15, m.main_id, '', 0 from asked a join bound b on b.file_path = a.file_path and b.local = a.receiver and b.main join (select file_path as file, id as main_id from mains) m on m.file = b.target where not argument
      union all select call_id, 16, t.id, t.file_path, t.start_line from asked a join bound b on b.file_path = a.file_path and b.local = a.receiver join targets t on t.file_path = b.target and t.name = b.real where not argument
      union all select call_id, 17, t.id, t.file_path, t.start_line from asked a left join bound b on b.file_path = a.file_path and b.local = a.receiver join targets t on t.name = a.receiver and t.file_path = coalesce(b.target, a.file_path) where not argument and a.receiver not in ('this', 'self')""",
    "call_links": """select c.scope_id as from_id, id as to_id, [0.95e0, 0e0, 0.9e0, 0.95e0, 0.9e0, 0.93e0, 0.92e0, 0.85e0, 0.93e0, 0.55e0, 0.9e0, 0.9e0, 0.95e0, 0.85e0, 0.6e0, 0.85e0, 0.85e0, 0.85e0][tier + 1] as confidence,
        case when tier = 0 then 'call-alias' when tier = 2 then 'call-unique' when tier <= 10 then 'call-receiver' when tier = 11 then 'call-samefile' when tier = 12 then 'call-imported' when tier <= 14 then 'call-proximity' when tier = 15 then 'receiver-ref-default' else 'receiver-ref' end as reason,
        case when tier >= 15 then 'references' else 'calls' end as type
      from (select *, row_number() over (partition by call_id order by tier, to_file, start_line, id) as r from ways) x join calls c using (call_id) where r = 1 and tier <> 1""",
}


CALL_FACTS = ("calls", "code", "imports", "locals", "bindings")


def _calls(t: dict[str, DataFrame]) -> DataFrame:
    """The adapter's facts are worked out once: a call meets the symbols in a dozen ways."""
    return resolve.call_links(*[cut(t[k]) for k in CALL_FACTS])


@query("r05_r12_tiers", "select reason, confidence, type, count(*) as n from call_links group by 1, 2, 3", CALLED)
def r05_r12_tiers(spark, sf_dir):
    """How many links each way of reaching a symbol gives."""
    return _calls(_facts(spark, sf_dir)).groupBy("reason", "confidence", "type").agg(F.count("*").alias("n"))


@query("r05_r12_call_links", "select from_id, to_id, confidence, reason from call_links", CALLED)
def r05_r12_call_links(spark, sf_dir):
    return _calls(_facts(spark, sf_dir)).select(*LINK)


@query("j09_name_index", "select name, count(*) as n, min(id) as first_id from code where kind in ('function', 'method', 'class') group by name", FACTS)
def j09_name_index(spark, sf_dir):
    return _facts(spark, sf_dir)["code"].filter("kind in ('function', 'method', 'class')").groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("j11_excluded_names", f"select call_id, name in {_GLOBAL} as builtin from calls c where name in {_GLOBAL} or exists (select 1 from locals l where l.scope_id = c.scope_id and l.name = c.name)", FACTS)
def j11_excluded_names(spark, sf_dir):
    t = _facts(spark, sf_dir)
    builtin = F.col("name").isin(*names.GLOBALS)
    shadowed = t["calls"].filter(~builtin).join(t["locals"].distinct(), ["scope_id", "name"], "left_semi")
    return t["calls"].filter(builtin).unionByName(shadowed).select("call_id", builtin.alias("builtin"))


@query("r13_type_links", "select scope_id as from_id, id as to_id, 0.7e0 as confidence, kind as reason from (select b.scope_id, b.kind, t.id, row_number() over (partition by b.scope_id, b.type_name, b.kind order by case when t.file_path = b.file_path then 0 else 1 end, t.id) as r from typed b join symbols t on t.name = b.type_name and t.kind in ('class', 'interface', 'type', 'enum', 'struct')) x where r = 1", FACTS)
def r13_type_links(spark, sf_dir):
    t = _facts(spark, sf_dir)
    return resolve.type_links(t["typed"], t["symbols"]).select(*LINK)


HERITAGE = """select c.id as from_id, coalesce(p.id, '#external:' || h.parent) as to_id, case when p.id is null then 0.7e0 else 0.95e0 end as confidence, case when p.id is null then 'heritage-external' else 'heritage' end as reason, 'extends' as type
  from heritage h join symbols c on c.kind = 'class' and c.file_path = h.file_path and c.name = h.child left join (select name, min(id) as id from symbols where kind in ('class', 'interface', 'struct', 'trait') group by name) p on p.name = h.parent"""


@query("r14_heritage_links", f"select from_id, to_id, confidence, reason from ({HERITAGE}) x", FACTS)
def r14_heritage_links(spark, sf_dir):
    t = _facts(spark, sf_dir)
    return resolve.heritage_links(t["heritage"], t["symbols"]).select(*LINK)


@query("r15_contains_links", "select parent_id as from_id, id as to_id, 1e0 as confidence, 'contains' as reason from symbols where parent_id is not null")
def r15_contains_links(spark, sf_dir):
    return resolve.contains_links(adapter.symbols(spark, sf_dir)).select(*LINK)


@query("r16_reexport_links", "select r.file || '#module:_top:0' as from_id, e.id as to_id, case when r.name = '*' then 0.6e0 else 0.85e0 end as confidence, case when r.name = '*' then 'reexport-wildcard' else 'reexport-named' end as reason from reexports r join exports e on e.file_path = r.source and (r.name = '*' or r.name = e.name)", IMPORTED)
def r16_reexport_links(spark, sf_dir):
    t = _facts(spark, sf_dir)
    return resolve.reexport_links(t["reexports"], t["code"]).select(*LINK)


@query(
    "r17_type_propagation",
    """select file_path, name, type_name from (select *, row_number() over (partition by file_path, name order by o, type_name) as r from (
      select file_path, name, type_name, 0 as o from bindings union all select a.file_path, a.name, b.type_name, 1 from assigned a join bindings b on b.file_path = a.file_path and b.name = a.source
      union all select r.file_path, r.name, m.type_name, 2 from results r join (select callee, min(type_name) as type_name from returned group by 1) m on m.callee = r.callee) x) y where r = 1""",
    FACTS,
)
def r17_type_propagation(spark, sf_dir):
    t = _facts(spark, sf_dir)
    return resolve.propagate_types(t["bindings"], t["assigned"], t["results"], t["returned"])


@query(
    "r19_resolved_graph",
    f"select from_id, to_id, type, max(confidence) as confidence, count(*) as n from (select from_id, to_id, type, confidence from import_links union all select from_id, to_id, type, confidence from call_links union all select from_id, to_id, type, confidence from ({HERITAGE}) h union all select parent_id, id, 'contains', 1e0 from symbols where parent_id is not null) x group by 1, 2, 3",
    CALLED,
)
def r19_resolved_graph(spark, sf_dir):
    t = _facts(spark, sf_dir)
    t |= {k: cut(t[k]) for k in CALL_FACTS}  # imports and code are those of both steps
    every = [_imports(t), resolve.call_links(*[t[k] for k in CALL_FACTS]), resolve.heritage_links(t["heritage"], t["symbols"]), resolve.contains_links(t["symbols"])]
    return resolve.dedupe(reduce(DataFrame.unionByName, every)).select("from_id", "to_id", "type", "confidence", "n")


@query("r20_builtin_names", f"select name, name in {_GLOBAL} as builtin, count(*) as n from calls group by name", FACTS)
def r20_builtin_names(spark, sf_dir):
    return _facts(spark, sf_dir)["calls"].groupBy("name").agg(F.count("*").alias("n")).select("name", F.col("name").isin(*names.GLOBALS).alias("builtin"), "n")


@query(
    "t14_method_orders",
    "select id as class, id || '>' || parent_id || coalesce('>' || p2, '') as \"order\" from (select s.id, s.parent_id, p.parent_id as p2 from symbols s join symbols p on p.id = s.parent_id) x union all select id, id from symbols where kind = 'module'",
)
def t14_method_orders(spark, sf_dir):
    edges = adapter.symbols(spark, sf_dir).filter("parent_id is not null").select(F.col("id").alias("class"), F.col("parent_id").alias("parent"), F.lit(0).alias("position"))
    return resolve.method_orders(edges)


#: A class for each customer with two mixed-in parents that share one: a diamond. Every fifth names them the other way round above, which has no C3 order.
DIAMOND = """select 'k' || c_custkey as class, 'a' || c_custkey as parent, 0 as position, c_custkey from customer union all select 'k' || c_custkey, 'b' || c_custkey, 1, c_custkey from customer
  union all select 'a' || c_custkey, 'r' || c_nationkey, 0, c_custkey from customer union all select 'b' || c_custkey, 'r' || c_nationkey, 0, c_custkey from customer
  union all select 'k' || c_custkey, 'r' || c_nationkey, case when c_custkey % 5 = 0 then -1 else 2 end, c_custkey from customer union all select 'x' || c_custkey, 'y' || c_custkey, 0, c_custkey from customer union all select 'y' || c_custkey, 'x' || c_custkey, 0, c_custkey from customer"""


@query(
    "t14_orders_by_rule",
    """select 'k' || c_custkey as class, case c_custkey % 4 when 3 then 'k' || c_custkey when 2 then case when c_custkey % 5 = 0 then 'k' || c_custkey || '>r' || c_nationkey || '>a' || c_custkey || '>b' || c_custkey else 'k' || c_custkey || '>a' || c_custkey || '>r' || c_nationkey || '>b' || c_custkey end
        when 1 then case when c_custkey % 5 <> 0 then 'k' || c_custkey || '>r' || c_nationkey || '>b' || c_custkey || '>a' || c_custkey end else case when c_custkey % 5 <> 0 then 'k' || c_custkey || '>a' || c_custkey || '>b' || c_custkey || '>r' || c_nationkey end end as "order" from customer
      union all select unnest(['x', 'y']) || c_custkey, null from customer""",
)
def t14_orders_by_rule(spark, sf_dir):
    c = adapter.table(spark, sf_dir, "customer")
    c.createOrReplaceTempView("tessera_customer")
    edges = spark.sql(DIAMOND.replace("from customer", "from tessera_customer"))
    rules = c.select(F.concat(F.lit("k"), "c_custkey").alias("class"), F.element_at(F.array(*map(F.lit, resolve.RULES)), (F.col("c_custkey") % 4 + 1).cast("int")).alias("rule"))
    orders = resolve.method_orders(edges, rules)
    return orders.filter(F.substring("class", 1, 1).isin("k", "x", "y"))
