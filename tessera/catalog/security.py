"""Security scans, dependency audits and routes."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tessera.catalog.registry import query
from tessera.functions.paths import glob_to_regex
from tessera.operators import security
from tessera.operators.textsearch import lines
from tessera.sources import adapter

LINES = "select path, cast(i as int) as line, parts[i] as body from (select 'src/d' || doc_id || '.ts' as path, string_split(text, chr(10)) as parts, unnest(generate_series(1, len(string_split(text, chr(10))))) as i from documents) x"


def applies(glob: str, path: str = "src/d1.ts") -> bool:
    return re.search(glob_to_regex(glob), path) is not None


def _hits(every: bool = False) -> str:
    """The rules that are about the files scanned, one select each. every: all rules, and each match of a line."""
    out = []
    for id_, category, severity, pattern, glob, without in security.RULES:
        if not every and (not applies(glob) or without and applies(without)):
            continue
        p = pattern.replace("'", "''")
        m = "found" if every else f"regexp_extract(body, '{p}')"
        shown = f"case when length({m}) <= 8 then '****' else left({m}, 2) || '****' || right({m}, 2) || ' [redacted]' end" if category == "secrets" else f"case when length({m}) > 100 then left({m}, 97) || '...' else {m} end"
        out.append(f"select '{id_}' as rule, '{category}' as category, '{severity}' as severity, path as file, line, {shown} as match from " + (f"(select path, line, unnest(regexp_extract_all(body, '{p}')) as found from lines) x" if every else f"lines where regexp_matches(body, '{p}')"))
    return "\nunion all ".join(out)


SCAN = {"lines": LINES, "hits": _hits(), "found": "select rule, category, severity, file, line, match from (select *, row_number() over (partition by category, file, line order by rule) as r from hits) x where r = 1"}


def _files(spark, sf_dir):
    return adapter.table(spark, sf_dir, "documents").select(F.concat(F.lit("src/d"), F.col("doc_id"), F.lit(".ts")).alias("path"), "text")


@query("v11_security_scan", "select * from found", SCAN)
@query("j15_rules_by_files", "select * from found", SCAN)
def v11_security_scan(spark, sf_dir):
    return security.scan(_files(spark, sf_dir))


@query("v12_scan_all_hits", _hits(True), {"lines": LINES.replace("from documents", "from documents where octet_length(encode(text)) <= 4096")})
def v12_scan_all_hits(spark, sf_dir):
    """Every match of every rule on a line, whatever the file's name, in files of at most 4 KB."""
    return security.scan(_files(spark, sf_dir), apart=False, every=True, globs=False, most_bytes=4096)


@query("o09_by_severity", "select * from found order by case severity when 'CRITICAL' then 4 when 'HIGH' then 3 when 'MEDIUM' then 2 else 1 end desc, file, line, rule limit 50", SCAN)
def o09_by_severity(spark, sf_dir):
    return security.by_severity(security.scan(_files(spark, sf_dir)))


@query("a14_finding_score", "select count(*) filter (severity = 'CRITICAL') as critical, count(*) filter (severity = 'HIGH') as high, count(*) filter (severity = 'MEDIUM') as medium, count(*) filter (severity = 'LOW') as low, cast(greatest(0, floor(100 - 5 * count(*) filter (severity = 'CRITICAL') - 2 * count(*) filter (severity = 'HIGH') - 0.5e0 * count(*) filter (severity = 'MEDIUM') + 0.5e0)) as bigint) as score from found", SCAN)
def a14_finding_score(spark, sf_dir):
    return security.score(security.scan(_files(spark, sf_dir)))


@query("v15_rules", " union all ".join(f"select '{r[0]}' as rule, '{r[1]}' as category, '{r[2]}' as severity, (select count(*) from hits where rule = '{r[0]}') as n" for r in security.RULES), SCAN)
def v15_rules(spark, sf_dir):
    """Every rule with how many lines of the documents it finds."""
    rules = spark.createDataFrame([r[:3] for r in security.RULES], "rule string, category string, severity string")
    n = security.scan(_files(spark, sf_dir), apart=False).groupBy("rule").agg(F.count("*").alias("n"))
    return rules.join(n, "rule", "left").fillna(0, ["n"])


@query(
    "v13_template_filter",
    "select 'c' || n_nationkey || '.' || ext as file, cast(line as int) as line from nation, (values ('vue', 1), ('vue', 5), ('ts', 1), ('ts', 2), ('ts', 3), ('ts', 4), ('ts', 5)) as v(ext, line)",
)
def v13_template_filter(spark, sf_dir):
    """A secret counts in any file; the name of an event or a bound attribute of a component does not."""
    body = "password = 'hunter22'\n<a @password=\"generate\">\n<b :password=\"secretive\">\n<c generate-password=\"word1\">\nconst x = { password: 'hunter22' }"
    n = adapter.table(spark, sf_dir, "nation")
    files = n.select(F.explode(F.array(*[F.format_string(f"c%d.{ext}", "n_nationkey") for ext in ("vue", "ts")])).alias("path"), F.lit(body).alias("text"))
    return security.scan(files, [r for r in security.RULES if r[0] == "SEC-001"]).select("file", "line")


#: Dependencies from parts and advisories from nations; each of an invented package has a range of one or two clauses.
DEPENDED = "select case when p_partkey % 3 = 0 then 'Pack' else 'pack' end || (p_partkey % 40) as name, case when p_partkey % 17 = 0 then '*' when p_partkey % 19 = 0 then '' when p_partkey % 23 = 0 then '1.2' else '^' || (p_size % 4) || '.' || (p_partkey % 6) || '.' || (p_size % 9) end as version from {part}"
ADVISED = """select 'ADV-' || n_nationkey as id, 'PACK' || n_nationkey as package, case n_nationkey % 4 when 0 then '< 2.' || (n_nationkey % 5) || '.0' when 1 then '>= 1.1.0 < 3.' || (n_nationkey % 5) || '.4' when 2 then '>= 1.0.0 < 1.2.0 || >= 2.0.0 <= 2.1.' || (n_nationkey % 9) else '= 3.0.' || (n_nationkey % 9) end as affected,
  case n_nationkey % 3 when 0 then 'HIGH' when 1 then 'LOW' else 'CRITICAL' end as severity from {nation}"""
AUDIT = {
    "deps": DEPENDED.format(part="part"),
    "numbered": "select lower(name) as package, version, case when version in ('*', '') then null else list_transform(string_split(ltrim(version, '^'), '.'), lambda x: cast(x as int)) end as v from deps",
    "clauses": "select 'ADV-' || k as id, 'pack' || k as package, case k % 3 when 0 then 'HIGH' when 1 then 'LOW' else 'CRITICAL' end as severity, low, high, closed from (select n_nationkey as k from nation) n, (values (0, 0), (1, 0), (2, 0), (2, 1), (3, 0)) as w(m, part), "
    "(select 1) x, lateral (select case when m = 0 then [0, 0, 0] when m = 1 then [1, 1, 0] when m = 2 and part = 0 then [1, 0, 0] when m = 2 then [2, 0, 0] else [3, 0, k % 9] end as low, case when m = 0 then [2, k % 5, 0] when m = 1 then [3, k % 5, 4] when m = 2 and part = 0 then [1, 2, 0] when m = 2 then [2, 1, k % 9] else [3, 0, k % 9] end as high, m = 3 or (m = 2 and part = 1) as closed) b where k % 4 = m",
}
HIT = "from numbered d join clauses a on a.package = d.package where d.v is null or (len(d.v) = 3 and d.v >= a.low and (d.v < a.high or (a.closed and d.v = a.high)))"


def _audited(spark, sf_dir):
    names = adapter.spark_names(sf_dir)
    return spark.sql(DEPENDED.format(**names)).withColumn("ecosystem", F.lit("npm")), spark.sql(ADVISED.format(**names))


@query("v16_dependency_audit", f"select a.id, a.severity, a.package, min(d.version) as version {HIT} group by 1, 2, 3", AUDIT)
def v16_dependency_audit(spark, sf_dir):
    return security.audit(*_audited(spark, sf_dir))


@query("j16_advisory_ranges", f"select severity, count(*) as n from (select distinct a.severity, a.id {HIT}) x group by severity", AUDIT)
def j16_advisory_ranges(spark, sf_dir):
    return security.audit(*_audited(spark, sf_dir)).groupBy("severity").agg(F.count_distinct("id").alias("n"))


@query("f21_semver", "select k, case k % 4 when 0 then v when 1 then v || '-a' when 2 then '^' || v else '1.2' end as version, k % 4 <> 3 as sound, k % 4 <> 3 and (t < [1, 2, 3] or (t = [1, 2, 3] and k % 4 = 1)) as below from (select p_partkey as k, (p_size % 3) || '.' || (p_size % 5) || '.' || (p_partkey % 7) as v, [p_size % 3, p_size % 5, p_partkey % 7] as t from part) x")
def f21_semver(spark, sf_dir):
    k, v = F.col("p_partkey"), F.format_string("%d.%d.%d", F.col("p_size") % 3, F.col("p_size") % 5, F.col("p_partkey") % 7)
    version = F.when(k % 4 == 0, v).when(k % 4 == 1, F.concat(v, F.lit("-a"))).when(k % 4 == 2, F.concat(F.lit("^"), v)).otherwise("1.2")
    rows = adapter.table(spark, sf_dir, "part").select(k.alias("k"), version.alias("version"))
    return rows.select("k", "version", security.semver(F.col("version")).isNotNull().alias("sound"), security.in_range(F.col("version"), F.lit("< 1.2.3")).alias("below"))


#: A source for each customer in a framework that its number tells: extension, text, and (framework, method, route, line) of what it declares.
SOURCES = [
    ("ts", "app.get('/users%d', h)\nconst x = 1\nrouter.post(\"/login\", h)", [("express", "GET", "'/users' || k", 1), ("express", "POST", "'/login'", 3)]),
    ("py", "\"\"\"\n@app.get('/doc')\n\"\"\"\n@app.get('/items%d')\ndef f(): pass\n@bp.route(\"/old\")", [("fastapi", "GET", "'/items' || k", 4), ("flask", "ROUTE", "'/old'", 6)]),
    ("go", 'mux.HandleFunc("/health%d", h)', [("go", "HANDLEFUNC", "'/health' || k", 1)]),
    ("rb", "resources 'posts%d'\nroot 'home#index'", [("rails", "RESOURCES", "'posts' || k", 1), ("rails", "ROOT", "'home#index'", 2)]),
    ("md", "app.get('/no%d', h)", []),
    ("php", "Route::get('/p%d', f);", [("php", "GET", "'/p' || k", 1)]),
    (
        "ts",
        "@Controller('cats%d')\nexport class Cats {\n  @Get()\n  all() { return 1 }\n  @Post('new')\n  make() {\n  }\n}\n@Get('free')\nfunction f() {}\n@Controller()\nclass Other {\n  @Get('/other')\n  g() {}\n}",
        [("nestjs", "GET", "'/cats' || k", 3), ("nestjs", "POST", "'/cats' || k || '/new'", 5), ("nestjs", "GET", "'free'", 9), ("nestjs", "GET", "'/other'", 13)],
    ),
    ("ts", "@SubscribeMessage('ping%d')\nhandle() {}", [("nestjs-gateway", "WS", "'ping' || k", 1)]),
]
FOUND = {
    "keyed": "select c_custkey as k from customer",
    "routed": " union all ".join(f"select '{f}' as framework, '{m}' as method, {r} as route, 'web/c' || k || '.{ext}' as path, {line} as line from keyed where k % {len(SOURCES)} = {i}" for i, (ext, _, found) in enumerate(SOURCES) for f, m, r, line in found),
}


def _routed(spark, sf_dir):
    key = F.col("c_custkey")
    each = F.array(*[F.struct(F.lit(ext).alias("ext"), F.format_string(text, key).alias("text")) for ext, text, _ in SOURCES])
    c = adapter.table(spark, sf_dir, "customer").withColumn("s", F.element_at(each, (key % len(SOURCES) + 1).cast("int")))
    return c.select(F.concat(F.lit("web/c"), key, F.lit("."), F.col("s.ext")).alias("path"), "s.text")


@query("v17_routes", "select * from routed", FOUND)
def v17_routes(spark, sf_dir):
    return security.routes(_routed(spark, sf_dir))


@query(
    "o10_routes_shown",
    "select framework, method, route, path, line, more from (select *, row_number() over (partition by framework order by path, line, route) as r, greatest(count(*) over (partition by framework) - 20, 0) as more from routed) x where r <= 20",
    FOUND,
)
def o10_routes_shown(spark, sf_dir):
    return security.routes_shown(security.routes(_routed(spark, sf_dir)))


@query("x21_docstring_filter", "select 'web/c' || k || '.py' as path, cast(line as int) as line from keyed, (values (1), (4), (5), (6)) as v(line) where k % 8 = 1", FOUND)
def x21_docstring_filter(spark, sf_dir):
    """The lines of the Python sources that no docstring spans."""
    return security.outside_docstrings(lines(_routed(spark, sf_dir).filter("path like '%.py'"))).select("path", "line")


ROUTED = r"(?i)(routes?|controllers?|handlers?|api)[/.]"


@query("v18_route_symbols", f"select id, k from (select id, case kind when 'method' then 'src/handlers' || substr(file_path, 4) when 'class' then 'src/api.ts' else file_path end as f, kind as k from symbols) x where regexp_matches(f, '{ROUTED}')")
def v18_route_symbols(spark, sf_dir):
    """The suppliers as handlers and the customers as an API."""
    f = F.when(F.col("kind") == "method", F.concat(F.lit("src/handlers"), F.substring("file_path", 4, 1000))).when(F.col("kind") == "class", "src/api.ts").otherwise(F.col("file_path"))
    return adapter.symbols(spark, sf_dir).filter(f.rlike(ROUTED)).select("id", F.col("kind").alias("k"))
