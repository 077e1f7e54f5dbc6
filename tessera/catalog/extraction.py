"""Facts from HTML pages, and from Markdown, source files and manifests that the tables write: what they hold is known row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.catalog.registry import query
from tessera.operators import extract
from tessera.sources import adapter

#: A guide for each nation, with sections of three levels, a fence, links and a name that comes twice.
GUIDES = """select 'docs/' || n_nationkey || '.md' as path, '# ' || n_name || '\n\nSee [setup](./setup' || n_regionkey || '.md#install) and [web](https://x.y).\n\n## Install ##\ntext\n```\n# not a heading\n[no](no.md)\n```\n### Deep ' || n_regionkey || '\n## Use\n[api](../api' || n_nationkey || '.md) [top](#guide) [img](a.png)\n# ' || n_name || '\nend\n' as text from {nation}"""


def _guides(spark, sf_dir):
    return spark.sql(GUIDES.format(**adapter.spark_names(sf_dir)))


@query(
    "x10_markdown_sections",
    """select p || '#section:' || n_name as id, p as path, n_name as name, 1 as level, 1 as start_line, 13 as end_line, null as parent_id from guided
      union all select p || '#section:Install', p, 'Install', 2, 5, 11, p || '#section:' || n_name from guided union all select p || '#section:Deep ' || n_regionkey, p, 'Deep ' || n_regionkey, 3, 11, 11, p || '#section:Install' from guided
      union all select p || '#section:Use', p, 'Use', 2, 12, 13, p || '#section:' || n_name from guided union all select p || '#section:' || n_name || ':2', p, n_name, 1, 14, 15, null from guided""",
    {"guided": "select *, 'docs/' || n_nationkey || '.md' as p from nation"},
)
def x10_markdown_sections(spark, sf_dir):
    return extract.markdown_sections(_guides(spark, sf_dir))


@query(
    "x10_markdown_links",
    "select p as path, 3 as line, './setup' || n_regionkey || '.md' as target from guided union all select p, 13, '../api' || n_nationkey || '.md' from guided union all select p, 13, 'a.png' from guided",
    {"guided": "select *, 'docs/' || n_nationkey || '.md' as p from nation"},
)
def x10_markdown_links(spark, sf_dir):
    return extract.markdown_links(_guides(spark, sf_dir))


@query("x11_inline_scripts", "select page_id, cast(i - 1 as int) as at, scripts[i] as script from (select page_id, scripts, unnest(generate_series(1, len(scripts))) as i from (select page_id, regexp_extract_all(html, '(?is)<script>(.*?)</script>', 1) as scripts from pages) x) y")
def x11_inline_scripts(spark, sf_dir):
    return extract.inline_scripts(adapter.table(spark, sf_dir, "pages"))


PAGE_LINES = "select page_id, cast(i as int) as line, parts[i] as body from (select page_id, string_split(html, chr(10)) as parts, unnest(generate_series(1, len(string_split(html, chr(10))))) as i from pages) x"


@query("x13_html_links", "select page_id, line, target from (select page_id, line, regexp_extract(body, '(?i)<a\\b[^>]*\\bhref\\s*=\\s*[\"'']([^\"'']+)[\"'']', 1) as target from lines) x where target <> '' and not starts_with(target, '#') and not starts_with(target, 'javascript:')", {"lines": PAGE_LINES})
def x13_html_links(spark, sf_dir):
    return extract.html_links(adapter.table(spark, sf_dir, "pages"))


@query(
    "x12_html_refs",
    "select page_id, 1 as line, 'script' as kind, '/s' || (page_id % 9) || '.js' as target from pages union all select page_id, 1, 'style', '/s' || (page_id % 7) || '.css' from pages union all select page_id, 2, 'script', 'b.js' from pages",
)
def x12_html_refs(spark, sf_dir):
    """The pages, after two lines of references that their numbers tell; what stands in the pages themselves has none."""
    head = F.format_string('<script src="/s%d.js"></script><link rel="stylesheet" href="/s%d.css">\n<script src="b.js"></script>\n', F.col("page_id") % 9, F.col("page_id") % 7)
    return extract.html_refs(adapter.table(spark, sf_dir, "pages").select("page_id", F.concat(head, F.coalesce("html", F.lit(""))).alias("html")))


@query(
    "x14_css_selectors",
    "select distinct path, name from (select 's/' || p_size || '.css' as path, unnest(['.p' || (p_partkey % 50), '.b' || (p_partkey % 50) || '-x', '#i' || p_size, '--v' || (p_partkey % 3)]) as name from part) x",
)
def x14_css_selectors(spark, sf_dir):
    rule = F.format_string(".p%d, .b%d-x:hover { color: var(--other); }\n#i%d { --v%d: red; }\n", F.col("p_partkey") % 50, F.col("p_partkey") % 50, F.col("p_size"), F.col("p_partkey") % 3)
    sheets = adapter.table(spark, sf_dir, "part").groupBy(F.format_string("s/%d.css", "p_size").alias("path")).agg(F.array_join(F.collect_list(rule), "").alias("text"))
    return extract.css_selectors(sheets)


@query("x17_exported_by_case", "select name, regexp_matches(name, '^[A-Z]') as exported from symbols")
def x17_exported_by_case(spark, sf_dir):
    return adapter.symbols(spark, sf_dir).select("name", extract.exported_by_case(F.col("name")).alias("exported"))


#: One file for each customer in a language that its number tells, with names that tell the number.
LANGUAGES = {
    "ts": ("export async function load%d() {}\nclass Box%d {}\n// function no\nconst x%d = 1;", ("load", "Box", "x")),
    "py": ("def f%d():\n  pass\nclass C%d:\n    def m%d(self): pass", ("f", "C", "m")),
    "go": ("func (s *S) Run%d() {}\ntype T%d struct {}\nvar x%d = 1", ("Run", "T")),
    "rs": ("pub fn go%d() {}\nstruct W%d;\n// fn no\nenum E%d {}", ("go", "W", "E")),
    "rb": ("module M%d\n  def hi%d; end\n  class K%d; end\nend", ("M", "hi", "K")),
    "java": ("public class J%d {\n  private static int n%d() {}\n  protected String s%d() {}\n}", ("J", "n", "s")),
    "php": ("<?php\nclass P%d {\n  public function q%d() {}\n  private static function r%d() {}\n}", ("P", "q", "r")),
    "txt": ("def no%d(): pass\nclass No%d\nfunc no%d() {}", ()),
}


def _sources(spark, sf_dir, less: str = "") -> DataFrame:
    """(path, text). less: SQL of customers whose file says fresh for its first name."""
    key = F.col("c_custkey")
    kinds = [F.struct(F.lit(ext).alias("ext"), F.format_string(text, key, key, key).alias("text")) for ext, (text, _) in LANGUAGES.items()]
    c = adapter.table(spark, sf_dir, "customer").withColumn("k", F.element_at(F.array(*kinds), (key % len(kinds) + 1).cast("int")))
    text = F.when(F.expr(less), F.regexp_replace("k.text", r"\b(load|f|Run|go|M|J|P)([0-9]+)", "fresh$2")).otherwise(F.col("k.text")) if less else F.col("k.text")
    return c.select(F.concat(F.lit("lib/c"), key, F.lit("."), F.col("k.ext")).alias("path"), text.alias("text"))


_NAMED = " union all ".join(f"select 'lib/c' || c_custkey || '.{ext}' as path, '{n}' || c_custkey as name, {i} as pos, c_custkey from customer where c_custkey % {len(LANGUAGES)} = {j}" for j, (ext, (_, names)) in enumerate(LANGUAGES.items()) for i, n in enumerate(names))


@query("x20_declared_names", "select path, name from named", {"named": _NAMED})
def x20_declared_names(spark, sf_dir):
    return extract.declared_names(_sources(spark, sf_dir))


@query("x18_language_patterns", "select regexp_extract(path, '[a-z]+$') as language, count(*) as n, count(distinct path) as files from named group by 1", {"named": _NAMED})
def x18_language_patterns(spark, sf_dir):
    found = extract.declared_names(_sources(spark, sf_dir))
    return found.groupBy(F.regexp_extract("path", "[a-z]+$", 0).alias("language")).agg(F.count("*").alias("n"), F.count_distinct("path").alias("files"))


@query("x20_name_changes", "select path, name, 'removed' as change from named where pos = 0 and c_custkey % 10 = 3 union all select path, 'fresh' || c_custkey, 'added' from named where pos = 0 and c_custkey % 10 = 3", {"named": _NAMED})
def x20_name_changes(spark, sf_dir):
    return extract.name_changes(_sources(spark, sf_dir), _sources(spark, sf_dir, "c_custkey % 10 = 3"))


#: Imports of the files of the graph: a neighbour, a file above by .js, an alias, a package, nothing, a folder's index.
IMPORTED = """select file_path, 'o' || (start_line % 29) || '.ts' as want, case kind when 'function' then './o' || (start_line % 29) when 'class' then '../orders/o' || (start_line % 29) || '.js' when 'method' then '@/geo/n' || (start_line % 7) when 'type' then 'react' else './none' end as module_path, start_line as line, kind from symbols"""


@query(
    "x19_import_paths",
    """select i.file_path, i.module_path, i.line, f.path as target from imported i left join (select distinct file_path as path from symbols) f
      on f.path = case i.kind when 'function' then regexp_replace(i.file_path, '[^/]*$', '') || i.want when 'class' then 'src/orders/' || i.want when 'method' then 'src/geo/n' || (i.line % 7) || '.ts' end""",
    {"imported": IMPORTED},
)
def x19_import_paths(spark, sf_dir):
    symbols = adapter.symbols(spark, sf_dir)
    symbols.createOrReplaceTempView("tessera_symbols")
    imports = spark.sql(IMPORTED.replace("from symbols", "from tessera_symbols")).drop("want", "kind")
    return extract.resolve_imports(imports, symbols.select(F.col("file_path").alias("path")), {"@/": "src/"}).select("file_path", "module_path", "line", "target")


#: A Python module for each customer: an import of each kind, a class with a base and a method, a function with assignments.
MODULE = "import os%d\nfrom .models import User%d as U, Base\n\nclass Admin%d(Base):\n    def save(self, u: U) -> bool:\n        self.log(u)\n        return store%d(u)\n\ndef make%d():\n    a = Admin%d()\n    b = a\n    x: int = 1\n    return b\n"
MODULES = {"modules": "select 'm' || c_custkey || '.py' as path, c_custkey as k from customer where c_custkey % 9 <> 4"}


def _facts(spark, sf_dir):
    """Every ninth file does not parse."""
    key = F.col("c_custkey")
    text = F.when(key % 9 == 4, F.lit("def (:\n")).otherwise(F.format_string(MODULE, *[key] * 6))
    return extract.python_facts(adapter.table(spark, sf_dir, "customer").select(F.concat(F.lit("m"), key, F.lit(".py")).alias("path"), text.alias("text")))


@query("x01_python_symbols", "select path, 'Admin' || k as name, 'class' as kind, '' as parent, 4 as line, 7 as end_line from modules union all select path, 'save', 'method', 'Admin' || k, 5, 7 from modules union all select path, 'make' || k, 'function', '', 9, 13 from modules", MODULES)
def x01_python_symbols(spark, sf_dir):
    return _facts(spark, sf_dir).filter("fact = 'symbol'").select("path", "name", "kind", "parent", "line", "end_line")


@query("x02_python_exports", "select path, 'Admin' || k as name from modules union all select path, 'make' || k from modules", MODULES)
def x02_python_exports(spark, sf_dir):
    return _facts(spark, sf_dir).filter("fact = 'symbol' and exported").select("path", "name")


@query("x03_python_imports", "select path, 'os' || k as name, 'module' as kind, 'os' || k as module, '' as real from modules union all select path, 'U', 'named', '.models', 'User' || k from modules union all select path, 'Base', 'named', '.models', 'Base' from modules", MODULES)
def x03_python_imports(spark, sf_dir):
    return _facts(spark, sf_dir).filter("fact = 'import'").select("path", "name", "kind", F.col("parent").alias("module"), F.col("receiver").alias("real"))


@query("x04_python_calls", "select path, 'log' as name, 'self' as receiver, 'Admin' || k || '.save' as scope, 6 as line from modules union all select path, 'store' || k, '', 'Admin' || k || '.save', 7 from modules union all select path, 'Admin' || k, '', 'make' || k, 10 from modules", MODULES)
def x04_python_calls(spark, sf_dir):
    return _facts(spark, sf_dir).filter("fact = 'call'").select("path", "name", "receiver", "scope", "line")


@query("x05_python_heritage", "select path, 'Admin' || k as name, 'Base' as parent from modules", MODULES)
def x05_python_heritage(spark, sf_dir):
    return _facts(spark, sf_dir).filter("fact = 'heritage'").select("path", "name", "parent")


@query("x07_python_bindings", "select path, 'u' as name, 'U' as type_name from modules union all select path, 'x', 'int' from modules", MODULES)
def x07_python_bindings(spark, sf_dir):
    return _facts(spark, sf_dir).filter("fact = 'type_binding'").select("path", "name", F.col("kind").alias("type_name"))


@query("x08_python_flows", "select path, 'return_type' as fact, 'save' as name, 'bool' as value from modules union all select path, 'assignment', 'b', 'a' from modules union all select path, 'call_result', 'a', 'Admin' || k from modules", MODULES)
def x08_python_flows(spark, sf_dir):
    return _facts(spark, sf_dir).filter("fact in ('return_type', 'assignment', 'call_result')").select("path", "fact", "name", F.when(F.col("kind") != "", F.col("kind")).otherwise(F.col("parent")).alias("value"))


@query("x09_parse_errors", "select 'm' || c_custkey || '.py' as path from customer where c_custkey % 9 = 4")
def x09_parse_errors(spark, sf_dir):
    return _facts(spark, sf_dir).filter("fact = 'parse_error'").select("path")


@query(
    "x06_reexports",
    "select 'i' || n_nationkey || '.ts' as path, unnest(['*', 'a' || n_regionkey, 'c', 'ns', 'default']) as name, unnest(['*', 'a' || n_regionkey, 'b', '*', 'default']) as real, unnest(['./x' || n_nationkey, './y', './y', './z', './w']) as module_path, unnest([1, 2, 2, 5, 6]) as line from nation",
)
def x06_reexports(spark, sf_dir):
    text = F.format_string("export * from './x%d';\nexport { a%d, type b as c } from \"./y\";\nexport { own };\n// export * from './no'\nexport * as ns from './z'\nexport { default } from './w'\n", "n_nationkey", "n_regionkey")
    return extract.reexports(adapter.table(spark, sf_dir, "nation").select(F.concat(F.lit("i"), "n_nationkey", F.lit(".ts")).alias("path"), text.alias("text")))


#: Manifests of six kinds for each part, by its number.
MANIFESTS = [
    ("package.json", '{"dependencies": {"lib%d": "^4.17.%d"}, "devDependencies": {"jest": "~29.0.0"}}', "npm", [("'lib' || k", "'4.17.' || s"), ("'jest'", "'29.0.0'")]),
    ("requirements.txt", "django%d==4.%d\n# no\nrequests>=2\n", "python", [("'django' || k", "'4.' || s"), ("'requests'", "'0.0.0'")]),
    ("Cargo.toml", '[package]\nname = "x"\n[dependencies]\nserde%d = "1.0.%d"\ntokio = { version = "1.2" }\n[dev]\n', "rust", [("'serde' || k", "'1.0.' || s"), ("'tokio'", "'1.2'")]),
    ("go.mod", "module m\nrequire (\n\tgithub.com/a/b%d v1.2.%d\n)\n", "go", [("'github.com/a/b' || k", "'1.2.' || s")]),
    ("pom.xml", "<dependency><groupId>g%d</groupId><artifactId>a</artifactId><version>1.%d</version></dependency>", "java", [("'g' || k || ':a'", "'1.' || s")]),
    ("build.gradle", "implementation 'x%d:y:2.%d'", "java", [("'x' || k || ':y'", "'2.' || s")]),
    ("notes.json", "not json %d %d", "", []),
]


@query(
    "s17_manifests",
    " union all ".join(f"select {n} as name, {v} as version, '{eco}' as ecosystem, 'p' || k || '/{file}' as path from parts where k % {len(MANIFESTS)} = {i}" for i, (file, _, eco, pairs) in enumerate(MANIFESTS) for n, v in pairs),
    {"parts": "select p_partkey as k, p_size as s from part"},
)
def s17_manifests(spark, sf_dir):
    key = F.col("p_partkey")
    each = F.array(*[F.struct(F.lit(file).alias("file"), F.format_string(text, key, F.col("p_size")).alias("text")) for file, text, _, _ in MANIFESTS])
    files = adapter.table(spark, sf_dir, "part").withColumn("m", F.element_at(each, (key % len(MANIFESTS) + 1).cast("int"))).select(F.concat(F.lit("p"), key, F.lit("/"), F.col("m.file")).alias("path"), "m.text")
    return extract.dependencies(files)
