"""Facts from source texts: sections and links of Markdown, scripts and references of HTML, selectors, declarations, imports, manifests."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.textsearch import lines
from tessera.plans.cut import cut, small, spread

# Patterns of headings, links, scripts and references.
HEADING = r"^(#{1,6})\s+(.+?)(?:\s*#+\s*)?$"
LINK = r"\[[^\]]*\]\(([^)]+)\)"
SCRIPT = r"(?is)<script(?![^>]*\bsrc\s*=)[^>]*>(.*?)</script>"
HTML_LINKS = [
    r"(?i)<a\b[^>]*\bhref\s*=\s*[\"']([^\"']+)[\"']",
    r"(?i)<form\b[^>]*\baction\s*=\s*[\"']([^\"']+)[\"']",
    r"(?i)<img\b[^>]*\bsrc\s*=\s*[\"']([^\"']+)[\"']",
    r"(?i)<source\b[^>]*\bsrc\s*=\s*[\"']([^\"']+)[\"']",
    r"(?i)<link\b[^>]*\brel\s*=\s*[\"'](?:icon|shortcut icon|apple-touch-icon)[\"'][^>]*\bhref\s*=\s*[\"']([^\"']+)[\"']",
    r"(?i)<link\b[^>]*\bhref\s*=\s*[\"']([^\"']+)[\"'][^>]*\brel\s*=\s*[\"'](?:icon|shortcut icon|apple-touch-icon)[\"']",
]
SCRIPT_SRC, STYLESHEET = r"(?i)<script\b[^>]*\bsrc\s*=\s*[\"']([^\"']+)[\"']", r"(?i)<link\b[^>]*\bhref\s*=\s*[\"']([^\"']+\.css[^\"']*)[\"']"


def outside_fences(files: DataFrame) -> DataFrame:
    """(path, line, body) of Markdown files (path, text) outside fenced code; the fences themselves are left out."""
    rows = lines(files.select("path", F.regexp_replace("text", "\r\n", "\n").alias("text")))
    fence = F.ltrim("body").startswith("```")
    count = F.sum(F.when(fence, 1).otherwise(0)).over(Window.partitionBy("path").orderBy("line"))
    return rows.withColumn("fences", count).filter(~fence & (F.col("fences") % 2 == 0)).drop("fences")


def markdown_sections(files: DataFrame) -> DataFrame:
    """(id, path, name, level, start_line, end_line, parent_id): headings outside fences.

    A section ends before the next heading of its level or a higher one; its parent is the nearest heading of a higher level
    before it. The n-th section of a name in a file has :n at the end of its id.
    """
    heads = outside_fences(files).filter(F.col("body").rlike(HEADING))
    heads = heads.select("path", F.col("line").alias("start_line"), F.length(F.regexp_extract("body", HEADING, 1)).alias("level"), F.trim(F.regexp_extract("body", HEADING, 2)).alias("name"))
    same = F.row_number().over(Window.partitionBy("path", "name").orderBy("start_line"))
    base = F.concat(F.col("path"), F.lit("#section:"), F.col("name"))
    heads = heads.withColumn("n", same).withColumn("id", F.when(F.col("n") == 1, base).otherwise(F.concat(base, F.lit(":"), F.col("n")))).drop("n")
    total = files.select("path", (F.size(F.split("text", "\r?\n")) - F.when(F.col("text").endswith("\n"), 1).otherwise(0)).alias("total"))
    before = Window.partitionBy("path").orderBy("start_line").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("path").orderBy(F.desc("start_line")).rowsBetween(Window.unboundedPreceding, -1)
    level = F.col("level")
    # one running aggregate for each of the six levels, so that no heading looks at all the others
    stops = F.array(*[F.min(F.when(level <= k, F.col("start_line"))).over(after) for k in range(1, 7)])
    parents = F.array(*[F.max(F.when(level < k, F.struct("start_line", "id"))).over(before) for k in range(1, 7)])
    heads = heads.withColumn("stops", stops).withColumn("parents", parents).join(total, "path")
    return heads.select("id", "path", "name", "level", "start_line", F.coalesce(F.element_at("stops", level) - 1, "total").alias("end_line"), F.element_at("parents", level)["id"].alias("parent_id"))


def markdown_links(files: DataFrame) -> DataFrame:
    """(path, line, target): local links outside fences, without their fragment."""
    found = outside_fences(files).select("path", "line", F.explode(F.regexp_extract_all("body", F.lit(LINK), 1)).alias("url"))
    local = ~F.col("url").rlike("^(https?://|mailto:|#)")
    return found.filter(local).select("path", "line", F.substring_index("url", "#", 1).alias("target")).filter("target <> ''")


def inline_scripts(pages: DataFrame) -> DataFrame:
    """(page_id, at, script): scripts without a source, in order."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(SCRIPT), 1)).alias("at", "script"))


def html_links(pages: DataFrame) -> DataFrame:
    """(page_id, line, target): the first kind of link on each line; anchors and javascript addresses do not count."""
    def first(pattern: str) -> Column:
        target = F.regexp_extract("body", pattern, 1)
        return F.when((target != "") & ~target.startswith("#") & ~target.startswith("javascript:"), target)

    return lines(pages.select("page_id", "html"), "html").select("page_id", "line", F.coalesce(*[first(p) for p in HTML_LINKS]).alias("target")).filter("target is not null")


def html_refs(pages: DataFrame) -> DataFrame:
    """(page_id, line, kind, target): script sources and style sheets, the first of each kind on a line."""
    rows = lines(pages.select("page_id", "html"), "html")
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract("body", p, 1).alias("target")) for k, p in (("script", SCRIPT_SRC), ("style", STYLESHEET))])
    return rows.select("page_id", "line", F.explode(each).alias("r")).select("page_id", "line", "r.kind", "r.target").filter("target <> ''")


def css_selectors(files: DataFrame) -> DataFrame:
    """(path, name): distinct classes (.x), ids (#x) and custom properties (--x) that a style sheet declares."""
    names = [F.regexp_extract_all("text", F.lit(p), 1) for p in (r"(\.[A-Za-z_][\w-]*)(?=[^{}]*\{)", r"(#[A-Za-z_][\w-]*)(?=[^{}]*\{)", r"(--[\w-]+)\s*:")]
    return files.select("path", F.explode(F.array_distinct(F.flatten(F.array(*names)))).alias("name"))


#: Declarations by language, for texts that cannot be parsed here: the name is the first group.
DECLARATIONS = {
    "ts": r"(?m)^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:async\s+)?(?:function\*?|class|interface|type|enum|const|let|var)\s+([A-Za-z_$][\w$]*)",
    "py": r"(?m)^\s*(?:async\s+)?(?:def|class)\s+([A-Za-z_]\w*)",
    "go": r"(?m)^(?:func\s+(?:\([^)]*\)\s*)?|type\s+)([A-Za-z_]\w*)",
    "rs": r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?(?:fn|struct|enum|trait)\s+([A-Za-z_]\w*)",
    "rb": r"(?m)^\s*(?:def|class|module)\s+([A-Za-z_]\w*)",
    "java": r"(?m)^\s*(?:public|protected|private)\s+(?:static\s+|final\s+|abstract\s+)*(?:class|interface|enum|[\w<>\[\]]+)\s+([A-Za-z_]\w*)",
    "php": r"(?m)^\s*(?:public\s+|private\s+|protected\s+|static\s+)*(?:function|class|interface|trait)\s+([A-Za-z_]\w*)",
}


def declared_names(files: DataFrame) -> DataFrame:
    """(path, name): distinct names that files (path, text) declare, by the pattern of their extension."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    ext = F.when(ext.isin("tsx", "js", "jsx", "mjs", "cjs", "vue"), "ts").otherwise(ext)
    names = F.coalesce(*[F.when(ext == k, F.regexp_extract_all("text", F.lit(p), 1)) for k, p in DECLARATIONS.items()])
    return files.select("path", F.explode(F.array_distinct(names)).alias("name"))


def exported_by_case(name: Column) -> Column:
    return name.rlike("^[A-Z]")


def name_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, name, change): names that one version alone declares."""
    old, new = declared_names(before), declared_names(after)
    return new.join(old, ["path", "name"], "left_anti").withColumn("change", F.lit("added")).unionByName(old.join(new, ["path", "name"], "left_anti").withColumn("change", F.lit("removed")))


#: Endings that a module path may lack, in the order in which they are tried.
ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".vue", ".py", "/index.ts", "/index.tsx", "/index.js", "/__init__.py")


def resolve_imports(imports: DataFrame, files: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """imports (file_path, module_path, ...) with target: the first existing file among the endings of the module path, else null.

    A path with an alias (prefix to folder) or a leading dot is resolved; others are tried as they are. A .js path that leads
    nowhere is tried as .ts and .tsx.
    """
    m = F.col("module_path")
    folder = F.regexp_replace("file_path", "[^/]*$", "")
    full = F.when(m.startswith("."), F.concat(folder, m)).otherwise(m)
    for prefix, to in sorted((aliases or {}).items(), key=lambda x: -len(x[0])):
        full = F.when(m.startswith(prefix), F.concat(F.lit(to), F.substring(m, len(prefix) + 1, 1 << 20))).otherwise(full)

    def step(done: Column, part: Column) -> Column:
        return F.when(part.isin("", "."), done).when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, part))

    plain = F.array_join(F.aggregate(F.split("tessera_full", "/"), F.array().cast("array<string>"), step), "/")
    # imports of one path from one folder are one question
    tried = [F.concat(plain, F.lit(e)) for e in ENDINGS] + [F.when(plain.rlike(r"\.jsx?$"), F.regexp_replace(plain, r"\.jsx?$", e)) for e in (".ts", ".tsx")]
    asked = imports.withColumn("tessera_full", full)
    tries = asked.select("tessera_full").distinct().select("tessera_full", F.posexplode(F.array(*tried)).alias("tessera_at", "path"))
    hit = tries.join(files.select("path").distinct(), "path", "left_semi").groupBy("tessera_full").agg(F.min_by("path", "tessera_at").alias("target"))
    return asked.join(small(cut(hit)), "tessera_full", "left").drop("tessera_full")


#: A name that a re-export list gives on, with its name outside.
EXPORTED_AS = r"^\s*(?:type\s+)?([\w$]+)(?:\s+as\s+([\w$]+))?\s*$"


def reexports(files: DataFrame) -> DataFrame:
    """(path, name, real, module_path, line): what files (path, text) of the JavaScript family pass on; name is the one outside, * stands for all, line for where the statement begins.

    Statements begin a line; lists may go on over several lines.
    """
    joined = F.regexp_replace("text", r"(?m)^[ \t]*//.*$", "")
    star = r"^\s*export\s*\*\s*(?:as\s+([\w$]+)\s+)?from\s*['\"]([^'\"]+)['\"]"
    several = r"^\s*export\s*(?:type\s*)?\{([^}]*)\}\s*from\s*['\"]([^'\"]+)['\"]"
    # the text is cut before each statement, so that lines can be counted
    parts = files.select("path", F.posexplode(F.split(joined, r"(?=(?<=^|\n)[ \t]*export\b)")).alias("at", "body"))
    breaks = F.size(F.split("body", "\n")) - 1
    before = F.coalesce(F.sum(breaks).over(Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("line", (before + 1).cast("int"))
    outer = F.regexp_extract("body", star, 1)
    stars = parts.filter(F.col("body").rlike(star)).select("path", F.when(outer == "", "*").otherwise(outer).alias("name"), F.lit("*").alias("real"), F.regexp_extract("body", star, 2).alias("module_path"), "line")
    each = parts.filter(F.col("body").rlike(several)).select("path", F.explode(F.split(F.regexp_extract("body", several, 1), ",")).alias("n"), F.regexp_extract("body", several, 2).alias("module_path"), "line").filter(F.col("n").rlike(EXPORTED_AS))
    inner, named = F.regexp_extract("n", EXPORTED_AS, 1), F.regexp_extract("n", EXPORTED_AS, 2)
    return stars.unionByName(each.select("path", F.when(named == "", inner).otherwise(named).alias("name"), inner.alias("real"), "module_path", "line"))


MANIFEST_NPM = "dependencies map<string,string>, devDependencies map<string,string>, peerDependencies map<string,string>, optionalDependencies map<string,string>"


def dependencies(files: DataFrame) -> DataFrame:
    """(name, version, ecosystem, path) that manifests (path, text) declare: package.json, requirements.txt, Cargo.toml, go.mod, pom.xml, build.gradle."""
    name = F.substring_index("path", "/", -1)

    def rows(file: str, ecosystem: str, pairs: Column) -> DataFrame:
        return files.filter(name == file).select(F.explode(pairs).alias("d"), F.lit(ecosystem).alias("ecosystem"), "path").select("d.name", "d.version", "ecosystem", "path")

    pair = lambda n, v: F.struct(n.alias("name"), v.alias("version"))
    spec = F.from_json("text", MANIFEST_NPM)
    npm = F.flatten(F.transform(F.array(*[F.coalesce(F.map_entries(spec[k]), F.array().cast("array<struct<key:string,value:string>>")) for k in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")]), lambda es: F.transform(es, lambda e: pair(e["key"], F.regexp_replace(e["value"], "^[~^]", "")))))
    text_lines = F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    req = F.transform(F.filter(text_lines, lambda x: x.rlike(r"^[A-Za-z0-9]") & ~x.startswith("#")), lambda x: pair(F.regexp_extract(x, r"^([A-Za-z0-9_.\-]+)", 1), F.when(x.rlike("=="), F.regexp_extract(x, r"==\s*([^\s;,]+)", 1)).otherwise("0.0.0")))
    section = F.regexp_extract("text", r"(?s)\[dependencies\]\s*\n(.*?)(?:\n\[|$)", 1)
    cargo = F.transform(F.filter(F.split(section, "\n"), lambda x: x.rlike(r"^\s*[\w-]+\s*=")), lambda x: pair(F.regexp_extract(x, r"^\s*([\w-]+)", 1), F.regexp_extract(x, r"\"[~^=]*([0-9][^\"]*)\"", 1)))
    go = F.transform(F.filter(text_lines, lambda x: x.rlike(r"^(require\s+)?\S+\s+v[0-9]")), lambda x: pair(F.regexp_extract(x, r"^(?:require\s+)?(\S+)\s+v", 1), F.regexp_extract(x, r"\sv([0-9][^\s]*)", 1)))
    both = lambda p: F.transform(F.regexp_extract_all("text", F.lit(p), 0), lambda x: pair(F.concat_ws(":", F.regexp_extract(x, p, 1), F.regexp_extract(x, p, 2)), F.regexp_extract(x, p, 3)))
    pom = both(r"(?s)<groupId>([^<]+)</groupId>\s*<artifactId>([^<]+)</artifactId>\s*<version>([^<]+)</version>")
    gradle = both(r"(?:implementation|api|compile|testImplementation)\s*\(?\s*['\"]([^:'\"]+):([^:'\"]+):([^'\"]+)['\"]")
    out = rows("package.json", "npm", npm)
    for file, ecosystem, pairs in (("requirements.txt", "python", req), ("Cargo.toml", "rust", cargo), ("go.mod", "go", go), ("pom.xml", "java", pom), ("build.gradle", "java", gradle)):
        out = out.unionByName(rows(file, ecosystem, pairs))
    return out


FACTS = "path string, fact string, name string, kind string, parent string, receiver string, scope string, line int, end_line int, exported boolean"


class _Facts(ast.NodeVisitor):
    """Facts of one Python module: symbols, imports, calls, heritage, types of variables, assignments, returns."""

    def __init__(self, path: str):
        self.path, self.rows, self.scope = path, [], []

    def put(self, fact: str, name: str, node: ast.AST | None, kind: str = "", parent: str = "", receiver: str = "", exported: bool = False) -> None:
        self.rows.append((self.path, fact, name, kind, parent, receiver, ".".join(self.scope), getattr(node, "lineno", 0), getattr(node, "end_lineno", 0), exported))

    def inside(self, node: ast.AST, name: str) -> None:
        self.scope.append(name)
        self.generic_visit(node)
        self.scope.pop()

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self.put("symbol", node.name, node, "class", ".".join(self.scope), exported=not self.scope)
        for base in node.bases:
            self.put("heritage", node.name, node, "extends", ast.unparse(base))
        self.inside(node, node.name)

    def visit_FunctionDef(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        self.put("symbol", node.name, node, "method" if self.scope and self.scope[-1][:1].isupper() else "function", ".".join(self.scope), exported=not self.scope)
        if node.returns:
            self.put("return_type", node.name, node, ast.unparse(node.returns))
        for a in node.args.args:
            self.put("local", a.arg, node)
            if a.annotation:
                self.put("type_binding", a.arg, node, ast.unparse(a.annotation))
        self.inside(node, node.name)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.put("import", a.asname or a.name, node, "module", a.name)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        for a in node.names:
            self.put("import", a.asname or a.name, node, "wildcard" if a.name == "*" else "named", "." * node.level + (node.module or ""), a.name)

    def visit_Call(self, node: ast.Call) -> None:
        if isinstance(node.func, ast.Name):
            self.put("call", node.func.id, node)
        elif isinstance(node.func, ast.Attribute):
            self.put("call", node.func.attr, node, receiver=ast.unparse(node.func.value)[:200])
        self.generic_visit(node)

    def visit_Assign(self, node: ast.Assign) -> None:
        for t in node.targets:
            if isinstance(t, ast.Name):
                if isinstance(node.value, ast.Name):
                    self.put("assignment", t.id, node, parent=node.value.id)
                elif isinstance(node.value, ast.Call):
                    self.put("call_result", t.id, node, parent=ast.unparse(node.value.func)[:200])
                self.put("local", t.id, node)
        self.generic_visit(node)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        if isinstance(node.target, ast.Name):
            self.put("type_binding", node.target.id, node, ast.unparse(node.annotation))
        self.generic_visit(node)


def python_facts(files: DataFrame) -> DataFrame:
    """Facts of Python files (path, text); a file that does not parse gives one row with the fact parse_error. Null texts give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = _Facts(path)
                try:
                    found.visit(ast.parse(text or ""))
                except (SyntaxError, ValueError, RecursionError):
                    found.rows = []
                    found.put("parse_error", "", None)
                rows += found.rows
            names = [c.split()[0] for c in FACTS.split(", ")]
            types = [pa.string()] * 7 + [pa.int32()] * 2 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    return spread(files.select("path", "text")).mapInArrow(run, FACTS)


# Calls in class bodies of Ruby that declare something, by kind.
RUBY_DSL = {
    "attribute": "attr_accessor attr_reader attr_writer".split(),
    "association": "has_many has_one belongs_to has_and_belongs_to_many".split(),
    "scope": ["scope"],
    "callback": "before_save after_save before_create after_create before_update after_update before_destroy after_destroy before_validation after_validation after_commit before_action after_action around_action".split(),
}


def ruby_declarations(files: DataFrame) -> DataFrame:
    """(path, line, kind, name, visible): what Ruby classes declare by calls, one row for each symbol, and methods; what follows a private or protected line of a class is not visible."""
    kinds = F.create_map(*[F.lit(x) for kind, words in RUBY_DSL.items() for w in words for x in (w, kind)])
    call = r"^\s*([a-z_]+)[\s(]+(:[A-Za-z_]\w*[?!]?.*)"
    method = r"^\s*def\s+(?:self\.)?([A-Za-z_]\w*[?!=]?)"
    rows = lines(files.select("path", "text"))
    section = F.when(F.col("body").rlike(r"^\s*(?:class|module)\s"), True).when(F.col("body").rlike(r"^\s*(private|protected)\s*$"), False).when(F.col("body").rlike(r"^\s*public\s*$"), True)
    at = F.max(F.when(section.isNotNull(), F.struct("line", section.alias("open")))).over(Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("visible", F.coalesce(at["open"], F.lit(True)))
    kind = kinds[F.regexp_extract("body", call, 1)]
    # an association or scope names one thing, an attribute or callback as many as there are symbols before any option
    listed = F.regexp_extract_all(F.regexp_replace(F.regexp_extract("body", call, 2), r",\s*\w+:.*$|,\s*:\w+\s*=>.*$|,?\s*(->|lambda|proc).*$", ""), F.lit(r":([A-Za-z_]\w*[?!]?)"), 1)
    names = F.when(kind.isin("association", "scope"), F.slice(listed, 1, 1)).otherwise(listed)
    declared = rows.withColumn("kind", kind).filter("kind is not null").select("path", "line", "kind", F.explode(names).alias("name"), "visible")
    name = F.regexp_extract("body", method, 1)
    return declared.unionByName(rows.filter(name != "").select("path", "line", F.lit("method").alias("kind"), name.alias("name"), "visible"))


def component_facts(files: DataFrame) -> DataFrame:
    """(path, fact, name) of single-file components: the component itself by its file's name, the script's language, components that the template uses (kebab names as Pascal ones), reactive state, computed values, props, emits, lifecycle hooks, and selectors of the style."""
    def block(tag: str) -> Column:
        return F.regexp_extract(F.coalesce("text", F.lit("")), rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)

    pascal = lambda x: F.array_join(F.transform(F.split(x, "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000))), "")
    text, script = F.coalesce("text", F.lit("")), block("script")
    template = F.regexp_extract(text, r"(?is)<template\b[^>]*>(.*)</template\s*>", 1)
    tags = F.array_distinct(F.transform(F.regexp_extract_all(template, F.lit(r"<([A-Z][A-Za-z0-9]*|[a-z][a-z0-9]*(?:-[a-z0-9]+)+)[\s/>]"), 1), pascal))
    tags = F.filter(tags, lambda x: ~x.isin("Template", "Component", "Slot", "Transition", "KeepAlive", "RouterLink", "RouterView"))
    named = lambda p: F.regexp_extract_all(script, F.lit(p), 1)
    facts = [
        ("component", F.array(pascal(F.regexp_extract("path", r"([^/]+)\.vue$", 1)))),
        ("script", F.filter(F.array(F.when(F.length(script) > 0, F.coalesce(F.nullif(F.regexp_extract(text, r"""(?is)<script\b[^>]*\blang\s*=\s*["'](\w+)""", 1), F.lit("")), F.lit("js")))), lambda x: x.isNotNull())),
        ("uses", tags),
        ("state", named(r"(?m)\b(?:const|let)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:ref|reactive|shallowRef)\b")),
        ("computed", named(r"(?m)\bconst\s+([A-Za-z_$][\w$]*)\s*=\s*computed\b")),
        ("hook", F.array_distinct(named(r"\b(on(?:Mounted|Unmounted|Updated|BeforeMount|BeforeUnmount))\s*\("))),
        ("macro", F.array_distinct(named(r"\b(define(?:Props|Emits|Expose))\b"))),
        ("selector", F.array_distinct(F.regexp_extract_all(block("style"), F.lit(r"([.#][A-Za-z_][\w-]*)(?=[^{}]*\{)"), 1))),
    ]
    told = lambda fact: lambda name: F.struct(F.lit(fact).alias("fact"), name.alias("name"))
    each = F.flatten(F.array(*[F.transform(names, told(fact)) for fact, names in facts]))
    return spread(files.select("path", "text").filter(F.lower("path").endswith(".vue"))).select("path", F.explode(each).alias("f")).select("path", "f.fact", "f.name")
