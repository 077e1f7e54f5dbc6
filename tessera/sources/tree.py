"""Files of a source tree, alias configurations, diffs, and JSON registries as DataFrames."""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.paths import glob_to_regex

# Folders that hold no sources, endings of sources.
SKIPPED = "node_modules dist build .git __pycache__ vendor target coverage .next .nuxt .venv venv env .cache .idea .vscode .tox out".split()
ENDINGS = "ts tsx js jsx mjs cjs py go rs java php rb vue html htm css md".split()


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether a path relative to the root is ignored by rules as version control has them: the last that fits decides, ! takes back, / at the end means folders, a / before it ties to the root."""
    out = F.lit(False)
    for rule in (r.strip() for r in rules):
        if not rule or rule.startswith("#"):
            continue
        back, rule = rule.startswith("!"), rule.lstrip("!")
        folder, tied = rule.endswith("/"), "/" in rule.rstrip("/")
        body = glob_to_regex(rule.strip("/")).removeprefix("(?i)").strip("^$")
        fits = path.rlike(("^" if tied else "(^|/)") + f"(?:{body})" + ("/" if folder else "(/|$)"))
        out = F.when(fits, not back).otherwise(out)
    return out


def scan(spark: SparkSession, root: str, endings: list[str] | None = None, rules: list[str] | None = None, text: bool = True) -> DataFrame:
    """(path, size, text) of the sources under root, by path relative to it.

    Folders of SKIPPED and what the rules ignore are left out, as are minified files. Files are read by Spark's tasks, not by
    the driver; those that vanish or cannot be read drop out. Without text their bytes are not read.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true").load(root)
    base = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*:/*(?=/)|^file:", "", root).rstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-zA-Z][a-zA-Z0-9+.-]*:/*(?=/)", ""), "^" + re.escape(base) + "/", "")
    rows = rows.withColumn("path", path)
    parts = "|".join(re.escape(s) for s in SKIPPED)
    rows = rows.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(endings or ENDINGS) & ~F.col("path").rlike(rf"(^|/)(?:{parts})/") & ~F.col("path").rlike(r"\.min\.[^./]+$"))
    if rules:
        rows = rows.filter(~ignored(F.col("path"), rules))
    return rows.select("path", F.col("length").alias("size"), *([F.col("content").cast("string").alias("text")] if text else []))


ALIASES = "path string, kind string, prefix string, target string, parent string"
_COMMENTS = re.compile(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', re.S)


def _jsonc(text: str) -> dict:
    """JSON with comments and commas at the end of lists."""
    plain = _COMMENTS.sub(lambda m: m.group(1) or "", text)
    got = json.loads(re.sub(r",\s*([}\]])", r"\1", plain))
    return got if isinstance(got, dict) else {}


def _aliases_of(path: str, text: str) -> list[tuple]:
    """(kind, prefix, target, parent) of one configuration; parent: the file that it extends."""
    name, here = posixpath.basename(path), posixpath.dirname(path)
    at = lambda *p: posixpath.normpath(posixpath.join(here, *p)).removeprefix("./")
    out: list[tuple] = []
    if re.fullmatch(r"(ts|js)config(\..+)?\.json", name) or name.endswith(".json") and '"compilerOptions"' in text:
        got = _jsonc(text)
        options = got.get("compilerOptions") or {}
        for prefix, to in (options.get("paths") or {}).items():
            out += [("ts", prefix.removesuffix("*"), at(options.get("baseUrl") or ".", t.removesuffix("*")).rstrip("/") + ("/" if t.endswith("*") else ""), None) for t in to[:1]]
        for parent in [got.get("extends"), *[r.get("path") for r in got.get("references") or [] if isinstance(r, dict)]]:
            if isinstance(parent, str) and parent.startswith("."):
                out.append(("ts", None, None, at(parent if parent.endswith(".json") else posixpath.join(parent, "tsconfig.json") if parent.endswith("/") or "." not in posixpath.basename(parent) and parent != got.get("extends") else parent + ".json")))
    elif name == "composer.json":
        got = _jsonc(text)
        for part in ("autoload", "autoload-dev"):
            out += [("php", p, at(t[0] if isinstance(t, list) else t) + "/", None) for p, t in ((got.get(part) or {}).get("psr-4") or {}).items()]
    elif name == "go.mod":
        out += [("go", m.group(1) + "/", at(".") + "/" if here else "", None) for m in re.finditer(r"(?m)^module\s+(\S+)", text)]
    elif name == "Cargo.toml":
        if m := re.search(r'(?ms)^\[package\].*?^name\s*=\s*"([^"]+)"', text):
            out += [("rust", "crate::", at("src") + "/", None), ("rust", m.group(1).replace("-", "_") + "::", at("src") + "/", None)]
    elif name == "pyproject.toml":
        if m := re.search(r'(?m)^name\s*=\s*"([^"]+)"', text):
            package = m.group(1).replace("-", "_")
            out.append(("python", package + ".", at("src" if re.search(r'(?m)^\s*where\s*=\s*\[\s*"src"|package-dir.*src', text) else ".", package) + "/", None))
    elif re.fullmatch(r"vite\.config\.[cm]?[jt]s", name):
        for m in re.finditer(r"""['"]?([@~\w$/-]+)['"]?\s*:\s*(?:path\.)?resolve\(\s*__dirname\s*,\s*['"]([^'"]+)['"]|['"]?([@~][\w$/-]*)['"]?\s*:\s*['"](\.?/[^'"]+)['"]""", text):
            out.append(("vite", (m.group(1) or m.group(3)).rstrip("/") + "/", at((m.group(2) or m.group(4)).lstrip("/")) + "/", None))
    return out


def aliases(files: DataFrame) -> DataFrame:
    """(config, prefix, target, kind): what import prefixes stand for, by configurations (path, text) of the TypeScript family, composer, Go, Cargo, Python and Vite.

    A configuration that extends or refers to another has its aliases too, its own first; chains of any length are followed.
    One that cannot be read gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                try:
                    rows += [(path, *r) for r in _aliases_of(path, text or "")]
                except (ValueError, AttributeError, TypeError):
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(5)], [c.split()[0] for c in ALIASES.split(", ")])

    from tessera.plans.cut import cut

    config = F.regexp_extract("path", "[^/]+$", 0).rlike(r"^((ts|js)config(\..+)?\.json|composer\.json|go\.mod|Cargo\.toml|pyproject\.toml|vite\.config\.[cm]?[jt]s)$")
    config = config | (F.col("path").endswith(".json") & F.col("text").contains('"compilerOptions"'))  # what others extend may have any name
    rows = cut(files.filter(config).select("path", "text").mapInArrow(run, ALIASES))
    up = rows.filter("parent is not null").select("path", "parent").distinct()
    seen = frontier = rows.select("path", F.col("path").alias("from_path"), F.lit(0).alias("hops")).distinct()
    while not frontier.isEmpty():
        step = frontier.join(up.withColumnRenamed("path", "from_path"), "from_path").select("path", F.col("parent").alias("from_path"), (F.col("hops") + 1).alias("hops")).distinct()
        frontier = cut(step.join(seen.select("path", "from_path"), ["path", "from_path"], "left_anti"))
        seen = seen.unionAll(frontier)
    own = rows.filter("prefix is not null").select(F.col("path").alias("from_path"), "prefix", "target", "kind")
    best = seen.join(own, "from_path").groupBy(F.col("path").alias("config"), "prefix").agg(F.min(F.struct("hops", "from_path", "target", "kind")).alias("b"))
    return best.select("config", "prefix", "b.target", "b.kind")


HUNK = r"(?m)^@@ -[0-9]+(?:,[0-9]+)? \+([0-9]+)(?:,([0-9]+))? @@"


def hunks(diffs: DataFrame) -> DataFrame:
    """(file_path, from_line, to_line, is_binary) of unified diffs (text): each hunk's lines in the new file; a hunk that only takes away is the line before it; a binary file has one row without lines."""
    files = diffs.select(F.explode(F.split("text", r"(?m)^(?=diff --git )")).alias("d")).filter(F.col("d").startswith("diff --git "))
    named = F.regexp_extract("d", r"(?m)^\+\+\+ b/(.+?)[ \t]*$", 1)
    path = F.when(named == "", F.regexp_extract("d", r"^diff --git a/.+? b/(.+)", 1)).otherwise(named)
    binary = F.col("d").rlike(r"(?m)^(Binary files .* differ|GIT binary patch)")
    heads = F.regexp_extract_all("d", F.lit(HUNK), 0)
    rows = files.select(path.alias("file_path"), binary.alias("is_binary"), F.explode_outer(heads).alias("h")).filter("h is not null or is_binary")
    first = F.regexp_extract("h", HUNK, 1).try_cast("int")
    n = F.when(F.regexp_extract("h", HUNK, 2) == "", 1).otherwise(F.regexp_extract("h", HUNK, 2).try_cast("int"))
    return rows.select("file_path", first.alias("from_line"), F.when(n == 0, first).otherwise(first + n - 1).alias("to_line"), "is_binary")


class Registry:
    """Repositories by root in a JSON file folder: entries are appended, the newest of a root counts, and a removal is an entry too."""

    SCHEMA = "root string, name string, indexed_at timestamp, symbols long, removed boolean, n long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMA).json(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], self.SCHEMA)
            raise

    def all(self) -> DataFrame:
        newest = Window.partitionBy("root").orderBy(F.desc("n"))
        return self._rows().withColumn("r", F.row_number().over(newest)).filter("r = 1 and not removed").drop("r", "n", "removed")

    def _append(self, rows: DataFrame) -> None:
        n = self._rows().agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
        rows.withColumn("n", F.lit(n + 1).cast("long")).write.mode("append").json(self.path)

    def register(self, rows: DataFrame) -> None:
        """rows: root, name, indexed_at, symbols."""
        self._append(rows.select("root", "name", "indexed_at", "symbols", F.lit(False).alias("removed")))

    def remove(self, roots: DataFrame) -> None:
        self._append(roots.select("root", F.lit(None).cast("string").alias("name"), F.lit(None).cast("timestamp").alias("indexed_at"), F.lit(None).cast("long").alias("symbols"), F.lit(True).alias("removed")))

    def find(self, root: str) -> DataFrame:
        return self.all().filter(F.col("root") == root)


RESOURCES = ("symbol", "file", "domain", "overview")


def resource(uri: str, symbols: DataFrame, links: DataFrame, domains: DataFrame | None = None) -> DataFrame:
    """(uri, key, value) for a read-only address: symbol://id, file://path, domain://name (domains: file, domain) or overview://."""
    kind, _, key = uri.partition("://")
    if kind not in RESOURCES:
        raise ValueError(f"no resource {uri!r}")
    if kind == "symbol":
        s = symbols.filter(F.col("id") == key)
        pairs = s.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, ("name", "kind", "file"))), F.array("name", "kind", "file_path"))).alias("key", "value"))
        ends = [links.filter(F.col(a) == key).select(F.concat(F.lit(f"{word}:"), "type").alias("key"), F.col(b).alias("value")) for a, b, word in (("from_id", "to_id", "to"), ("to_id", "from_id", "from"))]
        rows = pairs.unionAll(ends[0]).unionAll(ends[1])
    elif kind == "file":
        rows = symbols.filter(F.col("file_path") == key).select(F.col("id").alias("key"), F.concat_ws(" ", "kind", "name").alias("value"))
    elif kind == "domain":
        rows = domains.filter(F.col("domain") == key).select(F.col("file").alias("key"), F.col("domain").alias("value"))
    else:
        rows = symbols.groupBy(F.col("kind").alias("key")).agg(F.count("*").cast("string").alias("value")).unionAll(links.groupBy(F.concat(F.lit("link:"), "type").alias("key")).agg(F.count("*").cast("string").alias("value")))
    return rows.select(F.lit(uri).alias("uri"), "key", "value")
