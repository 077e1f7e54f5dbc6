"""Module resolution, one query a language: files and imports are written from customers, whose numbers tell what each import leads to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.catalog.registry import query
from tessera.operators import modules
from tessera.sources import adapter

#: By language: files (SQL of a path from k and n, the customer's number and nation), roots, and imports (file, module, target or null, state). {x} is a name that tells k.
PROJECTS = {
    "typescript": (
        ["'src/n' || n || '/m' || k || case k % 3 when 0 then '.ts' when 1 then '.tsx' else '/index.ts' end"],
        [("'@/n' || n", "'src/n' || n"), ("'@'", "'src'")],
        [
            ("'src/n' || n || '/user' || k || '.ts'", "'./m' || k || '.js'", "'src/n' || n || '/m' || k || case k % 3 when 0 then '.ts' when 1 then '.tsx' else '/index.ts' end", "resolved"),
            ("'test/a/b' || k || '.ts'", "'@/n' || n || '/m' || k", "'src/n' || n || '/m' || k || case k % 3 when 0 then '.ts' when 1 then '.tsx' else '/index.ts' end", "resolved"),
            ("'test/a/b' || k || '.ts'", "'../../src/./n' || n || '/gone' || k", "null", "unresolved"),
            ("'test/a/b' || k || '.ts'", "'@x/m' || k", "null", "external"),
        ],
    ),
    "python": (
        ["'pkg' || n || '/m' || k || case k % 2 when 0 then '.py' else '/__init__.py' end"],
        [("'lib' || n", "'vendor/../pkg' || n")],
        [
            ("'pkg' || n || '/deep/u' || k || '.py'", "'..m' || k", "'pkg' || n || '/m' || k || case k % 2 when 0 then '.py' else '/__init__.py' end", "resolved"),
            ("'pkg' || n || '/v' || k || '.py'", "'m' || k", "'pkg' || n || '/m' || k || case k % 2 when 0 then '.py' else '/__init__.py' end", "resolved"),
            ("'app/w' || k || '.py'", "'pkg' || n || '.m' || k", "'pkg' || n || '/m' || k || case k % 2 when 0 then '.py' else '/__init__.py' end", "resolved"),
            ("'app/w' || k || '.py'", "'lib' || n || '.m' || k", "'pkg' || n || '/m' || k || case k % 2 when 0 then '.py' else '/__init__.py' end", "resolved"),
            ("'app/w' || k || '.py'", "'.none' || k", "null", "unresolved"),
            ("'app/w' || k || '.py'", "'numpy.x' || k", "null", "external"),
        ],
    ),
    "java": (
        ["case k % 3 when 0 then '' when 1 then 'src/' else 'src/main/java/' end || 'com/n' || n || '/T' || k || '.java'"],
        [],
        [("'src/U' || k || '.java'", "'com.n' || n || '.T' || k", "case k % 3 when 0 then '' when 1 then 'src/' else 'src/main/java/' end || 'com/n' || n || '/T' || k || '.java'", "resolved"), ("'src/U' || k || '.java'", "'java.util.L' || k", "null", "external")],
    ),
    "go": (
        ["'svc' || n || '/p' || k || '/x.go'", "'util' || k || '/y.go'"],
        [("'ex.com/n' || n", "'svc' || n"), ("'ex.com'", "'none'")],
        [
            ("'cmd/c' || k || '.go'", "'ex.com/n' || n || '/p' || k", "'svc' || n || '/p' || k", "resolved"),
            ("'cmd/c' || k || '.go'", "'util' || k", "'util' || k", "resolved"),
            ("'cmd/c' || k || '.go'", "'ex.com/n' || n || '/q' || k", "null", "unresolved"),
            ("'cmd/c' || k || '.go'", "'github.com/a/b' || k", "null", "external"),
        ],
    ),
    "rust": (
        ["'src/n' || n || '/m' || k || case k % 2 when 0 then '.rs' else '/mod.rs' end"],
        [],
        [
            ("'src/a/u' || k || '.rs'", "'crate::n' || n || '::m' || k || '::Item'", "'src/n' || n || '/m' || k || case k % 2 when 0 then '.rs' else '/mod.rs' end", "resolved"),
            ("'src/n' || n || '/w' || k || '.rs'", "'super::m' || k || '::Item'", "'src/n' || n || '/m' || k || case k % 2 when 0 then '.rs' else '/mod.rs' end", "resolved"),
            ("'src/a/u' || k || '.rs'", "'std::io::R' || k", "null", "external"),
        ],
    ),
    "php": (
        ["'app/N' || n || '/M' || k || '.php'", "'Plain/P' || k || '.php'"],
        [("'App\\\\N' || n || '\\\\'", "'app/N' || n"), ("'App\\\\'", "'other'")],
        [
            ("'web/u' || k || '.php'", "'App\\\\N' || n || '\\\\M' || k", "'app/N' || n || '/M' || k || '.php'", "resolved"),
            ("'web/u' || k || '.php'", "'Plain\\\\P' || k", "'Plain/P' || k || '.php'", "resolved"),
            ("'web/u' || k || '.php'", "'App\\\\Gone' || k", "null", "unresolved"),
            ("'web/u' || k || '.php'", "'Other\\\\X' || k", "null", "external"),
        ],
    ),
    "ruby": (
        ["case k % 3 when 0 then '' when 1 then 'lib/' else 'app/' end || 'n' || n || '/m' || k || '.rb'"],
        [],
        [("'app/n' || n || '/u' || k || '.rb'", "'n' || n || '/m' || k", "case k % 3 when 0 then '' when 1 then 'lib/' else 'app/' end || 'n' || n || '/m' || k || '.rb'", "resolved"), ("'x/u' || k || '.rb'", "'./none' || k", "null", "unresolved"), ("'x/u' || k || '.rb'", "'json' || k", "null", "external")],
    ),
}


def _query(lang: str, files: list[str], roots: list[tuple[str, str]], imports: list[tuple[str, str, str, str]]) -> None:
    sql = " union all ".join(f"select {f} as file_path, {m} as module_path, cast({t} as varchar) as target, '{state}' as state from (select c_custkey as k, c_nationkey as n from customer) x" for f, m, t, state in imports)

    @query(f"x19_{lang}_modules", sql.replace("\\\\", "\\"))
    def run(spark, sf_dir) -> DataFrame:
        c = adapter.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"))

        def rows(each: list[tuple[str, ...]], names: str) -> DataFrame:
            at = [F.struct(*[F.expr(x).alias(n) for x, n in zip(e, names.split(), strict=True)]) for e in each]
            return c.select(F.explode(F.array(*at)).alias("f")).select("f.*")

        folders = rows([(f"'{lang}'", *r) for r in roots], "lang prefix folder") if roots else spark.createDataFrame([], "lang string, prefix string, folder string")
        return modules.resolve_modules(rows([i[:2] for i in imports], "file_path module_path"), rows([(f,) for f in files], "path"), folders.distinct())


for _lang, _project in PROJECTS.items():
    _query(_lang, *_project)
