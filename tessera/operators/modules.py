"""Module names to files, by the rules of each language.

What stands in front of a module name (an alias, a Go module, a PHP namespace) is found by a join: each name gives all its
prefixes, roots give theirs, and of those that meet the longest counts. What then remains, or a relative path, becomes a
handful of paths in the order in which the language tries them, and the first that is a file wins. No list of files is
broadcast or looped over, and roots only if a count shows that they are few; thousands of packages are one more join. The
joins are told to merge: sizes guessed before rows are exploded are far too small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import paths
from tessera.plans.cut import cut, small

# What parts the names of a module, and the paths that a language tries, in order.
SEPARATORS = {"typescript": "/", "javascript": "/", "python": ".", "java": ".", "go": "/", "rust": "::", "php": "\\", "ruby": "/"}
SCRIPT_ENDINGS = (".ts", ".tsx", ".js", ".jsx", ".vue", "/index.ts", "/index.tsx", "/index.js")
JAVA_ROOTS, RUBY_ROOTS = ("", "src/", "src/main/java/"), ("", "lib/", "app/")


def normal(path: Column) -> Column:
    """A path without . and .. and empty parts; .. above the root is dropped."""

    def step(done: Column, part: Column) -> Column:
        return F.when(part.isin("", "."), done).when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, part))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def with_roots(modules: DataFrame, roots: DataFrame) -> DataFrame:
    """modules (lang, module) with the folder and the length of the longest root (lang, prefix, folder) in front of each that has one.

    A root stands in front if it is the whole name or ends where a part of the name does. Of roots that are equal the first folder counts.
    """
    separator = F.create_map(*[F.lit(x) for kv in SEPARATORS.items() for x in kv])[F.col("lang")]
    parts = F.split("module", F.concat(F.lit("\\Q"), separator, F.lit("\\E")))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.call_function("array_join", F.slice(parts, F.lit(1), n), separator))
    each = modules.select("lang", "module", F.explode(prefixes).alias("prefix"))
    known = roots.groupBy("lang", F.rtrim("prefix", F.lit("\\/")).alias("prefix")).agg(F.min("folder").alias("folder"))
    found = each.join(small(cut(known)), ["lang", "prefix"]).groupBy("lang", "module").agg(F.max_by(F.struct("folder", F.length("prefix").alias("cut")), F.length("prefix")).alias("root"))
    return found.select("lang", "module", "root.folder", "root.cut")


def candidates(lang: Column, module: Column, file: Column, folder: Column, cut_at: Column) -> Column:
    """The paths to try, in order; an empty array for a module outside the project. A Go path is a package's folder."""
    here = F.regexp_replace(file, "[^/]*$", "")
    rest = F.substring(module, cut_at + 1, F.length(module))
    rooted = folder.isNotNull()
    none = F.array().cast("array<string>")
    several = lambda base, ends: F.array(*[F.concat(base, F.lit(e)) for e in ends])

    script = F.regexp_replace(normal(F.when(rooted, F.concat(folder, rest)).when(module.startswith("/"), module).otherwise(F.concat(here, module))), r"\.(js|jsx|mjs|cjs|ts|tsx|vue)$", "")
    scripts = F.when(rooted | module.rlike(r"^[./]"), several(script, SCRIPT_ENDINGS)).otherwise(none)

    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    tail = F.replace(F.regexp_replace(module, r"^\.+", ""), F.lit("."), F.lit("/"))
    above = F.concat(here, F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0)).cast("int")))
    python_at = lambda base, name: F.array(F.concat(normal(F.concat(base, name)), F.lit(".py")), normal(F.concat(base, name, F.lit("/__init__.py"))))
    relative = F.when(tail == "", F.array(normal(F.concat(above, F.lit("__init__.py"))))).otherwise(python_at(above, tail))
    python = F.when(dots > 0, relative).otherwise(F.concat(F.when(rooted, python_at(F.concat(folder, F.lit("/")), F.replace(rest, F.lit("."), F.lit("/")))).otherwise(none), python_at(F.lit(""), tail), python_at(here, tail)))

    java = F.array(*[F.concat(F.lit(r), F.replace(module, F.lit("."), F.lit("/")), F.lit(".java")) for r in JAVA_ROOTS])
    go = F.when(rooted, F.array(normal(F.concat(folder, rest)))).when(module.contains("."), none).otherwise(F.array(normal(module)))

    item = F.regexp_replace(module, r"::[^:]*$", "")
    ups = F.size(F.split(item, r"super(?:::|$)")) - 1
    in_crate = F.regexp_replace(F.regexp_replace(item, r"^(crate|self|(super(::|$))+)(::)?", ""), "::", "/")
    rust_base = F.when(module.startswith("crate::"), F.lit("src/")).when(module.startswith("self::"), F.concat(F.regexp_replace(F.regexp_replace(file, r"(/mod)?\.rs$", ""), r"/(lib|main)$", ""), F.lit("/"))).otherwise(
        F.concat(F.regexp_replace(F.regexp_replace(file, r"(/mod)?\.rs$", ""), r"/(lib|main)$", ""), F.lit("/"), F.repeat(F.lit("../"), ups.cast("int")))
    )
    rust_path = normal(F.concat(rust_base, in_crate))
    rust = F.when(module.rlike("^(crate|self|super)::") & (item != module), F.when((in_crate == "") & module.startswith("crate::"), none).otherwise(several(rust_path, (".rs", "/mod.rs")))).otherwise(none)

    slashed = lambda c: F.replace(c, F.lit("\\"), F.lit("/"))
    php = F.concat(F.when(rooted, F.array(F.concat(normal(F.concat(folder, F.lit("/"), slashed(rest))), F.lit(".php")))).otherwise(none), F.array(F.concat(normal(slashed(module)), F.lit(".php"))))
    ruby = F.when(module.startswith("."), F.array(F.concat(normal(F.concat(here, module)), F.lit(".rb")))).otherwise(F.array(*[F.concat(F.lit(r), module, F.lit(".rb")) for r in RUBY_ROOTS]))
    each = {"typescript": scripts, "javascript": scripts, "python": python, "java": java, "go": go, "rust": rust, "php": php, "ruby": ruby}
    return F.coalesce(*[F.when(lang == k, v) for k, v in each.items()], none)


def resolve_modules(imports: DataFrame, files: DataFrame, roots: DataFrame) -> DataFrame:
    """imports (file_path, module_path, ...) with target, the file or Go package that the module is, or null, and state.

    roots (lang, prefix, folder): aliases of scripts, package folders of Python, modules of Go, namespaces of PHP. state is resolved,
    unresolved (a path that begins with . or /, or a name under a root, that leads nowhere) or external. Each distinct (file,
    module) is resolved once; imports that repeat all get the answer, and null modules are external.
    """
    lang = paths.language(F.col("file_path"))
    asked = imports.select("file_path", F.col("module_path").alias("module"), lang.alias("lang")).filter("module is not null and lang is not null").distinct()
    rooted = with_roots(asked.select("lang", "module").distinct(), roots)
    asked = asked.join(rooted.hint("merge"), ["lang", "module"], "left")
    tries = asked.select("*", F.posexplode(candidates(F.col("lang"), F.col("module"), F.col("file_path"), F.col("folder"), F.col("cut"))).alias("nth", "path"))
    there = files.select("path", F.lit(False).alias("package")).union(files.filter(F.lower("path").endswith(".go")).select(F.regexp_replace("path", "/?[^/]*$", ""), F.lit(True))).distinct()
    hit = tries.withColumn("package", F.col("lang") == "go").join(there.hint("merge"), ["path", "package"]).groupBy("file_path", "module").agg(F.min_by("path", "nth").alias("target"))
    told = asked.select("file_path", "module", F.col("folder").isNotNull().alias("rooted")).join(hit.hint("merge"), ["file_path", "module"], "left")
    state = F.when(F.col("target").isNotNull(), "resolved").when(F.col("rooted") | F.col("module").rlike("^[./]"), "unresolved").otherwise("external")
    told = told.select("file_path", F.col("module").alias("module_path"), "target", state.alias("state"))
    return imports.join(told.hint("merge"), ["file_path", "module_path"], "left").withColumn("state", F.coalesce("state", F.lit("external"))).select(*imports.columns, "target", "state")
