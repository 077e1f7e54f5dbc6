"""Resolution of facts to links: all candidates of a call by tier, of which the best wins; imports, heritage, types, re-exports, method orders."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import names
from tessera.plans.cut import cut

EXTERNAL = "#external:"


def state_of(module: Column) -> Column:
    """external for a bare module name, unresolved for a path that leads nowhere."""
    return F.when(module.rlike(r"^[./]"), "unresolved").otherwise("external")


def _link(rows: DataFrame, source: str, target: str, type_: str, confidence: float | Column, reason: str | Column, line: str = "line") -> DataFrame:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return rows.select(F.col(source).alias("from_id"), F.col(target).alias("to_id"), F.lit(type_).alias("type"), as_col(confidence).cast("double").alias("confidence"), as_col(reason).alias("reason"), F.col(line).cast("int").alias("line"))


def module_of(path: str = "file_path") -> Column:
    return F.concat(F.col(path), F.lit("#module:_top:0"))


def follow_reexports(names: DataFrame, reexports: DataFrame, exports: DataFrame, hops: int = 6) -> DataFrame:
    """(key, target_id): where a name (key, file, name) is declared, through at most hops re-exports; a named one goes before a wildcard."""
    at, found = names.select("key", "file", "name"), []
    r = reexports.select(F.col("file").alias("file"), F.col("name").alias("named"), F.col("source").alias("next"))
    e = exports.select(F.col("file_path").alias("file"), "name", F.col("id").alias("target_id"))
    for _ in range(hops + 1):
        at = cut(at)
        if at.isEmpty():
            break
        found.append(at.join(e, ["file", "name"]).select("key", "target_id"))
        step = at.join(e, ["file", "name"], "left_anti").join(r, "file").filter((F.col("named") == F.col("name")) | (F.col("named") == "*"))
        best = Window.partitionBy("key").orderBy(F.when(F.col("named") == "*", 1).otherwise(0), "next")
        at = step.withColumn("r", F.row_number().over(best)).filter("r = 1").select("key", F.col("next").alias("file"), "name")
    found = found or [at.select("key", F.lit(None).cast("string").alias("target_id")).limit(0)]
    return reduce(DataFrame.unionByName, found).groupBy("key").agg(F.min("target_id").alias("target_id"))


def import_links(imports: DataFrame, symbols: DataFrame, reexports: DataFrame) -> DataFrame:
    """Links of imports (file_path, target, name, kind: default, named or wildcard, line).

    A default import takes the class, else the function, else the first export of its target, or the module if it exports
    nothing; a named one the export of that name, or what re-exports lead to; a wildcard every export.
    """
    exported = symbols.filter("exported")
    rows = imports.filter("target is not null").withColumn("from_id", module_of()).withColumn("key", F.struct("target", "name"))
    rank = F.when(F.col("kind") == "class", 0).when(F.col("kind") == "function", 1).otherwise(2)
    main = exported.groupBy(F.col("file_path").alias("target")).agg(F.min_by("id", F.struct(rank, "start_line", "id")).alias("to_id"))
    default = rows.filter("kind = 'default'").join(main, "target", "left").withColumn("known", F.col("to_id").isNotNull()).withColumn("to_id", F.coalesce("to_id", module_of("target")))
    named = rows.filter("kind = 'named'")
    chain = follow_reexports(named.select("key", F.col("target").alias("file"), "name").distinct(), reexports, exported)
    each = exported.select(F.col("file_path").alias("target"), F.col("id").alias("to_id"))
    parts = [
        _link(default, "from_id", "to_id", "imports", F.when(F.col("known"), 0.85).otherwise(0.6), F.when(F.col("known"), "import-default").otherwise("import-default-module")),
        _link(named.join(chain, "key"), "from_id", "target_id", "imports", 0.95, "import-named"),
        _link(rows.filter("kind = 'wildcard'").join(each, "target"), "from_id", "to_id", "imports", 0.65, "import-wildcard"),
    ]
    return reduce(DataFrame.unionByName, parts)


#: Types whose members are methods, by kind.
TYPES = ("class", "interface", "struct", "trait")


def _column(rows: DataFrame, name: str, default: Column) -> DataFrame:
    return rows if name in rows.columns else rows.withColumn(name, default)


def variable_types(bindings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of bindings (file_path, name, type_name and, if there are, scope_id): the type of a variable in a scope, and in its file (outside all scopes, else anywhere)."""
    rows = _column(bindings, "scope_id", F.lit(None).cast("string"))
    scoped = rows.filter("scope_id is not null").groupBy("file_path", "name", "scope_id").agg(F.min("type_name").alias("type_name"))
    in_file = rows.groupBy("file_path", "name").agg(F.min_by("type_name", F.struct(F.col("scope_id").isNotNull(), "type_name")).alias("type_name"))
    return scoped, in_file


#: The ways to a symbol, the first of which counts: type, confidence and reason of the link. The second gives none.
WAYS = [
    ("calls", 0.95, "call-alias"), ("calls", 0.0, "external"), ("calls", 0.9, "call-unique"), ("calls", 0.95, "call-receiver"), ("calls", 0.9, "call-receiver"), ("calls", 0.93, "call-receiver"),
    ("calls", 0.92, "call-receiver"), ("calls", 0.85, "call-receiver"), ("calls", 0.93, "call-receiver"), ("calls", 0.55, "call-receiver"), ("calls", 0.9, "call-receiver"), ("calls", 0.9, "call-samefile"),
    ("calls", 0.95, "call-imported"), ("calls", 0.85, "call-proximity"), ("calls", 0.6, "call-proximity"), ("references", 0.85, "receiver-ref-default"), ("references", 0.85, "receiver-ref"), ("references", 0.85, "receiver-ref"),
]
#: The ways that a name local to its scope leaves open.
OPEN_TO_LOCALS = (0, 11, 12)
FOLDER = "[^/]*$"
#: What decides a call: calls alike in these have the same answer.
ASKED = ["file_path", "name", "receiver", "argument", "around", "scoped_type"]


def _asked(calls: DataFrame, symbols: DataFrame, scoped: DataFrame) -> DataFrame:
    """calls with ask, the struct of what decides them: around is the class around a call on this or self, scoped_type the type of the receiver in the call's scope or the one around."""
    c = _column(_column(calls, "argument", F.lit(False)), "receiver", F.lit(None).cast("string")).withColumn("receiver", F.nullif("receiver", F.lit("")))
    none = F.lit(None).cast("string")
    bare = c.filter("receiver is null").withColumns({"around": none, "scoped_type": none})
    own = symbols.filter("parent_id is not null").select(F.col("id").alias("scope_id"), F.col("parent_id").alias("outer"))
    on = c.filter("receiver is not null").withColumn("variable", F.regexp_replace("receiver", r"^(this|self)\.", "")).join(own, "scope_id", "left")
    on = on.join(scoped.withColumnRenamed("type_name", "type_here"), ["file_path", "variable", "scope_id"], "left")
    # a scope that nothing is around looks into itself again: null keys would all meet in one task
    outer = scoped.select("file_path", "variable", F.col("scope_id").alias("look_in"), F.col("type_name").alias("type_around"))
    on = on.withColumn("look_in", F.coalesce("outer", "scope_id")).join(outer, ["file_path", "variable", "look_in"], "left")
    on = on.withColumns({"around": F.when(F.col("receiver").isin("this", "self"), F.col("outer")), "scoped_type": F.coalesce("type_here", "type_around")})
    ask = F.struct(*ASKED).alias("ask")
    return cut(on.select(ask, "scope_id", "line")).unionByName(bare.select(ask, "scope_id", "line"))


def _answers(asked: DataFrame, symbols: DataFrame, imports: DataFrame, in_file: DataFrame, ancestors: DataFrame | None, globals_: list[str], methods: list[str]) -> DataFrame:
    """(ask, free, held): the best way (tier, to_id) of every distinct question, and the best of those open to a name local to its scope.

    Each way has its best symbol (first by file, line and id) worked out once for a name within a file, folder, type, class or the
    project. Only questions that can go a way are joined with it, so no join meets null keys.
    """
    q = cut(asked.select("ask").distinct().select("ask", "ask.*", F.monotonically_increasing_id().alias("q")))
    s = symbols.select(F.col("name"), F.struct(F.col("file_path").alias("to_file"), "start_line", F.col("id").alias("to_id")).alias("to"), F.col("parent_id").alias("to_parent"), "kind", F.col("file_path").alias("to_file"))
    types = symbols.filter(F.col("kind").isin(*TYPES)).select(F.col("id").alias("to_parent"), F.col("name").alias("type_name"))

    def best(rows: DataFrame, *by: str) -> DataFrame:
        return rows.groupBy(*by).agg(F.min("to").alias("to"))

    members = s.join(types, "to_parent")
    by_file, by_parent, by_type = best(s, "to_file", "name"), best(s.filter("to_parent is not null"), "to_parent", "name"), best(members, "type_name", "name")
    by_pascal = by_type
    if ancestors is not None:  # a method of the nearest ancestor that has one
        above = ancestors.select(F.col("class").alias("own"), F.col("ancestor").alias("type_name"), "position").join(by_type, "type_name").select(F.col("own").alias("type_name"), "name", F.struct("position", "to").alias("found"))
        own = by_type.select("type_name", "name", F.struct(F.lit(-1).alias("position"), "to").alias("found"))
        by_type = own.unionByName(above).groupBy("type_name", "name").agg(F.min("found")["to"].alias("to"))
    alone = s.groupBy("name").agg(F.count("*").alias("n"), F.min("to").alias("to"), F.min("kind").alias("only_kind")).filter("n = 1")
    names = imports.filter("kind <> 'wildcard'").select("file_path", F.coalesce("alias", "name").alias("local"), F.when(F.col("alias") != F.col("name"), F.col("name")).alias("real"), F.col("target").alias("bound_file"), "kind", "line")
    reached = names.filter("bound_file is not null").groupBy("file_path", "local").agg(F.max_by(F.struct("bound_file", "real", F.when(F.col("kind") == "default", F.col("bound_file")).alias("default_file")), F.struct("line", "bound_file")).alias("bound"))
    reached = reached.select("file_path", "local", "bound.*")
    outside = names.filter("bound_file is null").select("file_path", F.col("local").alias("name"), F.lit(True).alias("outside")).distinct()
    exported = symbols.filter("exported")
    rank = F.when(F.col("kind") == "class", 0).when(F.col("kind") == "function", 1).otherwise(2)
    main = exported.groupBy(F.col("file_path").alias("default_file")).agg(F.min_by("id", F.struct(rank, "start_line", "id")).alias("main_id"))
    given = best(exported.select(F.col("file_path").alias("bound_file"), F.col("name").alias("real"), F.struct(F.col("file_path").alias("to_file"), "start_line", F.col("id").alias("to_id")).alias("to")), "bound_file", "real")
    here = symbols.filter(F.col("kind").isin("class", "struct", "trait")).groupBy("file_path", F.col("name").alias("receiver")).agg(F.min("id").alias("to_parent"))

    def way(rows: DataFrame, tier: int | Column, to: str = "to.to_id") -> DataFrame:
        return rows.select("q", F.struct((tier if isinstance(tier, Column) else F.lit(tier)).alias("tier"), F.col(to).alias("to_id")).alias("way"))

    bare, on = q.filter("receiver is null"), q.filter("receiver is not null")
    got, field = F.col("receiver").isNotNull(), F.col("receiver").rlike(r"^(this|self)\.")
    untyped = F.col("file_path").rlike(r"(?i)\.(py|rb|php)$")
    unique = q.join(alone, "name").filter(~F.col("argument") & ~(got & F.col("name").isin(*methods)) & ~(got & (F.col("only_kind") == "function") & untyped)).join(outside, ["file_path", "name"], "left")
    bound = bare.join(reached.withColumnRenamed("local", "name"), ["file_path", "name"])
    of = on.join(reached.withColumnRenamed("local", "receiver"), ["file_path", "receiver"], "left")
    known, defaults = of.filter("bound_file is not null"), of.filter("default_file is not null").join(main, "default_file")
    plain = ~F.col("receiver").isin("this", "self") & ~F.col("receiver").contains(".") & ~F.col("argument")
    typed = on.withColumn("variable", F.regexp_replace("receiver", r"^(this|self)\.", "")).join(in_file, ["file_path", "variable"], "left").withColumn("type_name", F.coalesce("scoped_type", "type_file")).filter("type_name is not null")
    pascal = on.withColumn("type_name", F.concat(F.upper(F.substring("receiver", 1, 1)), F.expr("substring(receiver, 2)")))
    near = bare.join(by_file.select(F.col("to_file").alias("file_path"), "name"), ["file_path", "name"], "left_anti").join(alone.select("name", F.lit(False).alias("argument")), ["name", "argument"], "left_anti")
    files = imports.filter("target is not null").select("file_path", F.col("target").alias("to_file")).distinct()
    in_folder = best(s.withColumn("folder", F.regexp_replace("to_file", FOLDER, "")), "folder", "name")
    at_file, as_parent = F.coalesce("bound_file", "file_path"), F.col("main_id").alias("to_parent")
    ways = [
        way(bound.filter("real is not null").join(given, ["bound_file", "real"]), 0),
        way(unique, F.when(F.col("name").isin(*globals_) | F.coalesce("outside", F.lit(False)), 1).otherwise(2)),
        way(on.filter("around is not null").withColumnRenamed("around", "to_parent").join(by_parent, ["to_parent", "name"]), 3),
        way(defaults.select("q", "name", as_parent).join(by_parent, ["to_parent", "name"]), 4),
        way(known.select("q", "name", F.col("bound_file").alias("to_file"), F.col("receiver").alias("type_name")).join(best(members, "to_file", "type_name", "name"), ["to_file", "type_name", "name"]), 6),
        way(known.select("q", "name", F.col("bound_file").alias("to_file")).join(by_file, ["to_file", "name"]), 7),
        way(typed.join(by_type, ["type_name", "name"]), F.when(field, 5).otherwise(8)),
        way(pascal.join(by_pascal, ["type_name", "name"]), 9),
        way(on.join(here, ["file_path", "receiver"]).join(by_parent, ["to_parent", "name"]), 10),
        way(bare.withColumnRenamed("file_path", "to_file").join(by_file, ["to_file", "name"]), 11),
        way(bound.select("q", "name", F.col("bound_file").alias("to_file")).join(by_file, ["to_file", "name"]), 12),
        way(near.join(files, "file_path").join(by_file, ["to_file", "name"]).groupBy("q").agg(F.min("to").alias("to")), 13),
        way(near.withColumn("folder", F.regexp_replace("file_path", FOLDER, "")).join(in_folder, ["folder", "name"]), 14),
        way(defaults.filter(plain), 15, "main_id"),
        way(known.filter(plain & F.col("real").isNotNull()).select("q", F.col("bound_file").alias("to_file"), F.col("real").alias("name")).join(by_file, ["to_file", "name"]), 16),
        way(of.filter(plain).select("q", at_file.alias("to_file"), F.col("receiver").alias("name")).join(by_file, ["to_file", "name"]), 17),
    ]
    won = reduce(DataFrame.unionByName, ways).groupBy("q").agg(F.min("way").alias("free"), F.min(F.when(F.col("way.tier").isin(*OPEN_TO_LOCALS), F.col("way"))).alias("held"))
    return q.join(won, "q").select("ask", "free", "held")


def call_links(calls: DataFrame, symbols: DataFrame, imports: DataFrame, locals_: DataFrame, bindings: DataFrame, ancestors: DataFrame | None = None, globals_: list[str] = names.GLOBALS, methods: list[str] = names.METHODS) -> DataFrame:
    """Links of calls (call_id, file_path, scope_id, name, receiver, line and, if there is, argument: only passed on).

    The first of these that holds decides. An imported alias without a receiver: what it stands for (.95). The only symbol of
    the name (.9), unless a built-in method is called on a receiver, a function on a receiver in a language without declared
    types, the name is only passed on, or it is local to its scope; if it is a global or imported from outside, there is no
    link. With a receiver: this or self to a method of the class around (.95); a default import to one of what it exports
    (.9); a field of this by its type (.93); an imported type to its method (.92) or to any symbol of its file (.85); a
    variable by its type (.93); a type called like the receiver with a capital (.55); a class of that name in the file (.9);
    else no call link. Without: the same file (.9), the imported file (.95), nothing for a local name, then nearness: an
    imported file (.85) or the same folder (.6). A receiver that led nowhere and is a plain name is itself referred to (.85).
    ancestors (class, ancestor, position): a variable's type has their methods too, the nearest first.

    Calls alike in all that decides are one question; questions meet the symbols, and calls only their answers.
    """
    scoped, in_file = variable_types(bindings)
    asked = _asked(calls, symbols, scoped.withColumnRenamed("name", "variable"))
    in_file = in_file.select("file_path", F.col("name").alias("variable"), F.col("type_name").alias("type_file"))
    found = asked.join(_answers(asked, symbols, imports, in_file, ancestors, globals_, methods), "ask")
    bare = F.col("ask.receiver").isNull()
    known = locals_.select("scope_id", "name", F.lit(True).alias("is_local")).distinct()
    told = found.filter(bare).withColumn("name", F.col("ask.name")).join(known, ["scope_id", "name"], "left").drop("name").withColumn("way", F.when(F.col("is_local"), F.col("held")).otherwise(F.col("free"))).drop("is_local")
    told = told.unionByName(found.filter(~bare).withColumn("way", F.col("free"))).filter("way.tier <> 1")
    kind = F.array(*[F.struct(F.lit(t).alias("type"), F.lit(c).alias("confidence"), F.lit(r).alias("reason")) for t, c, r in WAYS])[F.col("way.tier")]
    return told.select(F.col("scope_id").alias("from_id"), "way.to_id", kind["type"].alias("type"), kind["confidence"].alias("confidence"), kind["reason"].alias("reason"), F.col("line").cast("int").alias("line"))


def _first_named(rows: DataFrame, types: DataFrame, name: str) -> DataFrame:
    """rows (file_path, ...) with the first id of a type of that name in the row's file (here) and in the project (anywhere): one row each, however many types share a name."""
    t = types.select(F.col("name").alias(name), F.col("file_path"), F.col("id"))
    here = t.groupBy("file_path", name).agg(F.min("id").alias("here"))
    anywhere = here.groupBy(name).agg(F.min("here").alias("anywhere"))
    return rows.join(here, ["file_path", name], "left").join(anywhere, name, "left")


def _nearest(*more: str) -> Column:
    """Of a group's rows with here and anywhere: the first here, else the first anywhere; more comes along."""
    return F.min(F.struct(F.when(F.col("here").isNotNull(), 0).otherwise(1).alias("far"), F.coalesce("here", "anywhere").alias("to_id"), *more))


def heritage_links(heritage: DataFrame, symbols: DataFrame) -> DataFrame:
    """Links of heritage (file_path, child, parent, type, line): the child in its file to the parent, same file first; unknown parents are external nodes."""
    kinds = symbols.filter("kind in ('class', 'interface', 'struct', 'trait')")
    child = kinds.select("file_path", F.col("name").alias("child"), F.col("id").alias("from_id"))
    rows = _first_named(heritage.join(child, ["file_path", "child"]), kinds, "parent")
    rows = rows.groupBy("from_id", "parent", "type").agg(_nearest("line").alias("best")).select("from_id", "parent", "type", "best.to_id", "best.line")
    known = F.col("to_id").isNotNull()
    target = F.coalesce("to_id", F.concat(F.lit(EXTERNAL), F.col("parent")))
    return rows.select("from_id", target.alias("to_id"), "type", F.when(known, 0.95).otherwise(0.7).alias("confidence"), F.when(known, "heritage").otherwise("heritage-external").alias("reason"), F.col("line").cast("int").alias("line"))


def type_links(bindings: DataFrame, symbols: DataFrame) -> DataFrame:
    """Links of annotations (file_path, scope_id, type_name, line, kind) to the type of that name, same file first."""
    rows = _first_named(bindings, symbols.filter("kind in ('class', 'interface', 'type', 'enum', 'struct')"), "type_name").filter("anywhere is not null")
    rows = rows.groupBy("scope_id", "type_name", "kind").agg(_nearest("line").alias("best")).select("scope_id", "kind", "best.to_id", "best.line")
    return _link(rows, "scope_id", "to_id", "references", 0.7, F.col("kind"))


def propagate_types(bindings: DataFrame, assignments: DataFrame, results: DataFrame, returns: DataFrame) -> DataFrame:
    """bindings (file_path, name, type_name) and those that one assignment (file_path, name, source) or a call's result (file_path, name, callee) with a known return type (callee, type_name) adds; the first binding of a variable stays."""
    a = assignments.join(bindings.select("file_path", F.col("name").alias("source"), "type_name"), ["file_path", "source"]).select("file_path", "name", "type_name", F.lit(1).alias("o"))
    c = results.join(returns.groupBy("callee").agg(F.min("type_name").alias("type_name")), "callee").select("file_path", "name", "type_name", F.lit(2).alias("o"))
    every = bindings.select("file_path", "name", "type_name", F.lit(0).alias("o")).unionByName(a).unionByName(c)
    return every.groupBy("file_path", "name").agg(F.min_by("type_name", F.struct("o", "type_name")).alias("type_name"))


def reexport_links(reexports: DataFrame, symbols: DataFrame) -> DataFrame:
    """Links of re-exports (file, name or *, source, line)."""
    e = symbols.filter("exported").select(F.col("file_path").alias("source"), F.col("name").alias("export"), F.col("id").alias("to_id"))
    rows = reexports.join(e, "source").filter((F.col("name") == "*") | (F.col("name") == F.col("export"))).withColumn("from_id", module_of("file"))
    wild = F.col("name") == "*"
    return _link(rows, "from_id", "to_id", "imports", F.when(wild, 0.6).otherwise(0.85), F.when(wild, "reexport-wildcard").otherwise("reexport-named"))


def contains_links(symbols: DataFrame) -> DataFrame:
    rows = symbols.filter("parent_id is not null").withColumn("line", F.col("start_line"))
    return _link(rows, "parent_id", "id", "contains", 1.0, "contains")


def dedupe(links: DataFrame) -> DataFrame:
    """One row per (from_id, to_id, type): the best confidence and its reason, distinct lines in order, and how many links they were (n)."""
    return links.groupBy("from_id", "to_id", "type").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"), F.min_by("reason", F.struct(-F.col("confidence"), "line", "reason")).alias("reason"), F.array_sort(F.collect_set("line")).alias("lines"))


def c3(parents: dict[str, list[str]], name: str) -> list[str] | None:
    """The C3 linearisation of name, or None if there is none."""
    def merge(lists: list[list[str]]) -> list[str] | None:
        out: list[str] = []
        lists = [x for x in lists if x]
        while lists:
            head = next((x[0] for x in lists if not any(x[0] in y[1:] for y in lists)), None)
            if head is None:
                return None
            out.append(head)
            lists = [y for y in ([z for z in x if z != head] for x in lists) if y]
        return out

    done: dict[str, list[str] | None] = {}

    def line(n: str, above: tuple[str, ...]) -> list[str] | None:
        if n in above:
            return None
        if n not in done:
            lines = [line(p, (*above, n)) for p in parents.get(n, [])]
            rest = None if any(x is None for x in lines) else merge([*lines, list(parents.get(n, []))])
            done[n] = None if rest is None else [n, *rest]
        return done[n]

    return line(name, ())


def first_wins(parents: dict[str, list[str]], name: str) -> list[str]:
    """name and all above it, depth first, each where it is first met."""
    seen, todo = {}, [name]
    while todo:
        at = todo.pop()
        if at not in seen:
            seen[at] = None
            todo += reversed(parents.get(at, []))
    return list(seen)


def order_of(name: str, children: list[str], parents: list[str], rule: str | None) -> list[str] | None:
    """The order of one class by a rule; children and parents are the edges above it by position."""
    table: dict[str, list[str]] = {}
    for child, parent in zip(children, parents, strict=True):
        table.setdefault(child, []).append(parent)
    if rule == "none":
        return [name]
    if rule == "first":
        return first_wins(table, name)
    order = c3(table, name)
    return [order[0], *reversed(order[1:])] if order and rule == "mixin" else order


#: Rules by which languages order a class's ancestors: C3; C3 from the far end (what is mixed in later counts first); depth first; none but the class itself.
RULES = ("c3", "mixin", "first", "none")
LANGUAGE_RULES = {"python": "c3", "ruby": "mixin", "rust": "none"}


def method_orders(heritage: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(class, order): the method resolution order of every class in heritage (class, parent, position), null where there is none.

    rules (class, rule): one of RULES for a class, c3 if not named. A cycle or an inconsistent order has no C3 order; depth first
    takes either. Each class meets its own ancestors only: their closure is a walk that ends when a level adds nothing, and a
    class's ancestor edges are one row; many rows go to Python at once. Without heritage there are no rows.
    """
    edges = cut(heritage.select("class", "parent", "position").distinct())
    up = edges.select(F.col("class").alias("a"), F.col("parent").alias("next")).filter("next is not null").distinct()
    every = edges.select(F.col("class").alias("c")).unionAll(edges.select("parent")).filter("c is not null").distinct()
    closure = frontier = cut(every.select("c", F.col("c").alias("a")))
    while not frontier.isEmpty():
        frontier = cut(frontier.join(up, "a").select("c", F.col("next").alias("a")).distinct().join(closure, ["c", "a"], "left_anti"))
        closure = closure.unionAll(frontier)
    at = F.struct(F.col("position").isNull(), "position", "class", "parent")
    own = closure.join(edges, F.col("a") == F.col("class"), "left").groupBy("c").agg(F.array_sort(F.collect_list(F.when(F.col("parent").isNotNull(), at))).alias("up"))
    own = own.join(rules.groupBy(F.col("class").alias("c")).agg(F.min("rule").alias("rule")), "c", "left") if rules is not None else own.withColumn("rule", F.lit("c3"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            orders = [order_of(*row) for row in zip(*[batch.column(k).to_pylist() for k in ("c", "children", "parents", "rule")], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("c"), pa.array([o and ">".join(o) for o in orders], pa.string())], ["class", "order"])

    return own.select("c", F.col("up.class").alias("children"), F.col("up.parent").alias("parents"), "rule").mapInArrow(run, "class string, order string")
