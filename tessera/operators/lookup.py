"""Joins that answer questions about symbols: dead code, tests, spans, reviews, gates and risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import paths
from tessera.operators import spans, traverse
from tessera.operators.enrich import enrich, half_up


def _ends(symbols: DataFrame, end: str, *columns: str) -> DataFrame:
    return symbols.select(F.col("id").alias(f"{end}_id"), *[F.col(c).alias(f"{end}_{c}") for c in columns])


def component_roots(links: DataFrame, symbols: DataFrame) -> DataFrame:
    """Classes of .vue files whose module is imported by somebody; they count as used."""
    imported = links.filter("type = 'imports'").select(F.col("to_id").alias("id"))
    modules = symbols.filter("kind = 'module' and name = '_top'").join(imported, "id", "left_semi").select("file_path")
    return symbols.filter("kind = 'class' and file_path like '%.vue'").join(modules, "file_path", "left_semi")


def dead_code(links: DataFrame, symbols: DataFrame, kind: str | None = None) -> DataFrame:
    """Exported symbols that nothing but containment refers to, without framework entries and component roots."""
    used = links.filter("type <> 'contains'").select(F.col("to_id").alias("id"))
    rows = symbols.filter("exported and kind <> 'section'")
    rows = rows.filter(F.col("kind") == kind) if kind else rows
    rows = rows.filter(~paths.is_framework_entry(F.col("file_path"), F.col("name"))).join(used, "id", "left_anti").join(component_roots(links, symbols).select("id"), "id", "left_anti")
    return rows.select("id", "name", "kind", "file_path", "start_line")


def tested_by_like(links: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id): whatever a symbol in a test folder or test file refers to, containment included."""
    tests = symbols.filter(paths.any_like(F.col("file_path"), paths.TEST_LIKE)).select(F.col("id").alias("from_id"))
    return links.join(tests, "from_id", "left_semi").select(F.col("to_id").alias("id")).distinct()


def coverage_gaps(links: DataFrame, symbols: DataFrame) -> DataFrame:
    """Exported symbols with some heat that no test refers to."""
    return enrich(symbols, links).filter("exported and heat > 0").join(tested_by_like(links, symbols), "id", "left_anti")


def test_only(links: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id): exported symbols that are referred to, and only from test files; an unknown source counts as production."""
    seen = links.filter("type <> 'contains'").join(_ends(symbols, "from", "file_path"), "from_id", "left")
    only = seen.groupBy(F.col("to_id").alias("id")).agg(F.bool_and(F.coalesce(paths.is_test_file_stored(F.col("from_file_path")), F.lit(False))).alias("only")).filter("only")
    rows = symbols.filter("exported and kind <> 'section'").filter(~paths.is_framework_entry(F.col("file_path"), F.col("name")))
    return rows.join(only, "id", "left_semi")


def test_impact(links: DataFrame, symbols: DataFrame, changed: DataFrame) -> DataFrame:
    """(file_path): test files that reach changed (id) directly by any link, or by up to five links of use."""
    direct = links.join(changed.select(F.col("id").alias("to_id")), "to_id", "left_semi").select(F.col("from_id").alias("id"))
    far = traverse.walk(links, changed, ("calls", "imports", "extends", "implements"), 5).select("id")
    hit = symbols.filter(paths.any_like(F.col("file_path"), paths.IMPACT_LIKE))
    return hit.join(direct.unionAll(far), "id", "left_semi").select("file_path").distinct()


def cross_file_impact(links: DataFrame, symbols: DataFrame, changed: DataFrame) -> DataFrame:
    """(id, file_path, depth): what up to two links lead from to changed, without changed itself, tests and fixtures."""
    found = traverse.walk(links, changed, traverse.IMPACT, 2).select("id", "depth").distinct().join(changed, "id", "left_anti")
    return found.join(symbols.select("id", "file_path"), "id").filter(~paths.is_fixture_or_test(F.col("file_path")))


def indirect_coverage(symbols: DataFrame, tested: DataFrame, depth: int = 5) -> DataFrame:
    """symbols with tested: whether they or, as long as they are not exported, their parents are."""
    marks = tested.select("id").distinct().withColumn("mark", F.lit(True))
    parents = symbols.select(F.col("id").alias("node"), F.col("parent_id").alias("up"), F.col("exported").alias("open"))
    chain = symbols.select("id", F.col("id").alias("node"))
    levels = chain
    for _ in range(depth):
        chain = chain.join(parents, "node").filter("up is not null and not open").select("id", F.col("up").alias("node"))
        levels = levels.unionAll(chain)
    hit = levels.join(marks.withColumnRenamed("id", "node"), "node", "left_semi").select("id").distinct().withColumn("tested", F.lit(True))
    return symbols.join(hit, "id", "left").fillna(False, ["tested"])


def domain_stats(files: DataFrame, counted: DataFrame) -> DataFrame:
    """(zone, files, symbols): distinct files of a zone, and how many of its rows have their id in counted; zones without any stay."""
    marks = counted.select("id").withColumn("mark", F.lit(1))
    return files.join(marks, "id", "left").groupBy("zone").agg(F.count_distinct("file_path").alias("files"), F.count("mark").alias("symbols"))


def resolution_diff(legacy: DataFrame, scoped: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """(from_id, to_id, type, side): links that one side alone has, or whose confidences differ by more than tolerance."""
    key = ["from_id", "to_id", "type"]
    both = legacy.select(*key, F.col("confidence").alias("a")).join(scoped.select(*key, F.col("confidence").alias("b")), key, "full_outer")
    side = F.when(F.col("b").isNull(), "legacy").when(F.col("a").isNull(), "scoped").otherwise("changed")
    return both.filter(F.col("a").isNull() | F.col("b").isNull() | (F.abs(F.col("a") - F.col("b")) > tolerance)).select(*key, side.alias("side"))


def parity(legacy: DataFrame, scoped: DataFrame, least: float = 0.99) -> DataFrame:
    """One row: the share of legacy links without a difference, and whether it is enough."""
    counts = resolution_diff(legacy, scoped).agg(F.count("*").alias("differ")).crossJoin(legacy.agg(F.count("*").alias("n")))  # one row each
    rate = 1.0 - F.col("differ") / F.greatest(F.col("n"), F.lit(1))
    return counts.select(F.round(rate, 6).alias("rate"), (rate >= least).alias("reached"))


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    gone, fresh = old.join(new, "id", "left_anti"), new.join(old, "id", "left_anti")
    return gone.select(F.lit("gone").alias("change"), "id").unionAll(fresh.select(F.lit("new").alias("change"), "id"))


def dependent_files(links: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, dependents): distinct files that refer to a symbol."""
    return links.filter("type <> 'contains'").join(_ends(symbols, "from", "file_path"), "from_id").groupBy(F.col("to_id").alias("id")).agg(F.count_distinct("from_file_path").alias("dependents"))


def risk_inputs(links: DataFrame, symbols: DataFrame) -> DataFrame:
    """Enriched symbols with dependents and tested (by any link from a test file)."""
    tests = symbols.filter(paths.is_test_file(F.col("file_path"))).select(F.col("id").alias("from_id"))
    tested = links.join(tests, "from_id", "left_semi").select(F.col("to_id").alias("id")).distinct().withColumn("tested", F.lit(True))
    return enrich(symbols, links).join(dependent_files(links, symbols), "id", "left").join(tested, "id", "left").fillna(0, ["dependents"]).fillna(False, ["tested"])


def risk_score() -> Column:
    """From heat, dependents, role, tested and exported. Internal symbols count less, and nothing without dependents."""
    exported, dependents = F.col("exported"), F.col("dependents")
    base = F.least(F.col("heat") * 0.3, F.lit(15.0)) + dependents * 3 + F.when(F.col("role") == "hub", 10).when(F.col("role") == "entrypoint", 5).otherwise(0)
    base = base * F.when(~F.col("tested") & exported, 1.5).otherwise(1.0) + F.when(exported & (dependents > 0), 3).otherwise(0)
    return F.when(~exported & (dependents == 0), F.lit(0).cast("long")).when(~exported & (dependents <= 1), half_up(base * 0.4)).when(~exported & (dependents <= 3), half_up(base * 0.65)).otherwise(half_up(base))


def risk_level() -> Column:
    untested = ~F.col("tested")
    return F.when(((F.col("role") == "hub") & untested & (F.col("dependents") > 10)) | (F.col("score") >= 50), "CRITICAL").when(F.col("score") >= 30, "HIGH").when((F.col("score") >= 10) | untested, "MEDIUM").otherwise("LOW")


def risk(links: DataFrame, symbols: DataFrame) -> DataFrame:
    return risk_inputs(links, symbols).withColumn("score", risk_score()).withColumn("level", risk_level())


def review_symbol(rows: DataFrame) -> DataFrame:
    """Another score, of 100, for a single symbol under review."""
    score = half_up(0.4 * F.col("heat") + 35 * F.least(F.col("dependents") / 10.0, F.lit(1.0)) + F.when(F.col("tested"), 0).otherwise(25))
    return rows.withColumn("score", score).withColumn("level", F.when(F.col("score") > 75, "CRITICAL").when(F.col("score") > 50, "HIGH").when(F.col("score") > 25, "MEDIUM").otherwise("LOW"))


def edit_gates(links: DataFrame, symbols: DataFrame, most: int = 5) -> DataFrame:
    """(id, impact_blocked, guard_blocked): more than most dependent files, or dependent files that are not tests."""
    seen = links.filter("type <> 'contains'").join(_ends(symbols, "from", "file_path"), "from_id").select(F.col("to_id").alias("id"), F.col("from_file_path").alias("f"))
    n = seen.groupBy("id").agg(F.count_distinct("f").alias("strict"), F.count_distinct(F.when(~paths.is_test_file(F.col("f")), F.col("f"))).alias("guard"))
    return symbols.select("id").join(n, "id", "left").fillna(0).select("id", (F.col("strict") > most).alias("impact_blocked"), (F.col("guard") > most).alias("guard_blocked"))


def review(links: DataFrame, symbols: DataFrame, hunks: DataFrame) -> DataFrame:
    return risk(links, symbols).join(spans.changed_symbols(hunks, symbols).select("id"), "id", "left_semi")


def review_rollup(reviewed: DataFrame) -> DataFrame:
    hub = F.coalesce(F.bool_or((F.col("role") == "hub") & ~F.col("tested") & (F.col("dependents") > 10)), F.lit(False))
    return reviewed.agg(F.sum("score").alias("total"), F.count_if(F.col("level").isin("HIGH", "CRITICAL")).alias("hotspots"), F.count_if(~F.col("tested")).alias("untested"), hub.alias("critical_hub"))


def test_doubles(links: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, kind, dependency, double_kind): a spy for code of the same file, a stub for imports, a mock for the rest."""
    wide = links.filter("type <> 'contains'").join(_ends(symbols, "from", "file_path", "kind"), "from_id").join(_ends(symbols, "to", "file_path", "kind"), "to_id")
    double = F.when((F.col("from_file_path") == F.col("to_file_path")) & ~F.col("to_kind").isin("interface", "type", "enum"), "spy").when(F.col("type") == "imports", "stub").otherwise("mock")
    return wide.select(F.col("from_id").alias("id"), F.col("from_kind").alias("kind"), F.col("to_id").alias("dependency"), double.alias("double_kind"))


def overview(links: DataFrame, symbols: DataFrame, target: str) -> DataFrame:
    """(part, n): how many symbols reach target, how many it contains, how many files depend on it."""
    spark = links.sparkSession
    start = spark.createDataFrame([(target,)], "id string")
    part = lambda name, df, n: df.agg(n.alias("n")).select(F.lit(name).alias("part"), "n")
    callers = part("callers", traverse.walk(links, start, traverse.IMPACT, 3), F.count_distinct("id"))
    members = part("members", links.filter((F.col("from_id") == target) & (F.col("type") == "contains")), F.count("*"))
    dependents = part("dependents", dependent_files(links, symbols).filter(F.col("id") == target), F.coalesce(F.max("dependents"), F.lit(0)))
    return callers.unionAll(members).unionAll(dependents)
