"""Metrics of symbols from their links: fan-in and fan-out, role, heat, importance, coverage, domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.paths import directory_segment, is_test_file
from tessera.operators.components import connected_components
from tessera.plans.cut import cut

RUNTIME = ("calls", "imports", "extends", "implements")
DATATYPES, CALLABLE, CONTAINERS = ("interface", "type", "enum", "struct"), ("function", "class", "method"), ("class", "struct", "trait")
# Folder names too general for a domain, and the limits of a domain.
GENERIC_FOLDERS = ("hooks", "utils", "components", "services", "types", "dto", "models", "controllers", "gateways", "routes", "helpers", "constants")
HUB_DEGREE, MOST_FILES, MOST_SHARE = 8, 40, 0.15


def with_files(links: DataFrame, symbols: DataFrame) -> DataFrame:
    """links that are not containment, with from_file (null for an unknown source)."""
    files = symbols.select(F.col("id").alias("from_id"), F.col("file_path").alias("from_file"))
    return links.filter("type <> 'contains'").join(files, "from_id", "left")


def fans(links: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, fan_in) and (id, fan_out). Links from one file to one target count once, for the first source; links from unknown sources count each."""
    return _fans(with_files(links, symbols))


def _fans(seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    once = seen.filter("from_file is not null").groupBy("from_file", "to_id").agg(F.min("from_id").alias("from_id")).select("from_id", "to_id")
    all_ = once.unionAll(seen.filter("from_file is null").select("from_id", "to_id"))
    return all_.groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("fan_in")), all_.groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("fan_out"))


def caller_files(links: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, runtime_files, type_files, test_files): distinct files that refer to a symbol, by the kind of reference."""
    return _caller_files(with_files(links, symbols))


def _caller_files(seen: DataFrame) -> DataFrame:
    seen = seen.filter("from_file is not null")
    runtime, test = F.col("type").isin(*RUNTIME), is_test_file(F.col("from_file"))
    count = lambda c: F.count_distinct(F.when(c, F.col("from_file")))
    return seen.groupBy(F.col("to_id").alias("id")).agg(count(runtime & ~test).alias("runtime_files"), count(F.col("type") == "references").alias("type_files"), count(runtime & test).alias("test_files"))


def role() -> Column:
    """From kind, exported, fan_in and fan_out; the first rule that holds."""
    out, into, exported = F.col("fan_out"), F.col("fan_in"), F.col("exported")
    return (
        F.when(F.col("kind").isin(*DATATYPES), "datatype")
        .when(exported & (into == 0) & (out > 0), "entrypoint")
        .when((into >= 3) & (out >= 3), "hub")
        .when((into > 0) & (out == 0), "leaf")
        .when(exported & into.between(1, 2), "utility")
        .otherwise(F.when(exported, "utility").otherwise("leaf"))
    )


def heat() -> Column:
    kind = F.col("kind").isin(*CALLABLE)
    return F.least(F.least(15 * F.col("fan_in"), F.lit(50)) + F.least(5 * F.col("fan_out"), F.lit(25)) + F.when(F.col("exported"), 10).otherwise(0) + F.when(kind, 5).otherwise(0), F.lit(100)).cast("long")


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def importance() -> Column:
    flag = lambda c, n: F.when(c, n).otherwise(0)
    log = lambda c: F.log2(F.col(c) + F.lit(1.0))
    return half_up(
        F.least(
            F.least(18 * log("runtime_files"), F.lit(55.0)) + F.least(4 * log("type_files"), F.lit(12.0)) + flag(F.col("exported"), 12) + flag(F.col("kind").isin(*CALLABLE), 6) + flag(F.col("test_files") > 0, 8) + flag(F.col("role") == "entrypoint", 7),
            F.lit(100.0),
        )
    )


def enrich(symbols: DataFrame, links: DataFrame) -> DataFrame:
    """symbols with fan_in, fan_out, runtime_files, type_files, test_files, role, heat and importance. Links meet their files once; the join is kept in the shared checkpoint folder for the three sums over it."""
    seen = cut(with_files(links, symbols))
    into, out = _fans(seen)
    wide = symbols.join(into, "id", "left").join(out, "id", "left").join(_caller_files(seen), "id", "left")
    wide = wide.fillna(0, ["fan_in", "fan_out", "runtime_files", "type_files", "test_files"])
    return wide.withColumn("role", role()).withColumn("heat", heat()).withColumn("importance", importance())


def coverage(symbols: DataFrame, links: DataFrame) -> DataFrame:
    """One row: test_files, tested (production symbols that test files refer to) and exported production symbols, and their percentage."""
    test = symbols.withColumn("test", is_test_file(F.col("file_path"))).select("id", "file_path", "exported", "test")
    tests = test.filter("test").select(F.col("id").alias("from_id"))
    tested = links.filter("type <> 'contains'").join(tests, "from_id", "left_semi").join(tests.withColumnRenamed("from_id", "to_id"), "to_id", "left_anti").agg(F.count_distinct("to_id").alias("tested"))
    counts = test.agg(F.count_distinct(F.when(F.col("test"), F.col("file_path"))).alias("test_files"), F.count_if(F.col("exported") & ~F.col("test")).alias("exported"))
    pct = F.when(F.col("exported") > 0, half_up(100.0 * F.col("tested") / F.col("exported"))).otherwise(F.lit(0).cast("long"))
    return counts.crossJoin(tested).withColumn("coverage_pct", pct)  # one row each


def file_edges(symbols: DataFrame, links: DataFrame) -> DataFrame:
    """(file_a, file_b, weight): links between two files, in either direction."""
    files = lambda end: symbols.select(F.col("id").alias(f"{end}_id"), F.col("file_path").alias(f"{end}_file"))
    both = links.filter("type <> 'contains'").join(files("from"), "from_id").join(files("to"), "to_id").filter("from_file <> to_file")
    return both.groupBy(F.least("from_file", "to_file").alias("file_a"), F.greatest("from_file", "to_file").alias("file_b")).agg(F.count("*").alias("weight"))


def strong_degrees(edges: DataFrame, least: int = 2) -> DataFrame:
    strong = edges.filter(F.col("weight") >= least)
    return strong.select(F.col("file_a").alias("file")).unionAll(strong.select("file_b")).groupBy("file").agg(F.count("*").alias("degree"))


def file_clusters(symbols: DataFrame, links: DataFrame) -> DataFrame:
    """(file, cluster): files joined by at least two links; files with many such neighbours join nobody. cluster: the first file by name."""
    edges = cut(file_edges(symbols, links).filter("weight >= 2"))
    hubs = strong_degrees(edges).filter(F.col("degree") > HUB_DEGREE)
    joined = edges.filter("weight >= 2").join(hubs.select(F.col("file").alias("file_a")), "file_a", "left_anti").join(hubs.select(F.col("file").alias("file_b")), "file_b", "left_anti")
    found = connected_components(joined.select(F.col("file_a").alias("u"), F.col("file_b").alias("v")))
    files = symbols.select(F.col("file_path").alias("file")).distinct()
    return files.join(found.withColumnRenamed("node", "file"), "file", "left").select("file", F.coalesce("component", "file").alias("cluster"))


def domains(clusters: DataFrame) -> DataFrame:
    """(file, domain): the commonest folder of each cluster, ties by name, with its parent where the folder's name is general; files of an outsized cluster are named each by its own folder."""
    total = clusters.agg(F.count("*").alias("n_files"))
    parts = F.split("file", "/")
    named = clusters.withColumn("leaf", directory_segment(F.col("file"))).withColumn("parent", F.when(F.size(parts) >= 3, F.try_element_at(parts, F.lit(-3))))
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("size")).crossJoin(total)  # total is one row
    outsized = F.col("size") > F.greatest(F.lit(MOST_FILES), F.floor(MOST_SHARE * F.col("n_files")))
    top = lambda *by: F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), *by))
    leaf = named.groupBy("cluster", "leaf").agg(F.count("*").alias("n")).withColumn("r", top("leaf")).filter("r = 1").select("cluster", F.col("leaf").alias("best"))
    parent = named.join(leaf, "cluster").filter("leaf = best and parent is not null").groupBy("cluster", "parent").agg(F.count("*").alias("n")).withColumn("r", top("parent")).filter("r = 1").select("cluster", F.col("parent").alias("best_parent"))
    general = lambda c: F.col(c).isin(*GENERIC_FOLDERS)
    out = named.join(sizes, "cluster").join(leaf, "cluster").join(parent, "cluster", "left")
    own = F.when(general("leaf") & F.col("parent").isNotNull(), F.concat_ws("/", "parent", "leaf")).otherwise(F.col("leaf"))
    shared = F.when(general("best") & (F.col("size") > 1) & F.col("best_parent").isNotNull(), F.concat_ws("/", "best_parent", "best")).otherwise(F.col("best"))
    return out.select("file", F.when(outsized, own).otherwise(shared).alias("domain"))
