"""What must not grow faster than its input: rows that plans make, sides that are broadcast, groups that go to Python one by one."""

from pyspark.sql import functions as F

from tessera.catalog import QUERIES
from tessera.operators import bracefacts, extract, index, modules, resolve, textsearch
from tessera.streaming import flows


def nodes(plan):
    """The nodes of a physical plan that has run, through adaptive parts and stages."""
    yield plan
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        yield from nodes(plan.executedPlan())
    elif kind.endswith("QueryStageExec"):
        yield from nodes(plan.plan())
    else:
        children = plan.children()
        for i in range(children.size()):
            yield from nodes(children.apply(i))


def run(df):
    """The rows of df and the nodes of its plan."""
    rows = df.collect()
    return rows, list(nodes(df._jdf.queryExecution().executedPlan()))


def most_rows(plan) -> int:
    return max(n.metrics().apply("numOutputRows").value() for n in plan if n.metrics().contains("numOutputRows"))


def test_types_of_one_name_are_not_paired(spark):
    n = 2000
    types = spark.range(n).select(F.format_string("p%05d", "id").alias("id"), F.lit("T").alias("name"), F.lit("class").alias("kind"), F.format_string("f%d", F.col("id") % 50 + 1).alias("file_path"))
    bindings = spark.range(n).select(F.format_string("f%d", F.col("id") % 100).alias("file_path"), F.format_string("o%d", "id").alias("scope_id"), F.lit("T").alias("type_name"), F.lit(1).alias("line"), F.lit("type-annotation").alias("kind"))
    rows, plan = run(resolve.type_links(bindings, types))
    got = {r.from_id: r.to_id for r in rows}
    assert len(rows) == n and got["o1"] == "p00000" and got["o7"] == "p00006" and got["o50"] == "p00049" and got["o60"] == "p00000"
    assert most_rows(plan) <= 2 * n
    children = types.select("file_path", F.concat("id", F.lit("x")).alias("child"), F.lit("T").alias("parent"), F.lit("extends").alias("type"), F.lit(1).alias("line"))
    both = types.unionByName(types.select(F.concat("id", F.lit("x")).alias("id"), F.concat("id", F.lit("x")).alias("name"), "kind", "file_path"))
    rows, plan = run(resolve.heritage_links(children, both))
    assert {(r.from_id, r.to_id) for r in rows if r.from_id in ("p00007x", "p00050x")} == {("p00007x", "p00007"), ("p00050x", "p00000")}
    assert len(rows) == n and most_rows(plan) <= 4 * n


def test_method_orders_go_to_python_in_batches(spark):
    tower = [e for i in range(25) for e in ((f"a{i}", f"l{i}", 0), (f"a{i}", f"r{i}", 1), (f"l{i}", f"a{i + 1}", 0), (f"r{i}", f"a{i + 1}", 0))]
    orders = resolve.method_orders(spark.createDataFrame(tower, "class string, parent string, position int"))
    got, plan = run(orders)
    assert {r["class"]: r["order"] for r in got}["a0"] == ">".join([x for i in range(25) for x in (f"a{i}", f"l{i}", f"r{i}")] + ["a25"])
    assert not any("InPandas" in n.nodeName() for n in plan)


def test_module_names_are_not_broadcast(spark):
    files = spark.range(200).select(F.format_string("src/m%d.ts", "id").alias("path"))
    imports = spark.range(200).select(F.format_string("test/u%d.ts", "id").alias("file_path"), F.format_string("@/m%d", "id").alias("module_path"))
    rows, plan = run(modules.resolve_modules(imports, files, spark.createDataFrame([("typescript", "@/", "src")], "lang string, prefix string, folder string")))
    assert {r.target for r in rows} == {f"src/m{i}.ts" for i in range(200)}
    assert sum(n.nodeName() == "BroadcastExchange" for n in plan) <= 1, "only the roots, which a count shows to be few"


def test_heavy_rows_are_spread(spark):
    files = spark.range(0, 100, 1, 1)
    for facts, ending, text in ((extract.python_facts, "py", "class A:\n    pass\n"), (extract.component_facts, "vue", "<script></script>")):
        found = facts(files.select(F.concat("id", F.lit("." + ending)).alias("path"), F.lit(text).alias("text")))
        assert found.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism and found.count() >= 100


def test_a_table_of_part_files_is_listed_once(spark, tmp_path):
    spark.range(10).repartition(3).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(10).toPandas().to_parquet(f"{tmp_path}/part.parquet")
    assert sorted(r.path for r in QUERIES["s01_scan_files"](spark, str(tmp_path)).collect()) == ["orders.parquet", "part.parquet"]


CALL = "call_id long, file_path string, scope_id string, name string, receiver string, line int, argument boolean"
SYMBOL = "id string, name string, kind string, file_path string, exported boolean, parent_id string, start_line int"


def test_calls_alike_are_one_question(spark):
    n = 2000
    calls = spark.range(n).select(F.col("id").alias("call_id"), F.lit("a.ts").alias("file_path"), F.format_string("o%d", "id").alias("scope_id"), F.lit("m").alias("name"), F.when(F.col("id") % 2 == 0, "v").alias("receiver"), F.lit(1).alias("line"), F.lit(False).alias("argument"))
    symbols = spark.createDataFrame([("m1", "m", "method", "a.ts", False, "T", 1), ("m2", "m", "method", "b.ts", False, "U", 1), ("T", "Tea", "class", "a.ts", True, None, 1), ("U", "Use", "class", "b.ts", True, None, 1)], SYMBOL)
    imports = spark.createDataFrame([], "file_path string, target string, name string, alias string, kind string, line int")
    bindings = spark.createDataFrame([("a.ts", "v", "Use", None), ("a.ts", "v", "Tea", "o4")], "file_path string, name string, type_name string, scope_id string")
    locals_ = spark.createDataFrame([("o1", "m")], "scope_id string, name string")
    rows, plan = run(resolve.call_links(calls, symbols, imports, locals_, bindings))
    got = {r.from_id: (r.to_id, r.confidence) for r in rows}
    assert len(rows) == n and got["o2"] == ("m2", 0.93) and got["o4"] == ("m1", 0.93) and got["o1"] == got["o3"] == ("m1", 0.9)
    wide = [p for p in plan if "Join" in p.nodeName() and p.metrics().contains("numOutputRows") and p.metrics().apply("numOutputRows").value() >= n // 2]
    assert len(wide) <= 3, "calls meet their answers and their scopes' locals, not the symbols"


def test_a_name_passed_on_is_looked_for_nearby(spark):
    calls = spark.createDataFrame([(1, "a.ts", "f", "solo", None, 1, True), (2, "a.ts", "f", "solo", None, 2, False)], CALL)
    symbols = spark.createDataFrame([("s", "solo", "function", "x/z.ts", False, None, 1)], SYMBOL)
    imports = spark.createDataFrame([("a.ts", "x/z.ts", "*", None, "wildcard", 1)], "file_path string, target string, name string, alias string, kind string, line int")
    none = spark.createDataFrame([], "file_path string, name string, type_name string, scope_id string")
    got = {(r.line, r.to_id, r.confidence) for r in resolve.call_links(calls, symbols, imports, none.select("scope_id", "name"), none).collect()}
    assert got == {(1, "s", 0.85), (2, "s", 0.9)}


def test_links_are_counted_as_they_are_deduped(spark):
    links = spark.createDataFrame([("a", "b", "calls", 0.5, "x", 1), ("a", "b", "calls", 0.9, "y", 2), ("a", "c", "calls", 0.5, "x", 3)], "from_id string, to_id string, type string, confidence double, reason string, line int")
    assert {(r.to_id, r.n, r.confidence, r.reason) for r in resolve.dedupe(links).collect()} == {("b", 2, 0.9, "y"), ("c", 1, 0.5, "x")}


def test_runs_work_out_what_is_asked_for(spark, monkeypatch):
    symbols = spark.createDataFrame([("a", "x.ts"), ("b", "y.ts")], "id string, file_path string")
    links = spark.createDataFrame([("a", "b", "calls"), ("b", "a", "calls")], "from_id string, to_id string, type string")
    files = spark.createDataFrame([("x.ts", "2"), ("y.ts", "1")], "path string, hash string")
    hashes = spark.createDataFrame([("x.ts", "1"), ("y.ts", "1")], "path string, hash string")
    unread = links.withColumn("to_id", F.raise_error(F.lit("links were read")).cast("string"))
    run_ = index.update(symbols, unread, symbols, unread, files, hashes)
    assert run_.writes_meta and not run_.rebuilds_search and run_.symbols.count() == 2
    monkeypatch.setattr(index.enrich, "enrich", lambda *a: 1 / 0)
    assert index.update(symbols, links, symbols, links, files, hashes).links.count() == 2


def test_terms_are_counted_where_texts_lie(spark):
    docs = spark.createDataFrame([(1, "aa bb aa Bb aa c"), (2, None), (3, ""), (4, "dd")], "id long, text string")
    rows, plan = run(textsearch.term_frequencies(docs))
    assert {(r.id, r.term, r.tf) for r in rows} == {(1, "aa", 3), (1, "bb", 2), (4, "dd", 1)}
    assert not any(n.nodeName() == "Exchange" for n in plan)
    twice = textsearch.term_frequencies(docs.unionAll(spark.createDataFrame([(1, "aa zz"), (None, "q1"), (None, "q1 q1")], docs.schema)))
    assert {(r.id, r.term, r.tf) for r in twice.collect()} == {(1, "aa", 4), (1, "bb", 2), (1, "zz", 1), (4, "dd", 1), (None, "q1", 3)}


def test_vectors_shuffle_no_terms_that_are_common(spark):
    docs = spark.range(300).select("id", F.concat_ws(" ", F.lit("alpha beta alpha"), F.format_string("w%d x%d", F.col("id") % 40, "id")).alias("text"))
    want, plan = run(textsearch.tfidf(docs))
    assert "term" not in " ".join(n.toString().split("\n")[0] for n in plan if n.nodeName() == "Exchange")
    # more terms than are broadcast: the rare ones are joined
    got = textsearch.tfidf(docs, most_terms=50).collect()
    key = lambda rows: sorted((r.id, r.bucket, r.weight) for r in rows)
    assert len(want) > 600 and [k[:2] for k in key(got)] == [k[:2] for k in key(want)] and all(abs(a[2] - b[2]) <= 2e-6 for a, b in zip(key(got), key(want), strict=True))


def test_imports_of_one_path_are_one_question(spark):
    n = 500
    imports = spark.range(n).select(F.concat(F.lit("src/a"), F.col("id") % 9, F.lit(".ts")).alias("file_path"), F.when(F.col("id") % 2 == 0, "./b").otherwise("react").alias("module_path"), "id")
    rows, plan = run(extract.resolve_imports(imports, spark.createDataFrame([("src/b.ts",), ("src/b.js",)], "path string")))
    assert len(rows) == n and all(r.target == ("src/b.ts" if r.id % 2 == 0 else None) for r in rows)
    assert sum(p.nodeName() == "Exchange" for p in plan) == 0, "answers are few and come to the imports"


def test_a_symbol_is_one_group_of_the_stream(spark, tmp_path):
    events = [(i, f"s{i % 3}", f"k{i % 5}", "v") for i in range(60)]
    rows = spark.createDataFrame(events, "id long, symbol string, key string, value string").withColumn("ts", F.timestamp_seconds("id"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = flows.annotate(stream).writeStream.format("memory").queryName("grouped").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination()
    assert spark.table("grouped").filter("event = 'created'").count() == 15 and spark.table("grouped").count() == 60
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 3


def test_facts_of_brace_languages_move_nothing_but_files(spark):
    files = spark.createDataFrame([(f"c{i}.ts", "import { a } from './b';\nfunction f() { go(); }\n") for i in range(50)], "path string, text string")
    rows, plan = run(bracefacts.brace_facts(files, ("import",), scopes=False))
    assert {(r.fact, r.name, r.parent) for r in rows} == {("import", "a", "./b")} and len(rows) == 50
    assert sum("Exchange" in n.nodeName() for n in plan) <= 1 and not any(w in n.nodeName() for n in plan for w in ("Window", "Join", "Sort"))
