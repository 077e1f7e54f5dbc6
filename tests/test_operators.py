"""Operators on small hand-made tables: cycles, ties, empty inputs, boundaries."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import paths
from tessera.operators import enrich, extract, lookup, memory, resolve, security, tables, textsearch, traverse
from tessera.operators.components import connected_components
from tessera.streaming import flows

LINK = "from_id string, to_id string, type string"


def symbols(spark, rows):
    return spark.createDataFrame(rows, "id string, name string, kind string, file_path string, start_line int, end_line int, exported boolean, parent_id string")


def symbol(id_, kind="function", file="src/a.ts", exported=True, parent=None, span=(1, 9)):
    return (id_, id_, kind, file, *span, exported, parent)


# --- components -------------------------------------------------------------------------------------------------------


def brute_components(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("kind", ["chain", "star", "random", "loops", "cliques"])
def test_components(spark, kind):
    rng = random.Random(1)
    edges = {
        "chain": [(i, i + 1) for i in range(200)],
        "star": [(1000, i) for i in range(300)] + [(1000, 2000)],
        "random": [(rng.randrange(500), rng.randrange(500)) for _ in range(350)],
        "loops": [(5, 5), (5, 5), (6, 7), (7, 6)],
        "cliques": [(10 * k + a, 10 * k + b) for k in range(5) for a, b in itertools.combinations(range(8), 2)],
    }[kind]
    rng.shuffle(edges)
    out = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.component for r in out} == brute_components(edges) and len(out) == len({r.node for r in out})


def test_components_of_nothing_and_nulls(spark):
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
    out = connected_components(spark.createDataFrame([(None, 1), (2, None), (3, 4)], "u long, v long")).collect()
    assert {(r.node, r.component) for r in out} == {(3, 3), (4, 3)}


# --- walks ------------------------------------------------------------------------------------------------------------

CYCLE = [("a", "b", "calls"), ("b", "c", "calls"), ("c", "a", "calls"), ("x", "a", "imports"), ("y", "a", "contains")]


def test_upstream_meets_a_cycle_again(spark):
    links = spark.createDataFrame(CYCLE, LINK)
    out = {tuple(r) for r in traverse.walk(links, spark.createDataFrame([("a",)], "id string"), traverse.IMPACT, 3).collect()}
    assert out == {("c", 1, "calls"), ("x", 1, "imports"), ("b", 2, "calls"), ("a", 3, "calls")}


def test_downstream_keeps_paths_simple(spark):
    links = spark.createDataFrame(CYCLE, LINK)
    out = {tuple(r) for r in traverse.simple_walk(links, spark.createDataFrame([("a",)], "id string"), traverse.IMPACT, 6).collect()}
    assert out == {("b", 1, "calls"), ("c", 2, "calls"), ("a", 3, "calls")}


def test_walk_from_nowhere(spark):
    links = spark.createDataFrame(CYCLE, LINK)
    assert traverse.walk(links, spark.createDataFrame([("none",)], "id string"), traverse.IMPACT, 5).count() == 0


def test_shortest_path(spark):
    links = spark.createDataFrame([("a", "b", "calls"), ("b", "d", "calls"), ("a", "c", "imports"), ("c", "d", "calls"), ("p", "a", "contains"), ("d", "e", "extends")], LINK)
    assert [tuple(r) for r in traverse.shortest_path(links, "a", "d").collect()] == [("a>b>d", 2)]
    assert [tuple(r) for r in traverse.shortest_path(links, "p", "e").collect()] == [("p>a>b>d>e", 4)]
    assert traverse.shortest_path(links, "e", "a").count() == 0


def test_entry_paths(spark):
    links = spark.createDataFrame([("m", "f", "calls"), ("n", "m", "calls"), ("k", "h", "contains"), ("h", "f", "calls"), ("f", "f", "calls")], LINK)
    s = symbols(spark, [symbol("f"), symbol("m", exported=False), symbol("n"), symbol("h", "method", exported=False), symbol("k", "class")])
    assert [r.path for r in traverse.entry_paths(links, s, "f").collect()] == ["h>f", "n>m>f"]


def test_similar(spark):
    links = spark.createDataFrame([("a", "x", "calls"), ("a", "y", "calls"), ("b", "x", "calls"), ("b", "y", "calls"), ("c", "x", "calls"), ("c", "z", "calls")], LINK)
    s = symbols(spark, [symbol(i) for i in "abcxyz"])
    assert [tuple(r) for r in traverse.similar(links, s, "a").collect()] == [("b", 1.0), ("c", 0.33)]


# --- metrics ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("kind", "exported", "into", "out", "role", "heat"),
    [
        ("interface", True, 9, 9, "datatype", 85), ("function", True, 0, 1, "entrypoint", 20), ("function", False, 3, 3, "hub", 65), ("function", True, 3, 3, "hub", 75), ("function", False, 1, 0, "leaf", 20),
        ("function", True, 2, 1, "utility", 50), ("function", True, 0, 0, "utility", 15), ("variable", False, 0, 0, "leaf", 0), ("class", True, 9, 9, "hub", 90),
    ],
)
def test_role_and_heat(spark, kind, exported, into, out, role, heat):
    row = spark.createDataFrame([(kind, exported, into, out)], "kind string, exported boolean, fan_in long, fan_out long").select(enrich.role().alias("r"), enrich.heat().alias("h")).first()
    assert (row.r, row.h) == (role, heat)


def test_fans_count_a_file_once(spark):
    s = symbols(spark, [symbol("t", file="src/t.ts"), symbol("a1", file="src/a.ts"), symbol("a2", file="src/a.ts"), symbol("b", file="src/b.ts")])
    links = spark.createDataFrame([("a1", "t", "calls"), ("a2", "t", "imports"), ("b", "t", "calls"), ("ghost", "t", "calls"), ("ghost", "t", "imports"), ("a1", "b", "contains")], LINK)
    into, out = enrich.fans(links, s)
    assert {tuple(r) for r in into.collect()} == {("t", 4)}
    assert {tuple(r) for r in out.collect()} == {("a1", 1), ("b", 1), ("ghost", 2)}


@pytest.mark.parametrize(
    ("heat", "dependents", "role", "tested", "exported", "score", "level"),
    [
        (0, 0, "leaf", False, False, 0, "MEDIUM"), (100, 1, "leaf", True, False, 7, "LOW"), (100, 3, "leaf", True, False, 16, "MEDIUM"), (100, 4, "leaf", True, False, 27, "MEDIUM"),
        (50, 2, "utility", False, True, 35, "HIGH"), (50, 11, "hub", False, True, 90, "CRITICAL"), (20, 1, "entrypoint", True, True, 17, "MEDIUM"),
    ],
)
def test_risk(spark, heat, dependents, role, tested, exported, score, level):
    df = spark.createDataFrame([(heat, dependents, role, tested, exported)], "heat long, dependents long, role string, tested boolean, exported boolean")
    row = df.withColumn("score", lookup.risk_score()).withColumn("level", lookup.risk_level()).first()
    assert (row.score, row.level) == (score, level)


def test_dead_code(spark):
    s = symbols(spark, [symbol("used"), symbol("dead"), symbol("hidden", exported=False), symbol("page", file="web/app/x/page.tsx"), symbol("sec", "section"), symbol("held", parent="dead")])
    links = spark.createDataFrame([("dead", "used", "calls"), ("dead", "held", "contains")], LINK)
    assert {r.id for r in lookup.dead_code(links, s).collect()} == {"dead", "held"}


def test_domains_of_general_folders(spark):
    clusters = spark.createDataFrame([("src/user/hooks/a.ts", "c"), ("src/user/hooks/b.ts", "c"), ("src/x.ts", "d"), ("y.ts", "e")], "file string, cluster string")
    assert {tuple(r) for r in enrich.domains(clusters).collect()} == {("src/user/hooks/a.ts", "user/hooks"), ("src/user/hooks/b.ts", "user/hooks"), ("src/x.ts", "src"), ("y.ts", "root")}


# --- text, paths, security --------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("glob", "path", "fits"), [("**/*.ts", "a/b.ts", True), ("*.ts", "a/b.ts", False), ("src/{a,b}/?.py", "SRC/b/x.py", True), ("x{1}.c", "x{1}.c", True), ("a.b", "aXb", False), ("{a,b}.{js,ts}", "b.js", True)])
def test_globs(spark, glob, path, fits):
    assert spark.createDataFrame([(path,)], "p string").filter(F.col("p").rlike(paths.glob_to_regex(glob))).count() == fits


def test_fnv_and_tokens(spark):
    row = spark.createDataFrame([("foo", "FooBar x1 y_zz")], "a string, b string").select(textsearch.fnv1a(F.col("a")).alias("h"), textsearch.tokens(F.col("b")).alias("t")).first()
    assert (row.h, row.t) == (2851307223, ["foobar", "x1", "zz"])


def test_grep_limits_before_scope(spark):
    files = spark.createDataFrame([(1, "x = import_me\nimport a"), (2, "bin\x00import"), (3, None)], "id int, text string")
    assert [tuple(r) for r in textsearch.grep(files, "import", most=1, scope="imports").collect()] == []
    assert [tuple(r) for r in textsearch.grep(files, "import", scope="imports").collect()] == [(1, 2, "import a")]
    assert textsearch.grep(files, "(a+)+", regex=True).count() == 0


def test_cosine(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, None)], "id int, v array<double>")
    assert [tuple(r) for r in textsearch.cosine_top(v, v.filter("id = 0"), 5, 2).collect()] == [(1, 1.0), (2, 0.0)]


@pytest.mark.parametrize(
    ("version", "clause", "inside"),
    [("1.2.3", "< 1.2.4", True), ("1.2.4", "< 1.2.4", False), ("1.2.4-rc", "< 1.2.4", True), ("4.0.5", ">= 4.0 < 4.0.10", False), ("1.5.0", ">= 1.0.0 < 2.0.0", True), ("2.0.0", "<= 2.0.0", True), ("2.0.0", "> 2.0.0", False), ("x", "< 9.9.9", False), ("10.0.0", "< 9.0.0", False), ("1.0.0", "nonsense", False)],
)
def test_version_ranges(spark, version, clause, inside):
    assert spark.createDataFrame([(version, clause)], "v string, c string").select(security.in_range(F.col("v"), F.col("c")).alias("x")).first().x is inside


def test_scan_redacts_and_keeps_first_of_category(spark):
    files = spark.createDataFrame([("a.ts", 'password = "hunter22"; token = "abcdefgh12345678"\neval(x)'), ("src/a.test.ts", 'password = "hunter22"'), ("n", None)], "path string, text string")
    out = {tuple(r) for r in security.scan(files).select("rule", "file", "line", "match").collect()}
    assert out == {("SEC-001", "a.ts", 1, 'pa****2" [redacted]'), ("RCE-001", "a.ts", 2, "eval(")}


# --- tables, memory, streams ------------------------------------------------------------------------------------------


def test_upsert_last_wins(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    changes = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, seq int")
    assert {tuple(r) for r in tables.upsert(stored, changes, ["k"], "seq").collect()} == {(1, "a"), (2, "y"), (3, "z")}


def test_prune_of_nothing_is_no_change(spark):
    rows = spark.createDataFrame([("a",), ("(external)",), ("b",)], "file_path string")
    assert tables.prune(rows, spark.createDataFrame([], "path string")).count() == 3
    assert {r[0] for r in tables.prune(rows, spark.createDataFrame([("a",)], "path string")).collect()} == {"a", "(external)"}


def test_versions(spark, tmp_path):
    store = tables.Versions(spark, str(tmp_path / "v"))
    store.publish({"t": spark.range(3)})
    store.publish({"t": spark.range(5)})
    assert store.read("t").count() == 5


@pytest.mark.parametrize("seed", range(3))
def test_incremental_refresh_is_a_rebuild(spark, seed):
    rng = random.Random(seed)
    texts = {f"f{i}.py": f"def g{i}(): pass\n" * rng.randint(1, 3) for i in range(8)}
    before = dict(texts)
    for name in list(texts):
        roll = rng.random()
        if roll < 0.2:
            del texts[name]
        elif roll < 0.5:
            texts[name] += "class Fresh: pass\n"
    texts["new.py"] = "x = 1\ndef h(): return x\n"
    files = lambda t: spark.createDataFrame(list(t.items()), "path string, text string")
    hashed = lambda df: df.select("path", F.sha2("text", 256).alias("hash"))
    changed = tables.changed_files(hashed(files(texts)), hashed(files(before))).filter("change <> 'gone'")
    new = extract.python_facts(files(texts).join(changed, "path", "left_semi"))
    got = tables.refresh(extract.python_facts(files(before)), new, files(texts), changed)
    cold = extract.python_facts(files(texts))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, cold.collect()))


def brute_fold(events):
    state, out = {}, []
    for symbol_, key, value, _, i in sorted(events, key=lambda e: (e[3], e[4])):
        old = state.get((symbol_, key))
        if old and old[0] == value:
            c = min(old[1] + 0.1, 1.0)
            event = "promoted" if c >= 0.8 > old[1] else "confidence_up"
        else:
            c, event = 0.5, "created"
        state[symbol_, key] = (value, c)
        out.append((i, c, event))
    return sorted(out)


def test_annotation_fold(spark):
    rng = random.Random(4)
    events = [(f"s{rng.randrange(3)}", rng.choice(["bug", "test"]), rng.choice(["x", "x", "x", "y"]), rng.randrange(50), i) for i in range(300)]
    df = spark.createDataFrame(events, "symbol string, key string, value string, ts long, id long")
    assert sorted((r.id, r.confidence, r.event) for r in memory.fold(df).collect()) == brute_fold(events)


def test_annotation_stream_over_batches(spark, tmp_path):
    rng = random.Random(5)
    events = [(f"s{rng.randrange(2)}", "bug", rng.choice(["x", "x", "y"]), i, i) for i in range(60)]
    schema = "symbol string, key string, value string, ts long, id long"
    for at in range(0, 60, 20):
        spark.createDataFrame(events[at : at + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = flows.annotate(stream).writeStream.format("memory").queryName(f"ann{rng.randrange(10**9)}").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    got = sorted((r.id, r.confidence, r.event) for r in spark.table(q.name).collect())
    assert got == brute_fold(events)


def test_method_orders():
    parents = {"D": ["B", "C"], "B": ["A"], "C": ["A"], "E": ["E"], "X": ["A", "B"]}
    assert resolve.c3(parents, "D") == ["D", "B", "C", "A"] and resolve.c3(parents, "E") is None and resolve.c3(parents, "X") is None


def test_markdown_edges(spark):
    files = spark.createDataFrame([("a.md", "```\n# no\n"), ("b.md", ""), ("c.md", None), ("d.md", "####### no\n#no\n# Yes\r\n")], "path string, text string")
    assert [(r.path, r.name, r.start_line, r.end_line) for r in extract.markdown_sections(files).collect()] == [("d.md", "Yes", 3, 3)]
