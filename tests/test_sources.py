"""Trees on disk, ignore rules, spans against brute force, walks against enumeration."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import components, index, resolve, security, spans, tables, traverse
from tessera.plans import cut
from tessera.sources import tree


def test_scan_skips(spark, tmp_path):
    for path in ("a.ts", "src/b.py", "src/deep/c.GO", "node_modules/x.ts", "src/dist/y.ts", "src/lib.min.js", "notes.txt", "logs/z.ts", "keep/logs/q.ts", "secret.ts"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(f"text of {path}")
    got = {r.path: r.text for r in tree.scan(spark, str(tmp_path), rules=["# no", "/logs/", "*.secret", "secret.*", ""]).collect()}
    assert got == {p: f"text of {p}" for p in ("a.ts", "src/b.py", "src/deep/c.GO", "keep/logs/q.ts")}
    assert "text" not in tree.scan(spark, str(tmp_path), text=False).columns


def test_ignore_rules(spark):
    df = spark.createDataFrame([(p,) for p in ("a/b.log", "b.log", "a/keep.log", "tmp/x", "a/tmp/x", "x/y/z.ts")], "path string")
    rules = ["*.log", "!keep.log", "/tmp/", "x/**"]
    assert sorted(r.path for r in df.filter(~tree.ignored(F.col("path"), rules)).collect()) == ["a/keep.log", "a/tmp/x"]


def test_aliases_follow_chains_and_cycles(spark):
    files = [("a/tsconfig.json", '{"extends": "./b", "compilerOptions": {"paths": {"x": ["y"]}}}'), ("a/b.json", '{"extends": "./tsconfig.json", "compilerOptions": {"paths": {"@/*": ["z/*"]}}}'), ("vite.config.ts", "alias: { '@': path.resolve(__dirname, './src'), '~': './lib' }"), ("Cargo.toml", '[package]\nname = "my-app"\n'), ("pyproject.toml", '[project]\nname = "my-tool"\n'), ("jsconfig.json", "[]"), ("go.mod", None)]
    got = {(r.config, r.prefix): r.target for r in tree.aliases(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got["a/tsconfig.json", "@/"] == "a/z/" and got["a/b.json", "x"] == "a/y" and got["vite.config.ts", "@/"] == "src/" and got["vite.config.ts", "~/"] == "lib/"
    assert got["Cargo.toml", "my_app::"] == "src/" and got["pyproject.toml", "my_tool."] == "my_tool/"


def test_unknown_resource(spark):
    with pytest.raises(ValueError, match="no resource"):
        tree.resource("nothing://x", None, None)


def test_spans_against_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        start = rng.randint(1, 900)
        rows.append((f"s{i}", rng.choice("ab"), start, start + rng.choice([0, 3, 40, 700])))
    symbols = spark.createDataFrame(rows, "id string, file_path string, start_line int, end_line int")
    asked = [(f, n) for f in "ab" for n in range(1, 1000, 7)]
    lines = spark.createDataFrame([*asked, asked[0]], "file_path string, line int")
    inner, near = {}, {}
    for f, n in asked:
        held = [r for r in rows if r[1] == f and r[2] <= n <= r[3]]
        if held:
            inner[f, n] = min(held, key=lambda r: (r[3] - r[2], -r[2], r[0]))[0]
        close = [r for r in rows if r[1] == f and (r[2] <= n <= r[3] or abs(r[2] - n) <= 3)]
        if close:
            near[f, n] = min(close, key=lambda r: (0 if r[2] <= n <= r[3] else 1, abs(r[2] - n), r[0]))[0]
    assert {(r.file_path, r.line): r.id for r in spans.innermost(lines, symbols).collect()} == inner
    assert {(r.file_path, r.line): r.id for r in spans.nearest_span(lines, symbols).collect()} == near
    hunks = [("a", 10, 12), ("a", 100, 400), ("b", 899, 2000)]
    got = sorted((r.id, r.from_line) for r in spans.changed_symbols(spark.createDataFrame(hunks, "file_path string, from_line int, to_line int"), symbols).collect())
    assert got == sorted((r[0], h[1]) for r in rows for h in hunks if r[1] == h[0] and r[2] <= h[2] and r[3] >= h[1])


@pytest.mark.parametrize("seed", range(6))
def test_shortest_path_against_enumeration(spark, seed, monkeypatch):
    if seed % 2:
        monkeypatch.setattr(traverse, "is_small", lambda df, rows=0: False)
        monkeypatch.setattr(traverse, "small", lambda df, rows=0: df)
    rng = random.Random(seed)
    nodes = [f"n{i}" for i in range(9)]
    links = list({(rng.choice(nodes), rng.choice(nodes), rng.choice(["calls", "contains", "imports"])) for _ in range(16)})
    df = spark.createDataFrame(links, "from_id string, to_id string, type string")
    step = {(a, b) for a, b, t in links if t != "contains"} | {(b, a) for a, b, t in links if t == "contains"}
    ahead = {(a, b) for a, b, t in links if t != "contains"}
    members = {b for a, b, t in links if t == "contains" and a == "n0"}
    level = [["n0", b] for a, b in ahead if a == "n0" and b != "n0"]
    want = []
    for hops in range(1, 6):
        if hops == 2:
            level += [["n0", a, b] for a, b in ahead if a in members and b not in ("n0", a)]
        want += [(hops, ">".join(p)) for p in level if p[-1] == "n8"]
        level = [[*p, b] for p in level if p[-1] != "n8" for a, b in step if a == p[-1] and b not in p]
    got = [(r.hops, r.path) for r in traverse.shortest_path(df, "n0", "n8").collect()]
    assert got == ([min(want)] if want else [])


def test_wide_frontiers_walk_alike(spark, monkeypatch):
    rng = random.Random(3)
    links = spark.createDataFrame([(f"n{rng.randint(0, 40)}", f"n{rng.randint(0, 40)}", "calls") for _ in range(120)], "from_id string, to_id string, type string")
    starts = spark.createDataFrame([("n1",), ("n2",)], "id string")
    narrow = [sorted(map(tuple, f(links, starts, ("calls",), 3).collect())) for f in (traverse.walk, traverse.simple_walk)]
    monkeypatch.setattr(traverse, "is_small", lambda df, rows=0: False)
    assert [sorted(map(tuple, f(links, starts, ("calls",), 3).collect())) for f in (traverse.walk, traverse.simple_walk)] == narrow


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "u long, v long")
    assert {r.component for r in components.connected_components(edges).collect()} == {0}
    with pytest.raises(RuntimeError, match="still change"):
        components.connected_components(edges, rounds=2)


def test_method_orders_of_a_deep_and_an_odd_hierarchy(spark):
    deep = [(f"c{i}", f"c{i + 1}", 0) for i in range(30)]
    odd = [("D", "B", 0), ("D", "C", 1), ("B", "A", 0), ("C", "A", 0), ("X", "A", 0), ("X", "B", 1), ("P", "Q", 0), ("Q", "P", 0)]
    got = {r["class"]: r["order"] for r in resolve.method_orders(spark.createDataFrame(deep + odd, "class string, parent string, position int")).collect()}
    assert got["c0"] == ">".join(f"c{i}" for i in range(31)) and got["D"] == "D>B>C>A" and got["X"] is None and got["P"] is None


def test_chunks_need_no_single_task(spark):
    rows = [(f"f{i:03}", i % 7 + 1) for i in range(200)]
    want, used, chunk = {}, 0, 0
    for path, size in rows:
        used, chunk = (size, chunk + 1) if used + size > 50 else (used + size, chunk)
        want[path] = chunk
    df = tables.chunks(spark.createDataFrame(rows, "path string, size int").repartition(5), "size", "path", 50)
    assert {r.path: r.chunk for r in df.collect()} == want


def test_scope_lookup_ends_on_cycles(spark):
    names = spark.createDataFrame([(1, "a", "x", "f")], "key int, scope string, name string, file_path string")
    scopes = spark.createDataFrame([("a", "b"), ("b", "a")], "scope string, parent string")
    declared = spark.createDataFrame([("c", "x", "id", "f")], "scope string, name string, id string, file_path string")
    assert index.scope_lookup(names, scopes, declared).count() == 0


def test_one_rule_of_a_category_a_line(spark):
    files = spark.createDataFrame([("src/a.py", "password = 'hunter22' api_key = 'abcdefgh12345678'\neval(x); os.system('a')")], "path string, text string")
    assert [(r.rule, r.line) for r in security.scan(files).orderBy("line", "rule").collect()] == [("SEC-001", 1), ("RCE-001", 2)]
    assert {r.rule for r in security.scan(files, apart=False).collect()} == {"SEC-001", "SEC-003", "RCE-001", "RCE-002"}


def test_small_counts(spark):
    assert cut.is_small(spark.range(5), 5) and not cut.is_small(spark.range(6), 5)
