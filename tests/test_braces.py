"""Token rows, facts of brace languages, modules by language, greedy chunks and calls by receiver, on small sources."""

import random

import pytest

from tessera.operators import bracefacts, modules, resolve, tables, tokens

TS = r"""import React, { useState as us, type Foo } from 'react'; // import no from 'no'
import * as ns from "./ns";
import './side';
const { join: j, exists } = require('node:path');
const m = await import('./dyn');
/* export * from './commented'
export class No {} */
export * from './all'; export { a as b, c } from './ab';
export * as q from './q'
export class Admin<T> extends Base implements Shape, Other<T> {
  private db: Database = new Sqlite();
  constructor(private readonly repo: Repo<User>, x?: number) { super(x); this.db.open("}}{"); }
  async save(u: User): Promise<Result> {
    const r = await this.repo.find(u), made = ns.deep.count(u);
    if (r) { log(`a } ${b}`, cb); }
    return store<User>(r);
  }
  get size() { return ns.deep.count(this.n); }
}
export const handler = async (req: Request): Response => {
  const inner = (z) => other(z);
  [1, 2].map(inner).filter((v) => v / 2 > 1);
  return new ns.Thing(req);
};
function* gen(a) { yield a; try { go(); } catch (e) { bad(e); } }
export default gen;
interface I { a: string; f(x: number): void; }
type U = A | B;
enum E { X, Y }
const s = 'class Fake {', re = /['"{]/g, k = s;
export { k };
class foo { bar() { function inner() {} } }
"""
JAVA = """package p;
import java.util.List;
import static a.b.C.*;
public class J extends K implements L, M {
  private int n = 1;
  public J(int x) { super(x); this.n = make(x); }
  @Override
  public List<String> go(String s) throws Foo { return new Helper(s).run("}"); }
  abstract void later(int q);
}
interface Z { void f(); }
"""
GO = """package m
import (
  "fmt"
  x "a/b/c"
)
type T struct {
  Base
  n int
}
type I interface { F() }
type N int
func (t *T) Run(a int) error { fmt.Println("}"); return t.go2(a) }
func helper() *T { return &T{} }
var V = 1
"""


@pytest.fixture(scope="module")
def facts(spark):
    files = spark.createDataFrame([("a.ts", TS), ("J.java", JAVA), ("g.go", GO), ("none.ts", None), ("empty.ts", ""), ("odd.ts", "}}) class ( { ' \" ` /* x"), ("x.py", "class A: pass")], "path string, text string")
    return bracefacts.brace_facts(files).collect()


def told(facts, path, fact, *columns):
    return sorted(tuple(r[c] for c in columns) for r in facts if r.path == path and r.fact == fact)


def test_symbols(facts):
    assert told(facts, "a.ts", "symbol", "name", "kind", "line", "end_line", "exported") == sorted([
        ("m", "variable", 5, 5, False), ("Admin", "class", 10, 19, True), ("constructor", "method", 12, 12, False), ("save", "method", 13, 17, False), ("size", "method", 18, 18, False),
        ("handler", "function", 20, 24, True), ("inner", "function", 21, 21, False), ("gen", "function", 25, 25, True), ("I", "interface", 27, 27, False), ("U", "type", 28, 28, False), ("E", "enum", 29, 29, False),
        ("s", "variable", 30, 30, False), ("re", "variable", 30, 30, False), ("k", "variable", 30, 30, True), ("foo", "class", 32, 32, False), ("bar", "method", 32, 32, False), ("inner", "function", 32, 32, False),
    ])
    assert told(facts, "J.java", "symbol", "name", "kind", "line", "end_line", "exported") == sorted([("J", "class", 4, 10, True), ("n", "variable", 5, 5, False), ("J", "method", 6, 6, True), ("go", "method", 8, 8, True), ("later", "method", 9, 9, False), ("Z", "interface", 11, 11, False), ("f", "method", 11, 11, False)])
    assert told(facts, "g.go", "symbol", "name", "kind", "line", "end_line", "exported") == sorted([("T", "struct", 6, 9, True), ("I", "interface", 10, 10, True), ("N", "type", 11, 11, True), ("Run", "method", 12, 12, True), ("helper", "function", 13, 13, False), ("V", "variable", 14, 14, True)])
    assert ("inner", "a.ts#function:inner:2") in told(facts, "a.ts", "symbol", "name", "scope")
    assert {r.parent for r in facts if r.path == "a.ts" and r.kind == "method"} == {"a.ts#class:Admin", "a.ts#class:foo"}


def test_imports_and_reexports(facts):
    assert told(facts, "a.ts", "import", "name", "kind", "parent", "receiver", "line") == sorted([
        ("React", "default", "react", "", 1), ("us", "named", "react", "useState", 1), ("Foo", "named", "react", "Foo", 1), ("ns", "wildcard", "./ns", "", 2), ("*", "wildcard", "./side", "", 3),
        ("j", "named", "node:path", "join", 4), ("exists", "named", "node:path", "exists", 4), ("*", "dynamic", "./dyn", "", 5),
    ])
    assert told(facts, "a.ts", "reexport", "name", "receiver", "parent", "line") == sorted([("*", "*", "./all", 8), ("b", "a", "./ab", 8), ("c", "c", "./ab", 8), ("q", "*", "./q", 9)])
    assert told(facts, "J.java", "import", "name", "kind", "parent") == [("*", "wildcard", "a.b.C"), ("List", "named", "java.util.List")]
    assert told(facts, "g.go", "import", "name", "parent") == [("fmt", "fmt"), ("x", "a/b/c")]


def test_calls_and_scopes(facts):
    calls = {(n, r, s.split("#")[1], a) for n, r, s, a in told(facts, "a.ts", "call", "name", "receiver", "scope", "argument")}
    assert {
        ("open", "this.db", "method:constructor", False), ("find", "this.repo", "method:save", False), ("count", "ns.deep", "method:save", False), ("log", "", "method:save", False), ("cb", "", "method:save", True), ("store", "", "method:save", False),
        ("count", "ns.deep", "method:size", False), ("other", "", "function:inner", False), ("map", "()", "function:handler", False), ("inner", "", "function:handler", True), ("Thing", "ns", "function:handler", False), ("Sqlite", "", "class:Admin", False), ("bad", "", "function:gen", False),
    } <= calls
    assert not {"No", "Fake", "async", "if", "constructor", "f", "bar", "super"} & {c[0] for c in calls}
    assert {(n, r, s) for n, r, s in told(facts, "J.java", "call", "name", "receiver", "scope")} == {("make", "", "J.java#method:J"), ("Override", "", "J.java#class:J"), ("Helper", "", "J.java#method:go"), ("run", "()", "J.java#method:go")}
    assert {("Println", "fmt"), ("go2", "t")} <= {(n, r) for n, r in told(facts, "g.go", "call", "name", "receiver")}


def test_heritage_types_and_flows(facts):
    assert told(facts, "a.ts", "heritage", "name", "kind", "parent", "line") == [("Admin", "extends", "Base", 10), ("Admin", "implements", "Shape", 10)]
    assert told(facts, "J.java", "heritage", "kind", "parent") == [("extends", "K"), ("implements", "L"), ("implements", "M")]
    assert told(facts, "g.go", "heritage", "name", "parent") == [("T", "Base")]
    assert told(facts, "a.ts", "type_binding", "name", "kind") == [("db", "Database"), ("repo", "User"), ("req", "Request"), ("u", "User")]
    assert told(facts, "a.ts", "return_type", "name", "kind") == [("handler", "Response"), ("save", "Result")]
    assert told(facts, "a.ts", "assignment", "name", "parent") == [("k", "s")]
    assert told(facts, "a.ts", "call_result", "name", "parent", "receiver") == [("made", "count", "ns.deep")]


def test_odd_files_have_no_facts(facts):
    assert {r.path for r in facts} <= {"a.ts", "J.java", "g.go", "odd.ts"}


def test_tokens_cover_a_text(spark):
    for name, lang in tokens.LANGUAGES.items():
        text = TS + JAVA + GO + "'open \"quote\n`" + "x" * 20_000 + "'" + "\\'" * 5_000
        df = spark.createDataFrame([(text,)], "t string")
        from pyspark.sql import functions as F

        assert "".join(df.select(F.regexp_extract_all("t", F.lit(lang.pattern), F.lit(0)).alias("x")).first().x) == text, name


def test_longest_root_wins(spark):
    rows = [("a.go", "ex.com/a/b/c"), ("a.go", "ex.com/ab"), ("a.ts", "@/x/y"), ("a.ts", None), ("a.txt", "z")]
    imports = spark.createDataFrame(rows + rows[:1], "file_path string, module_path string")
    roots = spark.createDataFrame([("go", "ex.com/a", "one"), ("go", "ex.com/a/b", "two"), ("go", "ex.com/a/b", "zwo"), ("typescript", "@/", "src"), ("typescript", "@/x", "lib")], "lang string, prefix string, folder string")
    files = spark.createDataFrame([("two/c/x.go",), ("one/b/c/x.go",), ("lib/y/index.js",), ("src/x/y.ts",)], "path string")
    got = sorted((r.module_path or "", r.target, r.state) for r in modules.resolve_modules(imports, files, roots).collect())
    assert got == [("", None, "external"), ("@/x/y", "lib/y/index.js", "resolved"), ("ex.com/a/b/c", "two/c", "resolved"), ("ex.com/a/b/c", "two/c", "resolved"), ("ex.com/ab", None, "external"), ("z", None, "external")]
    assert modules.resolve_modules(imports.limit(0), files, roots).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_chunks_are_greedy(spark, seed):
    rng = random.Random(seed)
    rows = [(f"f{i:04}", rng.choice([None, 0, rng.randint(1, 9), 60])) for i in range(rng.choice([1, 150]))]
    want, used, chunk, held = {}, 0, 0, 0
    for path, size in rows:
        if held and used + (size or 0) > 50:
            used, chunk, held = 0, chunk + 1, 0
        want[path], used, held = chunk, used + (size or 0), held + 1
    df = tables.chunks(spark.createDataFrame(rows, "path string, size int").repartition(5), "size", "path", 50)
    assert {r.path: r.chunk for r in df.collect()} == want
    assert tables.chunks(df.drop("chunk").limit(0), "size", "path", 50).count() == 0


def test_calls_by_receiver(spark):
    symbols = spark.createDataFrame(
        [("B", "Base", "class", "b.ts", True, None, 1), ("B.m", "m", "method", "b.ts", False, "B", 2), ("C", "Child", "class", "c.ts", True, None, 1), ("C.n", "n", "method", "c.ts", False, "C", 2), ("D.m", "m", "method", "d.ts", False, "D", 2), ("D", "Other", "class", "d.ts", True, None, 1), ("D.n", "n", "method", "d.ts", False, "D", 3), ("f", "f", "function", "a.ts", False, "C", 1), ("p", "only", "function", "lib/p.py", True, None, 1)],
        "id string, name string, kind string, file_path string, exported boolean, parent_id string, start_line int",
    )
    calls = spark.createDataFrame(
        [(1, "a.ts", "f", "n", "this", 1, False), (2, "a.ts", "f", "m", "this.x", 2, False), (3, "a.ts", "f", "m", "Renamed", 3, False), (4, "a.ts", "f", "nope", "Renamed", 4, False), (5, "a.ts", "f", "only", None, 5, True), (6, "lib/q.py", "f", "only", "z", 6, False), (7, "a.ts", "f", "only", None, 7, False), (8, "a.ts", "f", "m", "base", 8, False), (9, "a.ts", "f", "m", "y", 9, False)],
        "call_id long, file_path string, scope_id string, name string, receiver string, line int, argument boolean",
    )
    imports = spark.createDataFrame([("a.ts", "d.ts", "Other", "Renamed", "named", 1)], "file_path string, target string, name string, alias string, kind string, line int")
    bindings = spark.createDataFrame([("a.ts", "x", "Child", "f"), ("a.ts", "x", "Other", None), ("a.ts", "y", "Nothing", None)], "file_path string, name string, type_name string, scope_id string")
    locals_ = spark.createDataFrame([], "scope_id string, name string")
    ancestors = spark.createDataFrame([("Child", "Base", 0)], "class string, ancestor string, position int")
    got = {(r.line, r.to_id, r.type, r.confidence, r.reason) for r in resolve.call_links(calls, symbols, imports, locals_, bindings, ancestors).collect()}
    assert got == {
        (1, "C.n", "calls", 0.95, "call-receiver"), (2, "B.m", "calls", 0.93, "call-receiver"), (3, "D.m", "calls", 0.85, "call-receiver"), (4, "D", "references", 0.85, "receiver-ref"),
        (7, "p", "calls", 0.9, "call-unique"), (8, "B.m", "calls", 0.55, "call-receiver"),
    }
