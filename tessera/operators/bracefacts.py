"""Facts of TypeScript, JavaScript, Java and Go sources from their token rows: one pass tells each token's facts, a sweep over a file's facts tells scopes.

A fact is (path, fact, name, kind, parent, receiver, scope, line, end_line, exported, at, end_at, argument):
symbol (kind; parent: id of the class around a method), import (name: local, receiver: name in the module, kind: named, default, wildcard
or dynamic, parent: module), export, call (receiver, argument: only passed on, not called), heritage (name: child, kind: extends or
implements, parent), reexport (name: outside, receiver: inside, * for all; parent: module), type_binding (kind: type), assignment
(parent: source), return_type (kind: type), call_result (parent: callee, receiver), local. scope is the id of the innermost function,
method or class that holds the token, or the module's.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.tokens import LANGUAGES, token_rows
from tessera.plans.cut import spread

#: Words before a bracket that make it no call, or no method.
CONTROL = {
    "typescript": "if for while switch catch with return function new typeof await yield case do else try throw in of instanceof delete void default import super".split(),
    "java": "if for while switch catch return new case do else try throw instanceof default synchronized super this".split(),
    "go": "if for switch return func case else default select defer go range import".split(),
}
CONTROL["javascript"] = CONTROL["typescript"]
SCOPES = ("function", "method", "class", "struct")
CONTAINERS = ("class", "struct")

FIELDS = "fact name kind parent receiver line end_line exported at end_at argument".split()


def _fact(when: Column, fact: str, name: Column, *, kind: Column | str = "", parent: Column | str = "", receiver: Column | str = "", line: Column | None = None, end_line: Column | None = None, at: Column | None = None, end_at: Column | None = None, exported: Column | None = None, argument: Column | None = None) -> tuple[str, Column]:
    text = lambda x: (F.lit(x) if isinstance(x, str) else F.coalesce(x, F.lit(""))).cast("string")
    line, at = F.col("line") if line is None else line, F.col("at") if at is None else at
    values = [F.lit(fact), text(name), text(kind), text(parent), text(receiver), line, line if end_line is None else F.coalesce(end_line, line), F.lit(False) if exported is None else exported, at, at if end_at is None else F.coalesce(end_at, at), F.lit(False) if argument is None else argument]
    types = ["string"] * 5 + ["int", "int", "boolean", "int", "int", "boolean"]
    return fact, F.when(when, F.struct(*[v.cast(t).alias(n) for v, t, n in zip(values, types, FIELDS, strict=True)]))


def _told(rows: DataFrame, facts: tuple[str, ...]) -> DataFrame:
    """Those facts of each token, without scopes and ids; what only other facts need is not worked out."""
    lang, text, word, args, depth = (F.col(c) for c in ("lang", "text", "word", "args", "depth"))
    p, n = [F.col(f"p{k}") for k in range(4)], [F.col(f"n{k}") for k in range(7)]
    js, java, go = lang.isin("typescript", "javascript"), lang == "java", lang == "go"
    head = {c: F.col(f"head_{c}") for c in ("text", "at", "line")}
    in_close = {"at": F.col("in_close_at"), "line": F.col("in_close_line"), "after": [F.col(f"in_close_n{k}") for k in range(3)]}
    inside_ = {"role": F.col("in_role"), "line": F.col("in_line"), "before": [F.col("in_p0"), F.col("in_p1")], "head": {"text": F.col("in_head_text"), "line": F.col("in_head_line")}, "close": in_close}
    nxt, body = {"at": F.col("next_at"), "line": F.col("next_line")}, {"at": F.col("body_at"), "close": {"at": F.col("body_close_at"), "line": F.col("body_close_line")}}
    close1 = {"at": F.col("close1_at"), "line": F.col("close1_line"), "after": [F.col("close1_n0"), F.col("close1_n1")], "args": F.col("close1_args")}
    out: list[tuple[str, Column]] = []
    # what a token must have for a fact, told by its neighbours: most tokens have no fact of some few kinds and go here
    constants, listed_here = ("const", "let"), F.col("in_p0").isin("export", "type")
    may = {
        "symbol": p[0].isin("class", "interface", "enum", "record", "type", "const", "let", "var") | (n[0] == "(") | ((p[0] == ",") & head["text"].isin(*constants)) | (java & n[0].isin("=", ";", ",")),
        "export": reduce(lambda a, b: a | b, [x == "export" for x in p]) | listed_here | (p[0] == "default"),
        "reexport": listed_here | (text == "*"),
        "import": (F.col("in_head_text") == "import") | (head["text"] == "import") | text.isin("*", "require") | text.startswith("import") | text.startswith('"') | F.col("in_p0").isin("const", "let", "var"),
        "call": (n[0] == "(") | p[0].isin("new", "@", "<") | ((F.col("in_role") == "(") & p[0].isin("(", ",")),
        "heritage": head["text"].isin("class", "record") | (F.col("in_role") == "struct"),
        "class_head": head["text"].isin("class", "record"),
        "type_binding": (p[0] == ":") | (n[0] == "="),
        "assignment": n[0] == "=",
        "call_result": n[0] == "=",
        "return_type": (n[0] == "(") | p[0].isin(*constants, ","),
        "local": p[0].isin(*constants, "var", "(", ",", "{", "[", ":", "public", "private", "protected", "readonly"),
    }
    rows = rows.filter(reduce(lambda a, b: a | b, [may[fact] for fact in facts]))

    def named_now(**columns: Column) -> list[Column]:
        """The columns, worked out once a token and read by name from here on."""
        nonlocal rows
        rows = rows.withColumns({f"{k}_now": c for k, c in columns.items()})
        return [F.col(f"{k}_now") for k in columns]

    controls = lambda c: F.when(js, c.isin(*CONTROL["typescript"])).when(java, c.isin(*CONTROL["java"])).otherwise(c.isin(*CONTROL["go"]))
    near_before = lambda word_: reduce(lambda a, b: a | b, [x == word_ for x in p])
    declares = head["text"]
    keyword, keyword_before, keyword_inside, after_params, role = named_now(
        keyword=controls(text), keyword_before=controls(p[0]), keyword_inside=F.coalesce(controls(inside_["before"][0]), F.lit(False)),
        after_params=F.coalesce(close1["after"][0], F.lit("")), role=F.coalesce(inside_["role"], F.lit("")),
    )

    in_class = role.isin("class", "record", "enum", "interface")
    # types: the keyword stands right before the name (Go: after it)
    by_word = lambda c, name: F.coalesce(*[F.when(c == k, F.lit(kind)) for k, kind in LANGUAGES[name].types.items()])
    kind_here = reduce(lambda when, name: when.when(lang == name, by_word(p[0], name)), ("javascript", "java"), F.when(lang == "typescript", by_word(p[0], "typescript")))
    (kind,) = named_now(kind=F.when(go, F.when(p[0] == "type", F.coalesce(by_word(n[0], "go"), F.lit("type")))).otherwise(F.when(p[1] != ".", kind_here)))
    is_alias = (kind == "type") & F.when(go, F.lit(True)).otherwise(n[0] == "=")
    is_type = word & ~keyword & kind.isNotNull() & ((kind != "type") | is_alias) & ~(js & text.isin("extends", "implements", "from"))
    end = {"at": F.when(kind == "type", nxt["at"] - 1).otherwise(body["close"]["at"]), "line": F.when(kind == "type", F.coalesce(nxt["line"], F.col("line"))).otherwise(body["close"]["line"])}
    exported_here = js & near_before("export") & ~(p[0] == ",")
    public = java & near_before("public")

    # functions
    named = (p[0].isin("function", "func") | ((p[0] == "*") & (p[1] == "function"))) & (n[0] == "(")
    opened = body["at"].isNotNull() & (body["at"] > close1["at"]) & (nxt["at"].isNull() | (body["at"] < nxt["at"]))
    is_function = word & (js | go) & named & opened & ~((p[0] == "*") & go)
    # methods: name(...) { within a class, or in an object where nothing but a method can stand so; Go: func (r T) name(
    callable_ = word & (n[0] == "(") & ~keyword & ~p[0].isin("function", "func", "new", ".", "?.", "=>") & ~((p[0] == "*") & (p[1] == "function"))
    js_method = js & callable_ & (role.isin("class", "{")) & ((after_params == "{") | ((after_params == ":") & (role == "class") & opened))
    typed_before = p[0].rlike(r"^([\w$]+|\]|>)$") & ~keyword_before
    java_method = java & callable_ & in_class & (typed_before | args.isNotNull()) & after_params.isin("{", ";", "throws") & (p[0] != "@")
    go_method = go & word & (n[0] == "(") & (p[0] == ")") & (head["text"] == "func") & (depth == 0) & opened
    is_method = js_method | java_method | go_method
    body_end = {c: F.when(after_params == ";", close1[c]).otherwise(body["close"][c]) for c in ("at", "line")}
    # const name [: Type] = [async] (...) [: Type] => ...
    constant = p[0].isin("const", "let") | ((p[0] == ",") & declares.isin("const", "let"))
    typed = (n[0] == ":") & (n[2] == "=")
    value = F.when(typed, n[3]).otherwise(F.when(n[0] == "=", n[1]))
    # first: the partner of the bracket that begins the value
    of_value = lambda c: F.when(typed, F.col(f"close4_{c}")).when(value == "async", F.col(f"close3_{c}")).otherwise(F.col(f"close2_{c}"))
    constant, *after_first, first_args = named_now(constant=constant, **{f"first_{c}": of_value(c) for c in ("n0", "n1", "n2", "n3", "args")})
    first = {"after": after_first, "args": first_args}
    to_body = (first["after"][0] == "=>") | ((first["after"][0] == ":") & (first["after"][2] == "=>"))
    bare = (n[0] == "=") & ((n[2] == "=>") | ((n[1] == "async") & (n[3] == "=>")))
    is_arrow = js & word & constant & (F.coalesce(to_body, F.lit(False)) | bare)
    block = F.when(first["after"][0] == "=>", first["after"][1] == "{").otherwise(first["after"][3] == "{")
    stop = {c: F.least(nxt[c], in_close[c]) for c in ("at", "line")}
    in_block = F.coalesce(block, F.lit(False)) | F.coalesce(bare & (n[3] == "{"), F.lit(False))
    arrow_end = {"at": F.when(in_block, body["close"]["at"]).otherwise(stop["at"] - 1), "line": F.when(in_block, body["close"]["line"]).otherwise(stop["line"])}
    is_variable = js & word & constant & (depth == 0) & ~is_arrow
    go_variable = go & word & p[0].isin("var", "const") & (n[0] != "(")
    java_field = java & word & in_class & n[0].isin("=", ";", ",") & typed_before & ~F.coalesce(declares == "return", F.lit(False)) & (p[0] != "package")
    is_type, is_function, is_method, is_arrow, is_variable = named_now(is_type=is_type, is_function=is_function, is_method=is_method, is_arrow=is_arrow, is_variable=is_variable)
    head_at, head_line = F.coalesce(head["at"], F.col("at")), F.coalesce(head["line"], F.col("line"))
    out += [
        _fact(is_type, "symbol", text, kind=kind, line=head_line_of(js, p, head, "line"), end_line=end["line"], at=F.col("at") - 1, end_at=end["at"], exported=public | (go & text.rlike("^[A-Z]"))),
        _fact(is_function, "symbol", text, kind="function", end_line=body["close"]["line"], at=F.col("at") - 1, end_at=body["close"]["at"], exported=go & text.rlike("^[A-Z]")),
        _fact(is_method, "symbol", text, kind="method", end_line=body_end["line"], end_at=body_end["at"], exported=public | (go & text.rlike("^[A-Z]"))),
        _fact(is_arrow, "symbol", text, kind="function", line=head_line, end_line=arrow_end["line"], at=head_at, end_at=arrow_end["at"]),
        _fact(is_variable, "symbol", text, kind="variable", line=head_line, end_line=F.coalesce(nxt["line"], F.col("line"))),
        _fact(go_variable | java_field, "symbol", text, kind="variable", exported=go & text.rlike("^[A-Z]")),
    ]
    # exports
    in_list = js & (role == "{") & (inside_["before"][0].isin("export") | ((inside_["before"][0] == "type") & (inside_["before"][1] == "export")))
    listed = in_list & word & p[0].isin("{", ",", "type") & (text != "type")
    string = F.regexp_replace("quote", "^[\"'`]|[\"'`]$", "")
    from_list = inside_["close"]["after"][0] == "from"
    local_name, outer = text, F.when(n[0] == "as", n[1]).otherwise(text)
    declared = js & word & exported_here & (is_type | is_function | is_arrow | (is_variable & (p[1] == "export")))
    out += [
        _fact(declared | listed | (js & word & (p[0] == "default") & (p[1] == "export") & ~text.isin("class", "function", "async", "abstract", "new")), "export", local_name),
        _fact(listed & from_list, "reexport", outer, parent=string, receiver=local_name, line=inside_["head"]["line"]),
        _fact(js & (text == "*") & (p[0] == "export"), "reexport", F.when(n[0] == "as", n[1]).otherwise("*"), parent=string, receiver="*", line=head_line),
    ]
    # imports
    importing = js & (F.coalesce(inside_["head"]["text"], F.lit("")) == "import") & (inside_["close"]["after"][0] == "from") & (role == "{")
    imported = importing & word & p[0].isin("{", ",", "type") & (text != "type")
    clause = js & word & (declares == "import") & (p[0].isin("import") | ((p[0] == "type") & (p[1] == "import"))) & n[0].isin("from", ",") & (text != "type")
    dynamic = js & (text == "import") & (n[0] == "(")
    required = js & (text == "require") & (n[0] == "(") & (p[0] == "=")
    side = js & (text == "import") & n[0].rlike("^[\"']")
    star = js & (text == "*") & ((p[0] == "import") | ((p[0] == ",") & (declares == "import"))) & (n[0] == "as")
    picked = js & word & (role == "{") & (inside_["close"]["after"][0] == "=") & inside_["before"][0].isin("const", "let", "var") & p[0].isin("{", ",")
    module = in_close["after"]
    required_names = picked & ((module[1] == "require") | ((module[1] == "await") & (module[2] == "import")))
    alias = lambda sep: F.when(n[0] == sep, n[1]).otherwise(text)
    java_path = F.regexp_extract("text", r"^import\s+(?:static\s+)?(\w+(?:\.\w+)*(?:\.\*)?)", 1)
    java_last = F.element_at(F.split(java_path, r"\."), -1)
    out += [
        _fact(imported, "import", alias("as"), kind="named", parent=string, receiver=text, line=inside_["head"]["line"]),
        _fact(clause, "import", text, kind="default", parent=string, line=head_line),
        _fact(star, "import", n[1], kind="wildcard", parent=string, line=head_line),
        _fact(side, "import", F.lit("*"), kind="wildcard", parent=string),
        _fact(required_names, "import", alias(":"), kind="named", parent=string, receiver=text, line=inside_["line"]),
        _fact(dynamic & ~((p[0] == "await") & (p[1] == "=") & (p[2] == "}")), "import", F.lit("*"), kind="dynamic", parent=string),
        _fact(required & (p[1] != "}"), "import", p[1], kind="wildcard", parent=string),
        _fact(java & text.rlike(r"^import\s"), "import", java_last, kind=F.when(java_last == "*", "wildcard").otherwise("named"), parent=F.regexp_replace(java_path, r"\.\*$", ""), receiver=F.when(java_last == "*", "").otherwise(java_last)),
        _fact(go & text.rlike('^"') & ((p[0] == "import") | (F.coalesce(inside_["before"][0], F.lit("")) == "import") | ((p[1] == "import") & p[0].rlike(r"^[\w.]"))), "import",
              F.when(p[0].rlike(r"^[\w._]+$") & (p[0] != "import") & ~(p[0].isin("(")), p[0]).otherwise(F.element_at(F.split(F.regexp_replace("text", '"', ""), "/"), -1)), kind="module", parent=F.regexp_replace("text", '"', "")),
    ]
    # calls
    jsx = (lang == "typescript") & word & (p[0] == "<") & text.rlike("^[A-Z]") & ~p[1].rlike(r"^[\w$)\]]+$") | ((lang == "typescript") & word & (p[0] == "<") & (p[1] == "return") & text.rlike("^[A-Z]"))
    created = (js | java) & word & (p[0] == "new") & (js | (n[0].isin("(", "{", "[")))
    annotated = (js | java) & word & (p[0] == "@") & ~((n[0] == "(") & js) & (text != "interface")
    calls = word & (n[0] == "(") & ~keyword & ~is_method & ~is_function & ~p[0].isin("function", "func", "record") & ~(go & (p[0] == ")") & (declares == "func") & (depth == 0)) & ~(js & (text == "async"))
    abstract_js = js & callable_ & role.isin("class", "interface") & after_params.isin(":", ";")
    in_call = (role == "(") & F.coalesce(inside_["before"][0].rlike(r"^[\w$]+$") & ~keyword_inside & ~inside_["before"][1].isin("function", "func"), F.lit(False)) & ~F.coalesce(inside_["close"]["after"][0].isin("{", "=>", ":"), F.lit(False))
    passed = js & word & in_call & p[0].isin("(", ",") & n[0].isin(")", ",") & ~text.isin("this", "true", "false", "null", "undefined", "super")
    receiver = F.when(p[0].isin(".", "?."), F.when(p[1].rlike(r"^[\w$]+$"), F.when(p[2].isin(".", "?."), F.concat(p[3], p[2], p[1])).otherwise(p[1])).otherwise("()")).otherwise("")
    out += [
        _fact((calls & ~abstract_js) | (created & ~n[0].isin("(", ".")) | annotated | jsx, "call", text, receiver=receiver, at=F.col("at")),
        _fact(passed, "call", text, argument=F.lit(True)),
    ]
    # heritage: names in the head of a class, outside type arguments
    classy = (js | java) & (declares.isin("class", "record")) & word & ~in_list & (F.col("at") > head["at"] + 1)
    extends = classy & (p[0] == "extends") & (n[0] != ".")
    implements = classy & ((p[0] == "implements") | ((p[0] == ",") & n[0].isin(",", "{"))) & args.isNull() & (F.coalesce(body["at"], F.lit(-1)) > F.col("at"))
    row = F.when(head["line"] > 1, head["line"]).otherwise(0)  # a class in the first line has no line
    embedded = go & word & (role == "struct") & F.col("ends_line") & ~p[0].rlike(r"^[\w.*\])]") & (n[0] != ".")
    out += [
        _fact(extends, "heritage", F.lit(""), kind="extends", parent=text, line=row, end_at=head["at"]),
        _fact(implements, "heritage", F.lit(""), kind="implements", parent=text, line=row, end_at=head["at"]),
        _fact(embedded, "heritage", inside_["before"][1], kind="extends", parent=text, line=inside_["line"]),
        _fact((js | java) & declares.isin("class", "record") & is_type, "class_head", text, end_at=head["at"]),
    ]
    # what variables hold
    params = (role == "(") & (F.coalesce(inside_["close"]["after"][0].isin("=>", "{"), F.lit(False)) | (F.coalesce(inside_["close"]["after"][0] == ":", F.lit(False)) & (F.coalesce(inside_["before"][1], F.lit("")).isin("function") | (F.coalesce(inside_["close"]["after"][2], F.lit("")).isin("=>", "{"))))) & ~(keyword_inside & F.coalesce(inside_["before"][0] != "function", F.lit(False)))
    (params,) = named_now(params=params)
    parameter = js & word & params & p[0].isin("(", ",", "public", "private", "protected", "readonly") & n[0].isin(",", ")", ":", "?", "=")
    argument_of = lambda a: F.nullif(F.regexp_extract(F.coalesce(a, F.lit("")), r"^<\s*([\w$]+)", 1), F.lit(""))  # noqa: E731  Array<User>: the first argument
    of_type = js & word & (p[0] == ":") & ~n[0].isin(".", "(") & (p[1].rlike(r"^[\w$]+$"))
    bound = of_type & (((role == "(") & params) | ((role == "class")) | (p[2].isin("const", "let")))
    inner = F.when(args.isNotNull(), argument_of(args)).otherwise(text)
    plain = "^(string|number|boolean|any|void|unknown|never|object|null|undefined|symbol|bigint)$"
    made = js & word & constant & (n[0] == "=") & (n[1] == "new")
    returns = F.when(js & (after_params == ":"), F.coalesce(argument_of(close1["args"]), close1["after"][1]))
    arrow_returns = F.when(first["after"][0] == ":", F.coalesce(argument_of(first["args"]), first["after"][1]))
    go_returns = F.when(go & ~after_params.isin("{", "("), F.when(after_params == "*", close1["after"][1]).otherwise(after_params))
    caught = js & word & (role == "(") & (F.coalesce(inside_["before"][0], F.lit("")) == "catch") & (p[0] == "(")
    unpacked = js & word & role.isin("{", "[") & F.coalesce(inside_["before"][0].isin("const", "let", "var"), F.lit(False)) & ((p[0].isin("{", ",", "[") & n[0].isin(",", "}", "]", "=")) | (p[0] == ":"))
    out += [
        _fact(bound & ~inner.rlike(plain), "type_binding", p[1], kind=inner),
        _fact(made, "type_binding", text, kind=n[2]),
        _fact(js & word & constant & (n[0] == "=") & n[1].rlike(r"^[\p{L}_$]") & n[2].isin(";", ",", "") & ~n[1].isin("true", "false", "null", "undefined", "this"), "assignment", text, parent=n[1]),
        _fact((is_function | js_method) & returns.rlike(r"^[\p{L}_$]") & ~returns.rlike(plain), "return_type", text, kind=returns),
        _fact(is_arrow & arrow_returns.rlike(r"^[\p{L}_$]") & ~arrow_returns.rlike(plain), "return_type", text, kind=arrow_returns),
        _fact((is_function | go_method) & go_returns.rlike(r"^[\p{L}_]"), "return_type", text, kind=go_returns),
        _fact(js & word & constant & (n[0] == "=") & n[1].rlike(r"^[\p{L}_$]") & ~n[1].isin("async", "new", "await", "require", "import", "function") & ~is_arrow & ((n[2] == "(") | ((n[2] == ".") & (n[4] == "(")) | ((n[2] == ".") & (n[4] == ".") & (n[6] == "("))), "call_result", text,
              parent=F.when(n[2] == "(", n[1]).when(n[4] == "(", n[3]).otherwise(n[5]), receiver=F.when(n[2] == "(", "").when(n[4] == "(", n[1]).otherwise(F.concat(n[1], n[2], n[3]))),
        _fact((js & word & constant) | (js & word & (p[0] == "var")) | parameter | caught | unpacked, "local", text),
    ]
    # the array is a column of its own, for which code is generated; within explode every token would be interpreted
    rows = rows.select("path", F.array(*[told for fact, told in out if fact in facts]).alias("facts"))
    return rows.select("path", F.explode("facts").alias("f")).filter("f is not null").select("path", "f.*")


def head_line_of(js: Column, p: list[Column], head: Column, what: str) -> Column:
    return F.when(js & p[0].isin("class", "interface", "enum", "type"), F.coalesce(head[what], F.col(what))).otherwise(F.col(what))


#: Of two kinds that one name has on one line, the first counts.
PRIORITY = ("function", "class", "method", "interface", "enum", "struct", "type", "variable")
RANK = {kind: k for k, kind in enumerate(PRIORITY)}
FACTS = "path string, fact string, name string, kind string, parent string, receiver string, scope string, line int, end_line int, exported boolean, argument boolean"
NAMES = [c.split()[0] for c in FACTS.split(", ")]
ALL = ("symbol", "export", "import", "call", "heritage", "reexport", "type_binding", "assignment", "return_type", "call_result", "local")


def _held(points: set[int], spans: list[tuple], least: Callable[[tuple], object]) -> dict[int, tuple]:
    """For each point the least of the spans (first, last, ...) that hold it."""
    out, open_, k = {}, [], 0
    spans = sorted(spans, key=lambda s: s[0])
    for x in sorted(points):
        while k < len(spans) and spans[k][0] <= x:
            open_.append(spans[k])
            k += 1
        open_ = [s for s in open_ if s[1] >= x]
        if open_:
            out[x] = min(open_, key=least)
    return out


def _scoped_file(path: str, rows: range, c: dict[str, list], scope: list) -> None:
    """Gives the facts of one file (rows of the columns c) their ids, holders and scopes; what is left without a scope is no fact."""
    fact, name, kind, line, end_line, at, end_at = (c[x] for x in ("fact", "name", "kind", "line", "end_line", "at", "end_at"))
    symbols, seen, nth, given, children, rest = [], set(), Counter(), set(), {}, []
    for i in rows:
        if fact[i] == "symbol":
            symbols.append(i)
            continue
        if fact[i] == "export":
            given.add(name[i])
        if fact[i] == "class_head":
            children[end_at[i]] = name[i]
        else:
            rest.append(i)
    once = []
    for i in sorted(symbols, key=lambda i: (RANK[kind[i]], at[i])):
        if (name[i], line[i]) not in seen:
            seen.add((name[i], line[i]))
            once.append(i)
    methods, holders, scopes = [], [], []
    for i in sorted(once, key=lambda i: at[i]):
        nth[kind[i], name[i]] += 1
        k = nth[kind[i], name[i]]
        scope[i] = f"{path}#{kind[i]}:{name[i]}" + (f":{k}" if k > 1 else "")
        c["exported"][i] = c["exported"][i] or name[i] in given
        c["parent"][i] = ""
        if kind[i] == "method":
            methods.append(i)
        if kind[i] in CONTAINERS:
            holders.append((line[i], end_line[i], at[i], scope[i]))
        if kind[i] in SCOPES:
            scopes.append((at[i], end_at[i], scope[i]))
    # the first container that spans a method
    around = _held({line[i] for i in methods}, holders, lambda s: s[2]) if holders else {}
    for i in methods:
        holder = around.get(line[i])
        if holder and holder[1] >= end_line[i]:
            c["parent"][i] = holder[3]
    # the smallest scope that holds a fact; of equals the one that starts last, then the first id
    inner = _held({at[i] for i in rest}, scopes, lambda s: (s[1] - s[0], -s[0], s[2])) if scopes else {}
    top = f"{path}#module:_top:0"
    for i in rest:
        scope[i] = inner[at[i]][2] if at[i] in inner else top
        if fact[i] == "heritage" and name[i] == "":
            name[i] = children.get(end_at[i])


def _scoped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The facts of files, whose rows come one after another, with scopes. A file's last batch ends where another path begins."""

    def given(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = {x: batch.column(x).to_pylist() for x in ("path", "fact", "name", "kind", "parent", "line", "end_line", "at", "end_at", "exported")}
        path, scope, first = c["path"], [None] * batch.num_rows, 0
        while first < len(path):
            last = first + 1
            while last < len(path) and path[last] == path[first]:
                last += 1
            _scoped_file(path[first], range(first, last), c, scope)
            first = last
        made = {"name": c["name"], "parent": c["parent"], "scope": scope, "exported": c["exported"]}
        columns = [pa.array(made[n], pa.bool_() if n == "exported" else pa.string()) if n in made else batch.column(n) for n in NAMES]
        return pa.RecordBatch.from_arrays(columns, NAMES).filter(pa.array([x is not None for x in scope], pa.bool_()))

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    open_: list[pa.RecordBatch] = []  # of the file that may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        new = pc.not_equal(batch.column("path"), batch.column("path")[-1]).to_numpy(zero_copy_only=False)
        begins = int(np.flatnonzero(new)[-1]) + 1 if new.any() else 0  # where the last path begins
        if begins or (open_ and open_[-1].column("path")[-1].as_py() != batch.column("path")[0].as_py()):
            yield given(joined([*open_, *([batch.slice(0, begins)] if begins else [])]))
            open_ = []
        open_.append(batch.slice(begins))
    if open_:
        yield given(joined(open_))


def brace_facts(files: DataFrame, facts: tuple[str, ...] = ALL, scopes: bool = True) -> DataFrame:
    """Those facts of files (path, text), each with the id of its scope; symbols have their own id as scope and their class as parent.

    A symbol's id is path#kind:name, with :n for the n-th of a kind and name in a file. It is exported if an export of its file has its
    name (TypeScript, JavaScript), if it is public (Java) or begins with a capital (Go). Paths are unique; null texts have no facts.
    Without scopes no ids are worked out and scope is null, but for symbols, which always have theirs.
    Not read: code within template strings, and more than two levels of type arguments.

    Files are dealt over the cores; all that is told of a file stays in its task, in the order of its tokens, so nothing else is shuffled.
    """
    needs = {*facts}
    if scopes or "symbol" in facts:
        needs |= {"symbol"}
    if "symbol" in facts:
        needs |= {"export"}
    if "heritage" in facts:
        needs |= {"class_head"}
    # the code that tells facts is longer than the JVM compiles when a whole stage is one method; in parts it is compiled
    files.sparkSession.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    told = _told(token_rows(spread(files.select("path", "text"))), tuple(sorted(needs)))
    if scopes or needs & {"symbol", "heritage"}:
        told = told.mapInArrow(_scoped, FACTS)
        told = told if scopes else told.withColumn("scope", F.when(F.col("fact") == "symbol", F.col("scope")))
    else:
        told = told.withColumn("scope", F.lit(None).cast("string"))
    return told.filter(F.col("fact").isin(*facts)).select(NAMES)
