"""Source texts of brace languages as rows of tokens.

One regular expression a language takes strings, templates, comments, type arguments, words and marks one after another, so
that no bracket, quote or keyword within a string or a comment is ever read as code. Lines and bracket depth are running sums
over a file; an opener's partner is the next bracket of its depth, and what encloses a token is the last opener one level up.

Windows over rows as wide as these cost Spark some 100 microseconds a token, so the sums are taken over Arrow columns of many files.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _quoted(q: str, several_lines: bool = False) -> str:
    other = rf"[^{q}\\]" if several_lines else rf"[^{q}\\\n]"
    return rf"{q}{other}*+(?:\\.{other}*+)*+{q}?"


_COMMENT, _WORD, _NUMBER = r"//[^\n]*+|/\*.*?(?:\*/|\z)", r"[\p{L}_$][\p{L}\p{N}_$]*+", r"[0-9][\w.]*+"
#: Type arguments right after a name, two levels deep, before what can follow them.
_ARGUMENTS = r"(?<=[\w$])<[\w$\s,.\[\]|&?*'\"]++(?:<[\w$\s,.\[\]|&?*'\"]*+>[\w$\s,.\[\]|&?*'\"]*+)*+>(?=\s*+[(\[{>,;)=.:\w])"
#: A regular expression stands where a value may begin.
_REGEX = r"(?<=[=(,:;!&|?{}\[\n]|[=(,:!&|?{\[] |return )/(?![/*])[^/\\\n\[]*+(?:(?:\\.|\[[^\]\\\n]*+(?:\\.[^\]\\\n]*+)*+\])[^/\\\n\[]*+)*+/[a-z]*+"
_MARKS = r"=>|->|:=|::|\.\.\.|\?\.|[=!<>]==?|&&|\|\||\?\?|\+\+|--|\s++|."


@dataclass(frozen=True)
class Language:
    """What a brace language calls things. types: keyword to kind of symbol; scopes: kinds that enclose calls."""

    extensions: tuple[str, ...]
    strings: str
    types: dict[str, str]
    functions: tuple[str, ...] = ()
    constants: tuple[str, ...] = ()
    regexes: bool = False
    more: dict[str, str] = field(default_factory=dict)

    @property
    def pattern(self) -> str:
        return "(?s)" + "|".join([_COMMENT, self.strings, *([_REGEX] if self.regexes else []), _ARGUMENTS, _WORD, _NUMBER, _MARKS])


_JS_STRINGS = "|".join([_quoted('"'), _quoted("'"), _quoted("`", True)])
LANGUAGES = {
    "typescript": Language(("ts", "tsx", "mts", "cts"), _JS_STRINGS, {"class": "class", "interface": "interface", "enum": "enum", "type": "type"}, ("function",), ("const", "let"), True),
    "javascript": Language(("js", "jsx", "mjs", "cjs"), _JS_STRINGS, {"class": "class"}, ("function",), ("const", "let"), True),
    "java": Language(("java",), rf'import\s++(?:static\s++)?[\w.]++(?:\*)?\s*+;|"""(?:.*?)(?:"""|\z)|{_quoted(chr(34))}|{_quoted(chr(39))}', {"class": "class", "record": "class", "interface": "interface", "enum": "enum"}),
    "go": Language(("go",), rf"{_quoted(chr(34))}|{_quoted(chr(39))}|`[^`]*+`?", {"struct": "struct", "interface": "interface"}, ("func",), ("var", "const")),
}


def language_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.coalesce(*[F.when(ext.isin(*lang.extensions), F.lit(name)) for name, lang in LANGUAGES.items()])


OPEN, CLOSE = ("(", "[", "{"), (")", "]", "}")
#: What begins or ends a statement: the last one at a token's own depth is its head.
HEADS = ("class", "interface", "enum", "record", "struct", "namespace", "function", "func", "const", "let", "var", "type", "import", "export", "if", "for", "while", "switch", "do", "try", "return", ";")
#: Of them, those that do not end the statement before.
GO_ON = ("if", "for", "while", "switch", "do", "try")
BODIES = ("class", "interface", "enum", "record", "struct")
#: Tokens that are handled at once, so that their arrays stay in a core's cache; a file of more goes alone. They take some 500 bytes a token.
SLICE = 1 << 14

_CLOSES = [f"close{k}_{c}" for k in (2, 3, 4) for c in ("n0", "n1", "n2", "n3", "args")]
TEXTS = ["text", "args", "p0", "p1", "p2", "p3", *[f"n{k}" for k in range(7)], "head_text", "in_role", "in_p0", "in_p1", "in_head_text", "in_close_n0", "in_close_n1", "in_close_n2", "quote", "close1_n0", "close1_n1", "close1_args", *_CLOSES]
NUMBERS = ["at", "line", "depth", "head_at", "head_line", "in_line", "in_head_line", "in_close_at", "in_close_line", "next_at", "next_line", "body_at", "body_close_at", "body_close_line", "close1_at", "close1_line"]
ROWS = ", ".join(["path string", "lang string", "word boolean", "ends_line boolean", *[f"{c} int" for c in NUMBERS], *[f"{c} string" for c in TEXTS]])


def _last(groups: np.ndarray, order: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """For each row the last marked one before it in its group, -1 if there is none. order: sorts by group and keeps rows in order."""
    n = len(order)
    place, sorted_groups = np.arange(n), groups[order]
    begins = np.maximum.accumulate(np.where(np.r_[True, sorted_groups[1:] != sorted_groups[:-1]], place, 0)) if n else place
    last = np.r_[-1, np.maximum.accumulate(np.where(mark[order], place, -1))[:-1]] if n else place
    out = np.empty(n, np.int64)
    out[order] = np.where(last >= begins, order[last], -1)
    return out


def _next(groups: np.ndarray, order: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """As _last, for the next marked row after each."""
    n = len(order)
    found = _last(groups[::-1], n - 1 - order[::-1], mark[::-1])[::-1]
    return np.where(found < 0, -1, n - 1 - found)


def _at(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The values of rows, -1 for rows that are -1."""
    return np.append(values, -1)[rows]


def _placed(paths: pa.Array, langs: pa.Array, texts: pa.Array, file: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """The rows of token_rows for the tokens of some whole files. file: the number of each token's file among paths."""
    encoded = texts.dictionary_encode()
    kinds, code = encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    none = len(kinds)  # stands for the text "" beyond a file's ends
    kinds = pa.concat_arrays([kinds.cast(pa.string()), pa.array([""], pa.string())])
    fits = lambda regex: pc.match_substring_regex(kinds, regex).to_numpy(zero_copy_only=False)
    among = lambda *words: pc.is_in(kinds, pa.array(words, pa.string())).to_numpy(zero_copy_only=False)
    opens, closes, word = among(*OPEN)[code], among(*CLOSE)[code], fits(r"^[\p{L}_$]")
    same_next = np.r_[file[1:] == file[:-1], False] if len(file) else np.zeros(0, bool)
    following = np.r_[code[1:], none] if len(code) else code
    line_end = "\\n\\r\\x{85}\\x{2028}\\x{2029}"
    args = np.where(word[code] & same_next & fits(f"^<[^{line_end}]")[following], following, -1)
    first = np.searchsorted(file, file)  # the first token of a token's file
    before_all = lambda x: (total := np.cumsum(x) - x) - total[first] if len(x) else x
    line = 1 + before_all(pc.count_substring(kinds, "\n").to_numpy(zero_copy_only=False).astype(np.int64)[code])
    step = opens.astype(np.int64) - closes
    depth = before_all(step) + step - opens
    # from here on without white space, comments and type arguments
    code_here = ~(fits(r"^([ \t\n\x0b\f\r]|//|/\*)") | fits(f"^<[^{line_end}]*>$"))[code]
    code, args, file, at, line, depth, opens, closes = (x[code_here] for x in (code, args, file, at, line, depth, opens, closes))
    n = len(code)
    place = np.arange(n)

    def away(k: int) -> np.ndarray:
        """The row k further in the same file, or -1."""
        there = place + k
        inside = (there >= 0) & (there < n)
        return np.where(inside & (file[np.where(inside, there, 0)] == file), there, -1) if n else place

    near = {k: away(k) for k in range(-4, 8) if k}
    text_at = lambda rows: np.append(code, none)[rows]
    lone = lambda rows, k: _at(text_at(near[k]), rows)  # noqa: E731  the text k further than rows, "" beyond the file, null without a row
    brackets = opens | closes
    levels = file * (1 << 32) + depth + brackets
    by_level = np.argsort(levels, kind="stable")
    close = np.where(opens, _next(levels, by_level, brackets), -1)
    depths = file * (1 << 32) + depth
    by_depth = np.argsort(depths, kind="stable")
    before, after = text_at(near[-1]), text_at(near[1])
    begins = (among(*HEADS)[code] & ~among(".")[before]) | (among("}")[code] & ~among(",", ")", ".", "from")[after])
    head = _last(depths, by_depth, begins)
    ends = _next(depths, by_depth, begins & ~among(*GO_ON)[code])
    brace = among("{")[code]
    body = _next(depths, by_depth, brace)
    opener = np.where(depth > 0, _last(levels, by_level, opens), -1)
    role = np.where(brace & (head >= 0) & np.append(among(*BODIES), False)[_at(code, head)], _at(code, head), code)
    quote = _next(file, place, fits("^[\"'`]")[code])
    args_after, next_line = _at(args, near[2]), _at(line, near[-1])
    # from here on only the tokens that are given
    tells = np.flatnonzero(word[code] | among("*")[code] | fits('^"')[code])
    head_of, opener, body, ends = head, opener[tells], body[tells], ends[tells]
    head, closing = head[tells], [_at(close, near[k][tells]) for k in (1, 2, 3, 4)]
    inner_close, inner_head, body_close = _at(close, opener), _at(head_of, opener), _at(close, body)
    out = {
        "text": code[tells], "args": args[tells], **{f"p{k}": text_at(near[-k - 1][tells]) for k in range(4)}, **{f"n{k}": text_at(near[k + 1][tells]) for k in range(7)},
        "head_text": _at(code, head), "in_role": _at(role, opener), "in_p0": lone(opener, -1), "in_p1": lone(opener, -2), "in_head_text": _at(code, inner_head),
        **{f"in_close_n{k}": lone(inner_close, k + 1) for k in range(3)}, "quote": _at(code, quote[tells]),
        "at": at[tells], "line": line[tells], "head_at": _at(at, head), "head_line": _at(line, head), "in_line": _at(line, opener), "in_head_line": _at(line, inner_head),
        "in_close_at": _at(at, inner_close), "in_close_line": _at(line, inner_close), "next_at": _at(at, ends), "next_line": _at(next_line, ends),
        "body_at": _at(at, body), "body_close_at": _at(at, body_close), "body_close_line": _at(line, body_close), "close1_at": _at(at, closing[0]), "close1_line": _at(line, closing[0]),
    }
    for k, c in enumerate(closing, 1):
        out |= {f"close{k}_n{i}": lone(c, i + 1) for i in range(2 if k == 1 else 4)} | {f"close{k}_args": _at(args_after, c)}
    given = lambda x: pa.array(x, pa.int32(), mask=x < 0)
    texts_out = [kinds.take(given(out[c])) for c in TEXTS]
    numbers_out = [given(out[c]) if c != "depth" else pa.array(depth[tells], pa.int32()) for c in NUMBERS]
    files, after = pa.array(file[tells]), near[1][tells]
    on_new_line = pa.array(_at(line, after) > line[tells], mask=after < 0)
    names = ["path", "lang", "word", "ends_line", *NUMBERS, *TEXTS]
    return pa.RecordBatch.from_arrays([paths.take(files), langs.take(files), pa.array(word[code[tells]]), on_new_line, *numbers_out, *texts_out], names)


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens, paths, langs = batch.column("tokens"), batch.column("path"), batch.column("lang")
        size = pc.list_value_length(tokens).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        upto, first = np.cumsum(size), 0
        while first < len(size):
            done = upto[first] - size[first]
            last = max(first + 1, int(np.searchsorted(upto, done + SLICE, "right")))
            some = tokens.slice(first, last - first)
            counts = size[first:last]
            file = np.repeat(np.arange(last - first), counts)
            at = np.arange(len(file)) - np.repeat(np.cumsum(counts) - counts, counts)
            yield _placed(paths.slice(first, last - first), langs.slice(first, last - first), some.flatten(), file, at)
            first = last


def token_rows(files: DataFrame) -> DataFrame:
    """Tokens of files (path, text) that can tell something: words, stars, strings in double quotes. Paths are unique; null texts have none.

    Spark cuts a text into tokens where it lies, and a task places those of many files at once; nothing is shuffled. The rows of a file stay together, in order.

    path, lang, at (order), text, word, line, args (type arguments that follow), depth (brackets around it), p0 to p3 and n0 to n6 (the
    texts before and after it, nearest first, without white space, comments and type arguments), ends_line, head (the last of HEADS at
    its depth), in (the opener around it: its role is what a brace is the body of; its partner is in_close), quote (the next string), next
    (the next of HEADS at its depth, with the line before it), body (the next brace at its depth and its partner), close1 to close4 (the
    partners of the tokens after it, if they are openers; args: those of the second token after the partner).
    """
    named = files.select("path", language_of(F.col("path")).alias("lang"), "text").filter("lang is not null and text is not null")
    found = F.coalesce(*[F.when(F.col("lang") == name, F.regexp_extract_all("text", F.lit(lang.pattern), F.lit(0))) for name, lang in LANGUAGES.items()])
    return named.select("path", "lang", found.alias("tokens")).mapInArrow(_place, ROWS)
