"""Cases that once went wrong: class names, bare line feeds, lying lengths, hot ids, notices of several paragraphs; and results against slow forms and SQL."""

import collections
import gzip
import hashlib
import html
import math
import random
import re

import duckdb
import pytest
from oracle import connect, differences
from pyspark.sql import functions as F
from test_llm_operators import labelled

from tessera.llm import fingerprints, html_text, language, license, packing, queries, warc

SF = "/root/testdata/sf0.001"
SOME = " ".join(f"Sentence number {i} of the article says something plain." for i in range(12))


@pytest.mark.parametrize("name", ["no-sidebar", "has-sidebar content", "post share-enabled", "container comments-closed", "js-skip", "page-meta-off related", "layout-sidebar", "hide_menu", "related"])
@pytest.mark.parametrize("tag", ["div", "article", "section"])
def test_a_state_in_a_class_is_no_furniture(name, tag):
    page = f'<body><nav><a href="/">Home</a></nav><{tag} class="{name}"><h1>Title</h1><p>{SOME}</p><div class="ad-box">Buy this.</div><ul id="share_buttons"><li>Tell others about it</li></ul><p>{SOME}</p></{tag}><footer>End</footer></body>'
    assert html_text.main_text(page) == f"Title\n\n{SOME}\n\n{SOME}"


def test_named_furniture_stays_furniture():
    assert html_text.main_text('<body><div class="ad">Buy now, this and that.</div></body>') == ""
    assert html_text.main_text(f'<div class="wrap"><p>{SOME}</p></div><div class="site-footer">About us and our people, at length.</div><div id="comments-list"><p>{SOME} I agree.</p></div>') == SOME


def slow_text(page):
    """For pages with one article and plain furniture: patterns instead of a parser."""
    page = re.sub(r"(?s)<!--.*?-->|<(script|style|form|aside|nav|footer|header)\b.*?</\1>", "", page)
    body = re.search(r"(?s)<article[^>]*>(.*?)</article>", page).group(1)
    while (less := re.sub(r'(?s)<(div|section|ul|p|ol|table)\b[^>]*(?:class|id)="[^"]*\b(?:ad|ads|comments?|sidebar|related|share|social|newsletter|promo|cookie|notice)\b[^"]*"[^>]*>(?:(?!<\1\b).)*?</\1>', "", body)) != body:
        body = less
    blocks = re.split(r"(?i)</?(?:p|div|h[1-6]|ul|ol|li|table|tr|section|blockquote|pre|figure|figcaption|hr)\b[^>]*>", body)
    plain = [" ".join(html.unescape(re.sub(r"</?[a-zA-Z][^>]*>", "", re.sub(r"(?i)<br\s*/?>|</?t[dh]\b[^>]*>", " ", b))).split()) for b in blocks]
    return "\n\n".join(b for b in plain if b)


def test_pages_against_patterns(spark):
    pages = [r for r in spark.read.parquet(f"{SF}/pages.parquet").collect() if "<article" in (r.html or "")]
    assert len(pages) >= 20
    assert [html_text.main_text(r.html) for r in pages] == [slow_text(r.html) for r in pages]


def archive(tmp_path, records):
    path = tmp_path / "x.warc.gz"
    path.write_bytes(gzip.compress(b"".join(records)))
    return str(path)


def record(block, kind=b"response", end=b"\r\n", more=b""):
    head = [b"WARC/1.1", b"WARC-Type: " + kind, b"WARC-Record-ID: <urn:x:%d>" % len(block), b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return end.join(head) + end + more + end + block + end + end


@pytest.mark.parametrize("end", [b"\r\n", b"\n"])
@pytest.mark.parametrize("length", [b"10", b"3", b"999", b"x"])
def test_warc_line_ends_and_lying_lengths(spark, tmp_path, end, length):
    block = end.join([b"HTTP/1.1 200 OK", b"Content-Length: " + length, b"", b"hello\n\nbody"])
    bare = end.join([b"HTTP/1.1 304 Not Modified", b"Content-Length: 7", b"", b""])
    path = archive(tmp_path, [record(block, end=end), record(bare, b"revisit", end), record(b"GET / HTTP/1.1" + end + b"Host: x", b"request", end), record(block + b"!", end=end)])
    for payload in (True, False):
        rows = warc.read_warc(spark, path, payload=payload).collect()
        assert [(r.record_type, r.payload_bytes) for r in rows] == [("response", 11), ("revisit", 7), ("request", 0), ("response", 12)]
        assert [bytes(r.payload) if r.payload is not None else None for r in rows] == ([b"hello\n\nbody", b"", b"", b"hello\n\nbody!"] if payload else [None] * 4)


def test_warc_long_headers(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\n" + b"".join(b"X-%d: %s\r\n" % (i, b"y" * 100) for i in range(200)) + b"\r\n" + b"z" * 10_000
    rows = warc.read_warc(spark, archive(tmp_path, [record(block)] * 3)).collect()
    assert [(r.payload_bytes, len(r.payload), r.headers["http-x-199"]) for r in rows] == [(10_000, 10_000, "y" * 100)] * 3


def test_warc_repeated_and_null_page_ids(spark, tmp_path):
    long = "<p>" + "é" * 800
    pages = [(5, "u", long), (5, "u", long), (3, "v", long), (None, "w", long), (7, None, "short"), (8, None, "short"), (9, "x", None)]
    warc.archive_pages(spark.createDataFrame(pages, "page_id long, url string, html string"), str(tmp_path / "a"))
    rows = warc.page_records(warc.read_warc(spark, str(tmp_path / "a"))).collect()
    got = collections.Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in rows)
    assert got == {(5, "response", None, 1603): 2, (3, "revisit", 5, 1603): 1, (None, "revisit", 5, 1603): 1, (7, "response", None, 5): 1, (8, "response", None, 5): 1, (9, "response", None, 0): 1}
    assert {r.payload_digest for r in rows if r.payload_bytes == 1603} == {hashlib.sha1(long.encode()).hexdigest()}


def test_fingerprints_of_a_hot_id(spark, monkeypatch):
    """A third of the rows share one id, and a third have none; every row meets the row after it."""
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 10)
    rows = [(i if i % 3 else 50 if i % 2 else None, f"text number {i} goes on " * 3) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    ranges = fingerprints._in_ranges(df).filter("not foreign").groupBy("range").count().collect()
    assert max(r["count"] for r in ranges) < 60
    every = [(r.doc_id, r.text) for r in df.orderBy(F.desc_nulls_last("doc_id"), F.xxhash64("text")).collect()]
    want = collections.Counter()
    for (doc, text), (after, nxt) in zip(every, every[1:] + every[:1], strict=True):
        edited = text[: len(text) - len(text) // 2] + nxt[: len(text) // 2]
        want[doc, after, hashlib.sha256(edited.encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.next_doc_id, r.edited_sha256) for r in fingerprints.fingerprint_edits(df).collect()) == want


def test_equal_rows_are_packed_apart(spark):
    """A thousand equal rows do not meet in one group."""
    df = spark.createDataFrame([(1, "the same text in every row " * 20)] * 1000, "doc_id long, text string").repartition(4)
    out = packing.pack_documents(df, queries.tokenizer_path(), group_rows=50)
    groups = out.groupBy(F.shiftright("sequence_id", 32).alias("g")).count().collect()
    assert sum(r["count"] for r in groups) == 1000 and max(r["count"] for r in groups) < 200
    used = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r.n == r.end <= 2048 for r in used)


@pytest.mark.parametrize("name", ["BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "Unlicense", "AGPL-3.0", "LGPL-3.0", "GPL-2.0", "GPL-3.0"])
def test_full_notices(name):
    longest = max(license.TEMPLATES[name], key=len)
    words = longest.split()
    wrapped = "\n".join(" * " + " ".join(words[i : i + 9]) for i in range(0, len(words), 9))
    found = license.Scanner(license.TEMPLATES, 0.8).scan(f"/*\n * Copyright (c) 2020 Jane Doe. All rights reserved.\n{wrapped}\n */\nint main() {{ return 0; }}\n")
    assert found and max(found, key=lambda x: x[1])[0] == name


def test_templates_from_a_folder(tmp_path):
    (tmp_path / "Own-1.0.txt").write_text("You may use this for anything at all, as long as you sing its praise on Sundays.")
    scanner = license.Scanner(license.TEMPLATES | license.templates_in(str(tmp_path)), 0.8)
    assert ("Own-1.0", 1.0, "line", 2, 2) in scanner.scan("x\nYou may use this for anything at all, as long as you sing its praise on Sundays.\ny")


def test_two_licences_that_tie(spark):
    same = {"B": ["one two three four five"], "A": ["one two three four five"]}
    rows = license.scan_licenses(spark.createDataFrame([(1, "one two three four five")] * 2, "doc_id long, text string"), same).collect()
    assert [(r.doc_id, r.license, r.dice) for r in rows] == [(1, "A", 1.0)] * 2


def test_language_posterior_by_hand(spark):
    """The fused posterior of every page, worked out one page at a time; one page stands twice and one text is very long."""
    data = labelled(spark)
    pages = [
        (1, "http://x.de/a", "<html lang='de'><p>der und mit haus nicht der und"), (2, "http://x.de/b", "<html lang='en'><p>der und the with mit haus"), (3, "http://x.de/c", "<p>der"), (4, None, None), (5, "http://y.com/", "<p>the and with"),
        (6, "http://z.com/", "<p>" + "the and with house that " * 20_000), (2, "http://x.de/b", "<html lang='en'><p>der und the with mit haus"), (7, "http://y.com/q", "<html lang=xx><p>the und"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    model = language.fit_trigrams(data)
    k = len(model.languages)
    import pyarrow as pa

    logs, fit = model.scores(pa.array([html_text.main_text(p[2]) for p in pages]))
    said = [re.search(r"lang='?(\w+)", p[2] or "") for p in pages]
    own = []
    for row, s in zip(logs, said, strict=True):
        lang = s and s.group(1)
        odds = [x + (math.log(0.9 if lang == y else 0.1 / max(k - 1, 1)) if lang in model.languages else 0.0) for x, y in zip(row, model.languages, strict=True)]
        own.append([math.exp(x - max(odds)) for x in odds])
        own[-1] = [x / sum(own[-1]) for x in own[-1]]
    host = [re.sub(r"^https?://([^/]*).*", r"\1", p[1] or "") for p in pages]
    suffix = [h.rsplit(".", 1)[-1] if "." in h else "" for h in host]
    total = [sum(o[j] for o in own) for j in range(k)]
    want = []
    for i, o in enumerate(own):
        base = [(t + 1) / (sum(total) + k) for t in total]
        mine = [sum(x[j] for x, s in zip(own, suffix, strict=True) if s == suffix[i]) for j in range(k)]
        share = [(mine[j] + language.SUFFIX_PRIOR * base[j]) / (sum(mine) + language.SUFFIX_PRIOR) for j in range(k)]
        others = [max(0.0, sum(x[j] for x, h in zip(own, host, strict=True) if h == host[i]) - o[j]) for j in range(k)]
        p = [math.log(a) + math.log((n + language.HOST_PRIOR * s) / (sum(others) + language.HOST_PRIOR)) if a > 0 else -math.inf for a, n, s in zip(o, others, share, strict=True)]
        e = [math.exp(x - max(p)) for x in p]
        want.append((pages[i][0], max(e) / sum(e), model.languages[e.index(max(e))] if fit[i] >= -2.0 else None))
    got = [(r.page_id, r.posterior, r.language) for r in language.identify_pages(df, data).collect()]
    for (a, x, la), (b, y, lb) in zip(sorted(want, key=str), sorted(got, key=str), strict=True):
        assert a == b and la == lb and x == pytest.approx(y, abs=1e-6)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_in_sql(spark, name):
    con = connect(SF)
    assert isinstance(con, duckdb.DuckDBPyConnection)
    assert differences(spark, con, queries.QUERIES[name], queries.ORACLES[name], SF) == ""


def test_random_pages_never_fail():
    rng = random.Random(4)
    bits = ["<div class='no-ad x'>", "<p>", "</p>", "</div>", "text here ", "<article>", "</article>", "<!--", "-->", "<nav id=menu>", "</nav>", "&amp;", "<", "<a href=x>", "</a>", "<div class='ad'>", "<table><tr><td>", "<svg/>"]
    for _ in range(300):
        html_text.main_text("".join(rng.choice(bits) for _ in range(rng.randint(1, 60))))
