"""The training-data operators against brute force, on small tables with nulls, empty and long texts, ties and repeated rows."""

import collections
import hashlib
import html
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import fingerprints, html_text, language, license, mixing, packing, ppm, quality, queries, simhash, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def texts(n=120, seed=7):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3)))
    base = [" ".join(word() for _ in range(rng.randint(1, 120))) for _ in range(n)]
    for i in range(0, n, 10):  # near copies
        w = base[i].split()
        base[i + 1] = " ".join([*w[: len(w) // 2], "changed", *w[len(w) // 2 + 1 :]])
    base[3], base[4], base[5] = base[2], "", " \t\n"
    base[6] = "É ü x 中文 字\x0bB\x1fC " * 5 + "\n\nline\nline\n"
    base[7] = " ".join(word() for _ in range(30_000))
    base[8] = "same same same " * 80
    base[9] = None
    return base


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 11 else None, t, ["en", "de", None][i % 3], ["a", "b", "c", None][i % 7 % 4], len(t or ""), "clash", 1.0) for i, t in enumerate(texts())]
    rows.append(rows[20])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, f string, mix_key double").repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def pairs(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


# --- HTML -------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href="/a">Menu one</a></li><li><a href="/b">Menu two</a></li></ul></nav>
<header><h2>Site name</h2></header><div class="ad">Buy this now, buy this now.</div><article><h1>Title &amp; more</h1><p><b>First   paragraph with
quite some text in it.<br><p>Second one is longer, and it goes on and on, &eacute; and &#233;.</p><p>Short.</p><div class="sidebar">Side text.</div><p>Last paragraph of the article, with <a href="/x">a link</a>.</p>
<section id="comments"><p>Reader: I think so too, and here is why, at length.</p></section></article><form><label>Name</label><input></form><aside>Related things to read.</aside><footer>&copy; someone</footer></body></html>"""
WANT = "Title & more\n\nFirst paragraph with quite some text in it.\n\nSecond one is longer, and it goes on and on, é and é.\n\nShort.\n\nLast paragraph of the article, with a link."


def test_html_article():
    assert html_text.main_text(PAGE) == WANT


def test_html_without_article():
    body = PAGE.replace("<article>", '<div class="content">').replace("</article>", "</div>")
    assert html_text.main_text(body) == WANT


@pytest.mark.parametrize("page", [None, "", "   ", "<html></html>", "<script>x</script>", "<nav>a b c</nav>", "<!-- x", "<p", "&", "<a href='x'>only a link</a>"])
def test_html_empty(page):
    assert html_text.main_text(page).strip() in ("", "&", "<p")


def test_html_long_and_odd():
    text = "word " * 40_000
    assert html_text.main_text(f"<p>{text}</p>") == text.strip()
    assert html_text.main_text("<p>a<b>b</p><p>c" * 2000).count("\n\n") > 3000
    assert html_text.main_text("<nav><li>x<li>y<article><p>Text after an unclosed menu.</p></article>") == "Text after an unclosed menu."


def test_html_query_keeps_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "old"), (1, "u", PAGE, "old"), (2, None, None, None), (None, "v", "", "")], "page_id long, url string, html string, text string")
    out = html_text.extract_main_text(pages).collect()
    assert sorted((r.page_id or 0, r.text) for r in out) == [(0, ""), (1, WANT), (1, WANT), (2, "")]
    assert html_text.extract_main_text(pages.limit(0)).count() == 0


def test_smoothing_and_threshold():
    assert html_text.smooth([1.0, 1.0, 1.0]) == pytest.approx([1, 1, 1])
    assert html_text.smooth([0, 0, 9, 0, 0])[2] < 9
    assert 1 < html_text.threshold([0, 1, 0, 9, 10, 11]) < 9


# --- mixing -----------------------------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    free, out, left = set(sizes), {}, float(sum(sizes.values()))
    while free:
        share = left / sum(w[s] for s in free)
        over = [s for s in free if share * w[s] > most * sizes[s]]
        if not over:
            out |= {s: share * w[s] for s in free}
            break
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


def test_mixing(docs):
    rows = mixing.mix_sources(docs).collect()
    again = mixing.mix_sources(docs.repartition(5)).collect()
    key = lambda r: (str(r.doc_id), r.text or "", r.copies)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    sizes = collections.Counter()
    for r in rows:
        assert r.mix_size == len(WORD.findall(r.text or "")) and 0 <= r.copies <= 3
        sizes[r.source] += r.mix_size
    want, taken, biggest = brute_targets(sizes), collections.Counter(), collections.Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        taken[r.source] += r.copies * r.mix_size
        biggest[r.source] = max(biggest[r.source], r.mix_size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= biggest[s]
    assert "f" in rows[0] and rows[0].f == "clash"


def test_mixing_by_ranges(docs, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 4)
    rows = mixing.mix_sources(docs).collect()
    taken = collections.Counter()
    for r in rows:
        taken[r.source] += r.copies * r.mix_size
        assert r.copies <= 3
    for r in rows:
        assert abs(taken[r.source] - r.target) <= 30_000


def test_mixing_prefers_quality(spark):
    rows = [(i, ("good words here " if i % 2 else "#$% *** 123 ") * 5, s) for i in range(400) for s in "ab"]
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).filter("source = 'b'")
    got = {r[0]: r[1] for r in out.groupBy((F.col("doc_id") % 2).alias("p")).agg(F.sum("copies")).collect()}
    assert got[1] > 1.3 * got[0]


def test_mixing_empty(none):
    assert mixing.mix_sources(none).count() == 0


# --- fingerprints -----------------------------------------------------------------------------------------------------


def shingles(text, k=5):
    w = WORD.findall(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(docs, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 10)
    rows = fingerprints.fingerprint_edits(docs).collect()
    every = sorted(pairs(docs), key=lambda x: (x[0] is None, -(x[0] or 0)))
    assert len(rows) == len(every)
    got = {(r.doc_id, r.n_chars): r for r in rows}
    errors = []
    for i, (doc, text) in enumerate(every):
        nxt = every[(i + 1) % len(every)]
        r = got[doc, len(text)]
        if doc == 20:
            continue  # the repeated row is its own next once
        edited = text[: len(text) - len(text) // 2] + nxt[1][: len(text) // 2]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.next_doc_id == nxt[0]
        errors += [r.near_edited - jaccard(text, edited), r.near_next - jaccard(text, nxt[1])]
    assert np.abs(errors).max() < 0.15 and abs(np.mean(errors)) < 0.02  # six standard errors of 512 bins
    by_text = collections.defaultdict(set)
    for r in rows:
        by_text[dict(every)[r.doc_id]].add(r.fingerprint)
    assert all(len(s) == 1 for s in by_text.values())


def test_fingerprint_edges(spark, none):
    assert fingerprints.fingerprint_edits(none).count() == 0
    one = spark.createDataFrame([(5, "a b c")], "doc_id long, text string")
    r = fingerprints.fingerprint_edits(one).first()
    assert (r.next_doc_id, r.near_next) == (5, 1.0)
    assert fingerprints.likeness_of("", "") == 1.0 and fingerprints.likeness_of("", "00") == 0.0
    both = spark.createDataFrame([("a b c d e f", "a b c d e f"), (None, "")], "x string, y string")
    out = both.select(fingerprints.fingerprint("x").alias("fx"), fingerprints.fingerprint("y").alias("fy")).select(fingerprints.likeness("fx", "fy").alias("l"))
    assert [r.l for r in out.collect()] == [1.0, 1.0]


# --- PPM --------------------------------------------------------------------------------------------------------------


def test_ppm_base_and_score(docs):
    out = {(r.doc_id, r.n_tokens): r for r in ppm.score_documents(docs, heavy=0.01).collect()}
    held = lambda d: zlib.crc32(str("null" if d is None else d).encode()) % 5 == 1
    c = collections.Counter()
    for d, t in pairs(docs):
        if not held(d):
            c.update([*WORD.findall(low(t)), "\0"])
    n, v = sum(c.values()), len(c)
    assert ppm.score_documents(docs).count() == docs.count()
    for d, t in pairs(docs):
        w = [*WORD.findall(low(t)), "\0"]
        r = out[d, len(w)]
        assert r.held_out == held(d) and r.train_tokens == n and r.n_known == sum(c[x] > 0 for x in w)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) and r.score < 0


def brute_levels(docs, order):
    """The trie by dictionaries: for each order the strings with their counts, and the counts of their contexts."""
    n, out = collections.Counter(), []
    for t in docs:
        data = b"\n" * order + b" ".join(low(t).encode().split()) + b"\n"
        for i in range(order, len(data)):
            n[data[i - order : i + 1]] += 1
    for _ in range(order, -1, -1):
        total = collections.Counter()
        for s, x in n.items():
            total[s[:-1]] += x
        out.insert(0, (n, total))
        n = collections.Counter(s[1:] for s in n)
    return out


def brute_odds(levels, context, byte):
    p, excluded = 1.0, set()
    for k in range(len(levels) - 1, -1, -1):
        kept, total = levels[k]
        ctx = context[len(context) - k :]
        mine = {s[-1]: x for s, x in kept.items() if s[:-1] == ctx}
        if not mine:
            continue
        rest = total[ctx] - sum(x for b, x in mine.items() if b in excluded)
        if byte in mine:
            return p * (mine[byte] - 0.5) / rest
        share = sum(x - 0.5 for b, x in mine.items() if b not in excluded)
        if rest > 0:
            p *= (rest - share) / rest
        excluded |= set(mine)
    return p / (256 - len(levels[0][0]))


@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_ppm_trie(spark, order, monkeypatch):
    monkeypatch.setattr(ppm, "BRANCHES", 20)
    some = ["the cat sat on the mat", "the dog sat on the log and then the cat", "a cat and a dog, and then the end", "ab ab ab ab abc abd", ""]
    other = ["the zebra sat on the mat, and then", "xyz é"]
    docs = spark.createDataFrame([(t, False) for t in some] + [(t, True) for t in other], "text string, held_out boolean")
    counted = ppm._string_counts(docs, order).cache()
    got = {r.key.to_bytes(order + 1): r for r in ppm.string_odds(counted, ppm.low_orders(counted, order), order).collect()}
    levels = brute_levels(some, order)
    met = brute_levels(some + other, order)[order][0]
    assert {k: r.met for k, r in got.items()} == met
    for s, r in got.items():
        assert r.log2 == pytest.approx(math.log2(brute_odds(levels, s[:-1], s[-1])), abs=1e-5)
    for context in (b"the", b" ca", b"xyz", b"\n\n\n", b"zab"):
        assert sum(brute_odds(levels, (b"\n\n" + context)[-order:], b) for b in range(256)) == pytest.approx(1.0)


@pytest.mark.parametrize("most", [1 << 20, 40, 0])
def test_ppm_scores_of_documents(docs, most):
    """Every document's score against the odds worked out byte by byte, however few of them are broadcast."""
    some = docs.filter("length(coalesce(text, '')) < 3000").limit(40).cache()
    held = lambda d: zlib.crc32(str("null" if d is None else d).encode()) % 5 == 1
    levels = brute_levels([t for d, t in pairs(some) if not held(d)], 5)
    want = collections.defaultdict(list)
    for d, t in pairs(some):
        data = b"\n" * 5 + b" ".join(low(t).encode().split()) + b"\n"
        want[d].append(sum(math.log10(brute_odds(levels, data[i - 5 : i], data[i])) for i in range(5, len(data))))
    got = collections.defaultdict(list)
    for r in ppm.score_documents(some, most_table=most).collect():
        got[r.doc_id].append(r.score)
    assert {*got} == {*want}
    for d in want:
        assert sorted(got[d]) == pytest.approx(sorted(want[d]), rel=1e-4)


def test_ppm_table():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 2**48, 5000, dtype=np.uint64))
    table = ppm.Table(keys[::2], np.arange(len(keys[::2]), dtype=np.float32)).build()
    found, missing = table.find(keys)
    assert found[::2].tolist() == list(range(len(keys[::2]))) and sorted(missing) == list(range(1, len(keys), 2))


def test_ppm_held_out(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 5)))  # noqa: E731  an open vocabulary
    docs = spark.createDataFrame([(i, " ".join(word() for _ in range(100))) for i in range(1500)], "doc_id long, text string")
    out = ppm.score_documents(docs).filter("held_out").agg(F.sum("score"), F.sum(F.col("n_tokens") - 1)).first()
    entropy = math.log10(5) + 3 * math.log10(len(SYLLABLES))  # of a word of one to five syllables
    assert -1.2 * entropy * out[1] < out[0] < -entropy * 0.95 * out[1]


def test_ppm_without_training(docs, none):
    out = ppm.score_documents(docs.limit(5), training=F.lit(False)).collect()
    assert len(out) == 5 and all(r.held_out and r.train_tokens == 0 for r in out)
    assert ppm.score_documents(none).count() == 0


# --- packing ----------------------------------------------------------------------------------------------------------


def brute_first_fit(sizes, capacity):
    room, out = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        b = next((j for j, r in enumerate(room) if r >= sizes[i]), len(room))
        if b == len(room):
            room.append(capacity)
        room[b] -= sizes[i]
        out[i] = b
    return out


@pytest.mark.parametrize("seed", range(5))
def test_first_fit(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 100) for _ in range(rng.randint(0, 300))]
    bins, offsets = packing.first_fit_decreasing(sizes, 100)
    assert bins == brute_first_fit(sizes, 100)
    for b in set(bins):
        at = sorted((offsets[i], sizes[i]) for i in range(len(sizes)) if bins[i] == b)
        assert [a for a, _ in at] == list(np.cumsum([0, *[n for _, n in at[:-1]]]))


def test_packing(docs, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    rows = packing.pack_documents(docs, queries.tokenizer_path(), group_rows=30).collect()
    want = collections.Counter()
    for d, t in pairs(docs):
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4")
        for at in range(0, len(ids), 2048):
            want[d, at, min(2048, len(ids) - at), zlib.crc32(ids[at : at + 2048].tobytes()), len(ids)] += 1
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        pieces.sort()
        assert [o for o, _ in pieces] == list(np.cumsum([0, *[n for _, n in pieces[:-1]]])) and sum(n for _, n in pieces) <= 2048
    assert packing.pack_documents(none, queries.tokenizer_path()).count() == 0


def test_chunked_ids_are_whole_ids():
    import pyarrow as pa

    path = queries.tokenizer_path()
    fast, slow = packing.Tokenizer(path), packing.Tokenizer(path, apart=False)
    odd = ["word, word. word.. don't 's' ª. º, x) ß! 5. .5 ., 'll 're: it's.", "It's we'LL 'tis 12ab\tx  y", "É İSTANBUL ΣΑΣ. é ﬁ", "<|endoftext|> a<|endoftext|>b", "tab\tthere\r\nx\x1cy\x00z", "", " ", "日本語 テスト。", "a" * 3000, "".join(map(chr, range(33, 256))), "ÀÉþ×÷ÿ ß²³ ½x ª© naïve,É. «quoted» µm 5º", "".join(chr(c) + "x" for c in range(160, 600)), "~!@#$%^&*()_+{}|:\"<>?`-=[]\;',./"]
    for a, b in zip(fast.ids(pa.array(odd)), slow.ids(pa.array(odd)), strict=True):
        assert a.tolist() == b.tolist()


# --- language ---------------------------------------------------------------------------------------------------------


def labelled(spark):
    rng = random.Random(1)
    kinds = {"en": ["the", "and", "with", "house", "that"], "de": ["der", "und", "mit", "haus", "nicht"], "fr": ["le", "et", "avec", "maison", "pas"]}
    rows = [(i, " ".join(rng.choice(kinds[k]) for _ in range(40)), k, f"s{i % 4}") for i in range(300) for k in [list(kinds)[i % 3]]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_language_pages(spark):
    pages = [
        (1, "http://x.de/a", "<html lang='de'><body><p>der und mit haus nicht der und</p>"),
        (2, "http://x.de/b", "<html lang='en'><body><p>der und mit haus nicht der und mit nicht haus der</p>"),
        (3, "http://x.de/c", "<html lang='de'><body><p>der</p>"),
        (4, None, None),
        (5, "nonsense", ""),
        (6, "https://www.y.com/?q=1", "<p>the and with house that the and"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    out = {r.page_id: r for r in language.identify_pages(df, labelled(spark)).collect()}
    assert [out[i].language for i in (1, 2, 3, 4, 5, 6)] == ["de", "de", "de", None, None, "en"]
    assert out[6].host == "y.com" and all(0 <= r.posterior <= 1 for r in out.values())
    assert language.identify_pages(df.limit(0), labelled(spark)).count() == 0


def test_language_keeps_clean(spark):
    df = labelled(spark)
    odd = spark.createDataFrame([(1000, "12345 67890 !!!", "en", "s1"), (1001, None, "de", None), (1002, "", None, "s2")], df.schema)
    out = language.keep_identified(df.unionByName(odd))
    assert sorted(r.doc_id for r in out.collect()) == list(range(300)) and out.columns == df.columns
    assert language.keep_identified(df.limit(0)).count() == 0


# --- licences ---------------------------------------------------------------------------------------------------------


def test_licenses_against_all_templates():
    scanner = license.Scanner(license.TEMPLATES, 0.8)
    units = [t for ts in license.TEMPLATES.values() for t in ts] + [t.replace("License", "license").replace(",", "") for ts in license.TEMPLATES.values() for t in ts] + ["licensed under the", "no licence here at all", "", "x"]
    for unit in units:
        g = license.bigrams(unit)
        found = [(license.dice(g, license.bigrams(t)), name) for name, ts in license.TEMPLATES.items() for t in ts]
        best = min(((-d, n) for d, n in found if d >= 0.8), default=None)
        assert scanner.match(unit) == (best and (-best[0], best[1]))


def test_license_scan(spark):
    mit = license.TEMPLATES["MIT"][2]
    rows = [(1, "some text\nReleased under the MIT License.\nmore"), (2, None), (3, ""), (4, "intro\n\n" + re.sub(r"(\S+ \S+ \S+) ", r"\1\n", mit) + "\n\nend"), (1, "some text\nReleased under the MIT License.\nmore")]
    out = license.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter((r.doc_id, r.license, r.unit) for r in out)[1, "MIT", "line"] == 2
    assert (4, "MIT", "paragraph") in {(r.doc_id, r.license, r.unit) for r in out}


# --- WARC -------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    big, trap = "x" * 1500 + "é", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 40
    rows = [(1, "http://a", big), (2, "http://b", big), (3, "http://c\r\nWARC-Type: evil", big), (4, None, "small"), (5, "u", "small"), (6, "v", None), (7, "w", trap), (8, "w", trap), (9, "w", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = f"file://{tmp_path}/archive"
    warc.archive_pages(pages.repartition(3), path)
    out = {r.page_id: r for r in warc.page_records(warc.read_warc(spark, path)).collect()}
    assert len(out) == 9
    for i, url, text in rows:
        data, r = (text or "").encode(), out[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        back = {1: 3, 2: 3, 7: 8}.get(i)
        assert (r.record_type, r.refers_to) == (("revisit", back) if back else ("response", None))
    assert out[3].target_uri.startswith("http://c") and out[4].target_uri is None
    only = warc.read_warc(spark, path).filter("record_type = 'revisit'")
    assert only.count() == 3 and "revisit" in only._jdf.queryExecution().toString()
    assert warc.read_warc(spark, path, payload=False).filter("payload is not null").count() == 0
    warc.archive_pages(pages.limit(0), path)
    assert warc.read_warc(spark, path).count() == 0


def test_warc_members_and_pushdown(tmp_path):
    import gzip

    record = lambda i, kind, body: f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{i}>\r\nX-Long: a\r\n b\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    many = [record(i, "resource" if i % 2 else "metadata", bytes([65 + i % 26]) * (i * 7001)) for i in range(30)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(m) for m in many))
    (tmp_path / "b.warc").write_bytes(b"".join(many))
    reader = warc.WarcReader({"path": str(tmp_path)})
    assert list(reader.pushFilters([warc.EqualTo(("record_type",), "resource"), warc.EqualTo(("payload_bytes",), 3)])) == [warc.EqualTo(("payload_bytes",), 3)]
    rows = [r for part in reader.partitions() for r in reader.read(part)]
    assert len(rows) == 30 and all(len(r[8]) == r[6] and r[7]["x-long"] == "a b" for r in rows)


# --- quality ----------------------------------------------------------------------------------------------------------


def brute_counts(t):
    w, seen, dup = WORD.findall(t), set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_quality_counts(docs):
    out = quality.judge(docs).collect()
    assert len(out) == docs.count()
    want = collections.Counter((d, *brute_counts(t)) for d, t in pairs(docs))
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out) == want
    for r in out:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)


def test_label_model_recovers_classes():
    rng = np.random.default_rng(5)
    m, n = 8, 4000
    good = rng.random(n) < 0.8
    accuracy = np.where(good[:, None], [0.02, 0.3, 0.68], [0.5, 0.3, 0.2]).reshape(n, 3)
    votes = np.array([[rng.choice(3, p=accuracy[i]) for _ in range(m)] for i in range(n)])
    patterns, counts = np.unique((votes * 3 ** np.arange(m)).sum(axis=1), return_counts=True)
    model = quality.LabelModel(m).fit(patterns, counts.astype(float))
    q = model.posterior((votes * 3 ** np.arange(m)).sum(axis=1))
    assert ((q >= 0.5) == good).mean() > 0.95 and abs(model.prior - 0.8) < 0.05


def test_quality_keeps_clean_and_drops_junk(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3)))
    clean = [(i, " ".join(word() for _ in range(200)), "x") for i in range(300)]
    junk = [(1000 + i, " ".join(word() + "###" for _ in range(200)), "y") for i in range(30)]
    df = spark.createDataFrame([*clean, *junk, (2000, None, "z")], "doc_id long, text string, note string")
    assert sorted(r.doc_id for r in quality.keep_good(df).collect()) == list(range(300))
    assert sorted(r.doc_id for r in quality.judge(df).filter("kept").collect()) == list(range(300))
    assert quality.judge(df.limit(0)).count() == 0 and quality.keep_good(df.limit(0)).columns == df.columns


# --- SimHash ----------------------------------------------------------------------------------------------------------


def brute_fingerprint(t):
    w = WORD.findall(low(t))
    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64)) if h else 0


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in nodes}


def test_masks_cover():
    rng = random.Random(0)
    for shift in (0, 7):
        ms = [m % 2**64 for m in simhash.masks(4, shift)]
        assert len(ms) == 31
        for _ in range(3000):
            d = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
            assert any(d & m == 0 for m in ms)


@pytest.mark.parametrize("bucket", [20_000, 3])
def test_simhash(docs, bucket, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    monkeypatch.setattr(simhash.near_links, "__defaults__", (4, bucket))
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    f = {d: brute_fingerprint(t) for d, t in pairs(docs)}
    assert all(r.f % 2**64 == f[r.doc_id] for r in rows)
    named = {d: x for d, x in f.items() if d is not None}
    want = components(list(named), lambda a, b: bin(named[a] ^ named[b]).count("1") <= 4)
    assert all(r.component_id == want[r.doc_id] for r in rows if r.doc_id is not None)
    assert [r.component_id for r in rows if r.doc_id is None] == [min((d for d in named if bin(named[d] ^ f[None]).count("1") <= 4), default=None)]


def test_simhash_chains(spark):
    """A dense cloud and long chains of fingerprints, through the links alone."""
    rng = random.Random(9)
    fs = {0}
    for _ in range(400):
        fs.add(rng.choice(sorted(fs)) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    x = rng.getrandbits(64)
    for i in range(60):
        x ^= 1 << i
        fs.add(x)
    signed = lambda v: v - 2**64 if v >> 63 else v
    df = spark.createDataFrame([(signed(v),) for v in fs], "f long")
    for bucket in (20_000, 10):
        links = [(r.u % 2**64, r.v % 2**64) for r in simhash.near_links(df, 4, bucket).collect()]
        assert all(a in fs and b in fs and a != b for a, b in links)
        have = set(map(frozenset, links))
        got = components(sorted(fs), lambda a, b: frozenset((a, b)) in have)
        assert got == components(sorted(fs), lambda a, b: bin(a ^ b).count("1") <= 4)


def test_keep_one(docs, none):
    kept = [r.doc_id for r in simhash.keep_one(docs).collect()]
    want = {r.component_id for r in simhash.near_duplicates(docs).filter("doc_id is not null").collect()}
    assert sorted(k for k in kept if k is not None) == sorted(want) and kept.count(None) == 1
    assert simhash.keep_one(none).count() == 0


def test_html_unescape_matches_blocks():
    text = "&lt;b&gt; &amp; &nbsp;x&#x41;"
    assert html_text.main_text(f"<p>{text}</p>") == " ".join(html.unescape(text).split())
