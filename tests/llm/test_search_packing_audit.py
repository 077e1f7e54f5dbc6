"""Ranked search, best-fit packing and the audit of sources against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from oracle import connect, differences
from pyspark.sql import functions as F
from test_llm_operators import low, texts

from tessera.llm import bestfit, divergence, packing, queries, ranked

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
CLASH = "item item_id terms tfs n m score rank part query term p p0 q held number t df lang_n total kept block side tie nth length start bucket step first last per_bin offset sequence_id value a b".split()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 11 else None, t, ["en", "de", None][i % 3], ["a", "b", "c", None][i % 7 % 4]) for i, t in enumerate(texts())]
    rows += [rows[20], rows[20], (500, "tie one", "en", "a"), (501, "tie one", "en", "a"), (502, None, "xx", "z"), (503, "?! 12", "xx", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).cache()


def clashing(df):
    return df.select("*", *[F.lit(f"own {n}").alias(n) for n in CLASH if n not in df.columns])


# --- search -----------------------------------------------------------------------------------------------------------


def brute_search(docs, asked, k=10):
    held = [(d, collections.Counter(TERM.findall(low(t or "")))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in asked:
        found = []
        for d, c, n in held:
            m = 10 + 90 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(TERM.findall(low(text or ""))) if t in c)
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(found)[:k])]
    return sorted(map(str, out))


@pytest.fixture(scope="module")
def asked(spark, docs):
    some = [r.text for r in docs.filter("text is not null").orderBy("doc_id").collect()]
    rows = [(i, " ".join(t.split()[:30]).upper()) for i, t in enumerate(some[:40])]
    return spark.createDataFrame([*rows, rows[0], (900, None), (901, ""), (902, "nothing here zzzz"), (903, "tie"), (904, "THE ﬁ same É")], "item_id long, text string")


@pytest.mark.parametrize(("pairs", "postings"), [(1 << 20, 1 << 20), (100, 50)])
def test_search(docs, asked, pairs, postings):
    got = ranked.search(clashing(docs), asked, block_pairs=pairs, shard_postings=postings).collect()
    want = brute_search([(r.doc_id, r.text) for r in docs.collect()], sorted({(r.item_id, r.text) for r in asked.collect()}, key=str))
    assert sorted(str((r.item_id, r["rank"], r.doc_id, r.score)) for r in got) == want


def test_search_empty(docs, asked):
    assert ranked.search(docs.limit(0), asked).count() == 0 and ranked.search(docs, asked.limit(0)).count() == 0


def test_the_threshold_stops_a_search_early():
    """One list falls steeply: after the first round nothing unseen can pass the tenth."""
    n = 4096
    terms, tfs = np.zeros(n, np.int64), np.where(np.arange(n) < 32, 100, 1).astype(np.int64)
    shard = ranked.Shard(np.arange(n), np.full(n, 100), np.ones(n, np.int64), terms, tfs, np.array([1000]))
    looked, plain = [], shard.scores
    shard.scores = lambda docs, wanted: looked.append(len(docs)) or plain(docs, wanted)
    scores, ids = shard.top(np.array([0]), 10, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    assert looked == [ranked.FIRST_DEPTH] and ids.tolist() == list(range(10)) and len(set(scores.tolist())) == 1


# --- packing ----------------------------------------------------------------------------------------------------------


def brute_best_fit(sizes, capacity):
    free = []
    for s in sorted(sizes, reverse=True):
        fits = [(f, i) for i, f in enumerate(free) if f >= s]
        if fits:
            free[min(fits)[1]] -= s
        else:
            free.append(capacity - s)
    return len(free)


@pytest.mark.parametrize("seed", range(12))
def test_the_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 100])
    sizes = [rng.randint(1, rng.choice([3, capacity // 2, capacity])) for _ in range(rng.randint(0, 400))]
    histogram = collections.Counter(sizes)
    bins = collections.defaultdict(list)
    ranks = collections.defaultdict(list)
    for size, first, last, per_bin, sequence, offset in bestfit.plan(histogram, capacity):
        for r in range(first, last + 1):
            bins[sequence + (r - first) // per_bin].append((offset + (r - first) % per_bin * size, size))
            ranks[size].append(r)
    assert {s: sorted(r) for s, r in ranks.items()} == {s: list(range(n)) for s, n in histogram.items()}
    for held in bins.values():
        at = 0
        for offset, size in sorted(held):
            assert offset == at
            at += size
        assert at <= capacity
    assert sorted(bins) == list(range(brute_best_fit(sizes, capacity)))


@pytest.mark.parametrize(("length", "bucket"), [(4096, 2048), (50, 3)])
def test_best_fit_packing(docs, length, bucket, monkeypatch):
    monkeypatch.setattr(bestfit, "STEP", 4)
    tok = packing.Tokenizer(queries.tokenizer_path(), apart=False)
    rows = bestfit.pack_best_fit(clashing(docs), queries.tokenizer_path(), length, bucket_rows=bucket).collect()
    want = collections.Counter()
    for r in docs.collect():
        ids = np.append(tok.ids(pa.array([r.text], pa.string()))[0], 1).astype("<u4")
        want.update((r.doc_id, at // length, at, min(length, len(ids) - at), zlib.crc32(ids[at : at + length].tobytes())) for at in range(0, len(ids), length))
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= length
    assert len(bins) == brute_best_fit([r.length for r in rows], length)


def test_best_fit_empty(docs):
    assert bestfit.pack_best_fit(docs.limit(0), queries.tokenizer_path()).count() == 0


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_those_of_the_library_for_either_file(file):
    import tokenizers

    path = queries.tokenizer_path(file)
    odd = ["Hello world", "  two  spaces ", "don't 's' ª. º, x) ß! 5. .5", "It's we'LL 'tis 12ab\tx  y", "É İSTANBUL ΣΑΣ. é ﬁ", "tab\tthere\r\nx\x1cy\x00z", "", " ", "\n\n", "日本語 テスト", "a" * 300, "x_y-z", "é é", "1 23 456", "(a)[b]{c}", "…—–", " nbsp", "ǅ Ǆ", "🙂 smile", "﻿bom"]
    own, library = packing.Tokenizer(path), tokenizers.Tokenizer.from_file(path)
    assert [x.tolist() for x in own.ids(pa.array(odd))] == [library.encode(t, add_special_tokens=False).ids for t in odd]


# --- audit ------------------------------------------------------------------------------------------------------------


def brute_audit(docs, least=30, top=50):
    held, every = collections.defaultdict(collections.Counter), collections.defaultdict(set)
    df = collections.defaultdict(collections.Counter)
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        every[lang].add(source)
        found = collections.Counter(LETTERS.findall(low(text or "")))
        held[lang, source].update(found)
        df[lang].update(set(found))
    out = []
    for lang, sources in every.items():
        kept = sorted(t for t, n in df[lang].items() if n >= least)
        v = len(kept)
        whole = sum((held[lang, s] for s in sources), collections.Counter())
        share = lambda c, kept=kept, v=v: {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * v) for t in kept}
        p, q = {s: share(held[lang, s]) for s in sources}, share(whole)
        for s in sources:
            near = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            out += [(lang, s, "pair", o.decode(), -f, i + 1) for i, (f, o) in enumerate(near)]
            far = sorted((q[t] - p[s][t], t.encode()) for t in kept if held[lang, s][t] and p[s][t] > q[t])
            out += [(lang, s, "term", t.decode(), -f, i + 1) for i, (f, t) in enumerate(far[:top])]
    return sorted(out)


@pytest.mark.parametrize(("light", "sizes"), [(0, (4, 1, 3, 1)), (2, (3, 2, 2, 2)), (8, (1024, 128, 8192, 64))])
@pytest.mark.parametrize("least", [3, 30, 1000])
def test_audit(docs, light, sizes, least, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_ROWS", 200)
    if light < 8:
        for f, names in ((divergence.dense_pairs, ("tile_terms", "tile_groups")), (divergence.posting_pairs, ("posting_terms",)), (divergence.share_pairs, ("share_groups",))):
            of = {"tile_terms": sizes[0], "tile_groups": sizes[1], "posting_terms": sizes[2], "share_groups": sizes[3]}
            monkeypatch.setattr(divergence, f.__name__, lambda *a, f=f, kw={n: of[n] for n in names}: f(*a, **kw))
    got = divergence.audit_sources(clashing(docs), least, light=light).collect()
    assert sorted(tuple(r) for r in got) == brute_audit([(r.lang, r.source, r.text) for r in docs.collect()], least)


def test_audit_without_the_sieve(docs, monkeypatch):
    monkeypatch.setattr(divergence, "MOST_HASHES", 1)
    assert divergence.often_held(docs.select("text"), 3, 1) is None
    want = brute_audit([(r.lang, r.source, r.text) for r in docs.collect()], 3)
    monkeypatch.setattr(divergence, "often_held", lambda *_: None)
    assert sorted(tuple(r) for r in divergence.audit_sources(docs, 3).collect()) == want


def test_audit_empty(docs):
    assert divergence.audit_sources(docs.limit(0)).count() == 0


def test_shares_beyond_64_bits(spark):
    df = spark.createDataFrame([(9_000_000_000 + i, 90_000_000_000 + 7 * i, 11 + i) for i in range(-2, 3)], "n long, of long, v long")
    for r in df.select("*", divergence.share("n", "of", "v").alias("p")).collect():
        assert r.p == 1 + 1_000_000_000 * (r.n + 5) // (r.of + 5 * r.v)


@pytest.mark.parametrize("name", ["op11_ranked_search", "op13_source_audit"])
def test_against_sql(spark, name):
    assert differences(spark, connect(SF), queries.QUERIES[name], queries.ORACLES[name], SF) == ""
