"""Near copies against brute force, and that none of them reaches the pipeline's sequences."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_operators import components, jaccard, low

import corpus_pipeline
from tessera.llm import copies


def varied(n=150, seed=5):
    """Texts of which many are within 0.6 to 1 of another, in chains too."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = out[rng.randrange(len(out))].split() if i % 5 and out else [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 200))]
        for _ in range(rng.randint(0, 3) if i % 5 else 0):
            w[rng.randrange(len(w))] = f"new{rng.randrange(5000)}"
        out.append(" ".join(w))
    return [*out, "", " \n", None, "three words only", "Three WORDS only", out[0].upper()]


def groups_of(texts):
    return components(list(range(len(texts))), lambda a, b: jaccard(low(texts[a] or ""), low(texts[b] or "")) >= 0.8)


def test_grow():
    rng = np.random.default_rng(1)
    base = [np.unique(rng.integers(0, 400, 60)).astype(np.uint64) for _ in range(8)]
    sets = [np.unique(np.append(rng.choice(b, len(b) - rng.integers(0, 9), replace=False), rng.integers(1000, 9999, rng.integers(0, 6)))).astype(np.uint64) for b in base for _ in range(12)]
    like = lambda a, b: len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) >= 0.8
    have = set(map(frozenset, copies.grow(sets)))
    assert components(list(range(len(sets))), lambda a, b: frozenset((a, b)) in have) == components(list(range(len(sets))), like)


@pytest.mark.parametrize("bucket_bytes", [copies.BUCKET_BYTES, 3000])
def test_keep_unlike(spark, bucket_bytes, monkeypatch):
    monkeypatch.setattr(copies.copy_links, "__defaults__", (0.8, bucket_bytes))
    texts = varied()
    rows = [(i, t) for i, t in enumerate(texts)] + [(20, texts[20]), (20, "another text under an id that is taken"), (None, texts[20])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [(r.doc_id, r.text) for r in copies.keep_unlike(df).collect()]
    want = [(i, texts[i]) for i in set(groups_of(texts).values())] + [(20, "another text under an id that is taken"), (None, texts[20])]
    assert sorted(kept, key=str) == sorted(want, key=str)
    assert copies.keep_unlike(df.limit(0)).count() == 0


def test_pipeline_has_no_near_copies(spark):
    """1 and 177 of the table are 0.83 alike, at a distance of nine bits."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter(F.col("doc_id").isin(1, 177))
    stages = dict(corpus_pipeline.STAGES)
    one = stages["simhash_dedup"](spark, docs, "")
    assert {r.doc_id for r in stages["mixing"](spark, one, "").collect()} == {1}
