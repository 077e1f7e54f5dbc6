"""The pipeline stage by stage against brute force on a small table."""

import pytest

pytest.importorskip("corpus_pipeline")

import corpus_pipeline  # noqa: E402
from test_llm_operators import brute_counts, brute_fingerprint, components  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    by_id = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "language_id", "simhash_dedup", "mixing", "packing"]
    good = stages["quality_rules"](spark, docs, SF)
    assert good.columns == columns
    ids = {r.doc_id for r in good.collect()}
    for i, r in by_id.items():
        n, _, symbols, _, repeat = brute_counts(r.text)
        if n < 50 or 100 * repeat > 50 * n:
            assert i not in ids
        elif symbols == 0 and not r.text.isupper() and repeat < 0.1 * n:
            assert i in ids or n < 100
    spoken = stages["language_id"](spark, good, SF)
    assert spoken.columns == columns
    kept = {r.doc_id: r.text for r in spoken.collect()}
    assert set(kept) == ids
    f = {i: brute_fingerprint(t) for i, t in kept.items()}
    roots = set(components(sorted(f), lambda a, b: bin(f[a] ^ f[b]).count("1") <= 4).values())
    one = stages["simhash_dedup"](spark, spoken, SF)
    assert one.columns == columns and sorted(r.doc_id for r in one.collect()) == sorted(roots)
    mixed = stages["mixing"](spark, one, SF)
    assert mixed.columns == columns
    copies = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert set(copies) <= roots and max(copies.values()) <= 3
    packed = stages["packing"](spark, mixed, SF)
    assert {r.doc_id: r["count"] for r in packed.filter("start = 0").groupBy("doc_id").count().collect()} == copies


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
