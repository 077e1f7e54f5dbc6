"""No column of the documents can clash with what an operator or a stage adds, and each stage takes nulls, repeats and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import copies, fingerprints, html_text, language, license, mixing, packing, ppm, quality, queries, simhash, warc
from tessera.llm.text import packed

corpus_pipeline = pytest.importorskip("corpus_pipeline")

#: Every name that the operators give a column on the way.
NAMES = """row f e p best host suffix declared log_text fit own log_own counts suffix_share language posterior text_fit pattern quality n_words word_chars kept base_failed th node size bands n key t c
component component_id least first stays doc kept_id mix_size mix_source mix_key w source_size target copies budget rate epochs full_below ranges range base last_key gap_key gap sum words end level stops
cap weight copy tie nth start length group sequence_id offset k foreign place token main held_out score counted tessera_id tessera_th tessera_f tessera_p tessera_e payload page block value dice license""".split()


def some(spark):
    rng = random.Random(5)
    text = lambda: " ".join("".join(rng.choice("th er on an re he in ed".split()) for _ in range(rng.randint(1, 4))) for _ in range(130))
    rows = [(i, text(), "en", ["a", "b", None][i % 3], 1) for i in range(30)]
    rows += [rows[3], (40, None, "en", "a", 1), (41, "", None, "b", 1), (None, rows[5][1] + " more", "en", None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def plain(spark):
    return some(spark).cache()


@pytest.fixture(scope="module")
def clashing(plain):
    return plain.select("*", *[F.lit(f"own {n}").alias(n) for n in NAMES]).cache()


@pytest.fixture(scope="module")
def pages(plain):
    return plain.select(F.col("doc_id").alias("page_id"), F.lit("http://x.example/a").alias("url"), F.concat(F.lit("<p>"), "text").alias("html"))


OPERATORS = {
    "op2": mixing.mix_sources, "take": mixing.take, "op3": fingerprints.fingerprint_edits, "op4": ppm.score_documents, "op5": lambda d: packing.pack_documents(d, queries.tokenizer_path()), "op7": license.scan_licenses,
    "op9": quality.judge, "keep_good": quality.keep_good, "keep_identified": language.keep_identified, "op10": simhash.near_duplicates, "keep_one": simhash.keep_one, "keep_unlike": copies.keep_unlike,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_take_any_names(plain, clashing, name):
    want, got = OPERATORS[name](plain), OPERATORS[name](clashing)
    shared = [c for c in want.columns if c not in ("sequence_id", "offset")]
    assert sorted(map(str, got.select(*shared).collect())) == sorted(map(str, want.select(*shared).collect()))
    if name in ("take", "keep_good", "keep_identified", "keep_one", "keep_unlike"):
        assert got.columns == clashing.columns and got.filter(" or ".join(f"`{n}` <> 'own {n}'" for n in NAMES)).count() == 0
    if name == "op2":
        assert {*NAMES} <= {*got.columns} and got.filter("budget <> 'own budget' or rate <> 'own rate'").count() == 0


def test_page_operators_take_any_names(spark, pages, plain, tmp_path):
    more = pages.select("*", *[F.lit(f"own {n}").alias(n) for n in NAMES])
    assert html_text.extract_main_text(more).filter("f <> 'own f' or row <> 'own row'").count() == 0
    assert sorted(map(str, language.identify_pages(more, plain).collect())) == sorted(map(str, language.identify_pages(pages, plain).collect()))
    warc.archive_pages(more, str(tmp_path / "w"))
    assert warc.read_warc(spark, str(tmp_path / "w")).count() == pages.count()


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages(spark, plain, clashing, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    got, want = run(spark, clashing, ""), run(spark, plain, "")
    ids = lambda df: sorted((r[0] is None, r[0] or 0) for r in df.select("doc_id").collect())
    assert ids(got) == ids(want)
    assert stage == "packing" or (got.columns == clashing.columns and want.columns == plain.columns)
    none = run(spark, plain.limit(0), "")
    assert none.count() == 0 and none.columns == want.columns


def test_stage_results(spark, plain):
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(r.doc_id if r.doc_id is not None else -1 for r in df.select("doc_id").collect())
    assert ids(stages["quality_rules"](spark, plain, "")) == sorted([-1, 3, *range(30)])
    one = ids(stages["simhash_dedup"](spark, plain, ""))
    assert -1 in one and one.count(3) <= 1 and {40, 41} & {*one} == {40}
    two = spark.createDataFrame([(1, "a b c d e f g"), (1, "x y z u v w q r"), (2, "a b c d e f g")], "doc_id long, text string")
    assert sorted(tuple(r) for r in simhash.keep_one(two).collect()) == [(1, "a b c d e f g"), (1, "x y z u v w q r")]


def test_packed_gives_the_rows_back(clashing):
    assert packed(clashing, "text").select("row.*").schema == clashing.schema
