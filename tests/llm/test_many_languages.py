"""Every declared language has a model, and a table that declares none loses nothing."""

import random

from test_llm_operators import labelled
from pyspark.sql import functions as F

from tessera.llm import language


def test_seventy_languages(spark):
    rng = random.Random(2)
    names = [chr(97 + i // 26) + chr(97 + i % 26) for i in range(70)]
    words = {k: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(8)] for k in names}
    text = lambda k: " ".join(rng.choice(words[k]) for _ in range(40))
    df = spark.createDataFrame([(text(k), k) for k in names for _ in range(3)], "text string, lang string")
    model = language.fit_trigrams(df)
    assert model.languages == names and model.log_p.size <= language.MOST_CELLS
    pages = spark.createDataFrame([(i, None, f"<p>{text(k)}</p>") for i, k in enumerate(names)], "page_id long, url string, html string")
    assert {r.page_id: r.language for r in language.identify_pages(pages, df).collect()} == dict(enumerate(names))


def test_no_language_declared(spark):
    df = labelled(spark).withColumn("lang", F.lit(None).cast("string"))
    assert language.keep_identified(df).count() == 300
