"""A declared language counts wherever in the page its tag stands."""

from test_llm_operators import labelled

from tessera.llm import language


def test_declared_after_long_text(spark):
    body = "<body><p>der und mit haus nicht der und</p>"
    pages = [
        (1, "http://x.de/a", f"<!-- {'licence banner ' * 1000} --><html lang='de'>{body}"),
        (2, "http://x.de/b", f"<html data-x='{'y' * 9000}' lang=\"DE\">{body}"),
        (3, "http://x.de/c", f"{' ' * 20000}\n<HTML\nlang=de>{body}"),
        (4, "http://x.de/d", f"{'<!-- x -->' * 3000}{body}"),
        (5, "http://x.de/e", "<html " * 20000),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    out = {r.page_id: r.declared for r in language.identify_pages(df, labelled(spark)).collect()}
    assert out == {1: "de", 2: "de", 3: "de", 4: None, 5: None}
