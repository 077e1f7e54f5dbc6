"""Full-text, vector and line search."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog.registry import query
from tessera.operators import tables, textsearch
from tessera.sources import adapter


def _docs(spark, sf_dir):
    return adapter.table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id")


BM = {
    "words": "select doc_id as id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as ws from documents",
    "counts": "select id, len(ws) as length, len(list_filter(ws, lambda x: x = 'licensed')) as f0, len(list_filter(ws, lambda x: x = 'license')) as f1 from words",
    "facts": "select count(*) as n, avg(length) as mean, count(*) filter (f0 > 0) as d0, count(*) filter (f1 > 0) as d1 from counts",
}
BM_SQL = """select id, round(greatest(ln((n - d0 + 0.5e0) / (d0 + 0.5e0)), 0e0) * f0 * 2.2e0 / (f0 + 1.2e0 * (0.25e0 + 0.75e0 * length / mean)) + greatest(ln((n - d1 + 0.5e0) / (d1 + 0.5e0)), 0e0) * f1 * 2.2e0 / (f1 + 1.2e0 * (0.25e0 + 0.75e0 * length / mean)), 6) as score
  from counts, facts where f0 > 0 and f1 > 0 order by score desc, id limit 20"""


@query("v01_bm25", BM_SQL, BM)
def v01_bm25(spark, sf_dir):
    return textsearch.bm25(_docs(spark, sf_dir), ["licensed", "license"])


@query("v01_postings", "select term, count(distinct id) as df, count(*) as total from (select id, unnest(ws) as term from words) x group by term order by total desc, term limit 100", BM)
def v01_postings(spark, sf_dir):
    p = textsearch.postings(_docs(spark, sf_dir))
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).orderBy(F.desc("total"), "term").limit(100)


LINES = "select id, cast(i as int) as line, parts[i] as body from (select doc_id as id, string_split(text, chr(10)) as parts, unnest(generate_series(1, len(string_split(text, chr(10))))) as i from documents) x"


@query("v02_grep_literal", "select id, line, left(trim(body), 200) as text from lines where contains(lower(body), 'licensed under') order by id, line limit 50", {"lines": LINES})
@query("o11_grep_first", "select id, line, left(trim(body), 200) as text from lines where contains(lower(body), 'licensed under') order by id, line limit 50", {"lines": LINES})
def v02_grep_literal(spark, sf_dir):
    return textsearch.grep(_docs(spark, sf_dir), "licensed under")


@query("v02_grep_regex", "select id, line, left(trim(body), 200) as text from lines where regexp_matches(body, '(?i)token = \"[0-9a-f]{8}') order by id, line limit 50", {"lines": LINES})
def v02_grep_regex(spark, sf_dir):
    return textsearch.grep(_docs(spark, sf_dir), 'token = "[0-9a-f]{8}', regex=True)


#: Symbols as what is searched: name, path and kind.
SYMBOL_WORDS = {
    "words": "select id, list_filter(regexp_split_to_array(lower(name || ' ' || file_path || ' ' || kind), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as ws from symbols",
    "counts": "select id, len(ws) as length, len(list_filter(ws, lambda x: x = 'class')) as f0, len(list_filter(ws, lambda x: x = 'machinery')) as f1 from words",
    "facts": BM["facts"],
}


def _symbol_texts(spark, sf_dir):
    return adapter.symbols(spark, sf_dir).select("id", F.concat_ws(" ", "name", "file_path", "kind").alias("text"))


@query("v01_symbol_search", BM_SQL, SYMBOL_WORDS)
def v01_symbol_search(spark, sf_dir):
    return textsearch.bm25(_symbol_texts(spark, sf_dir), ["class", "machinery"])


@query("v09_semantic_search", f"select h.id, h.score, s.kind, s.file_path from ({BM_SQL}) h join symbols s on s.id = h.id", SYMBOL_WORDS)
def v09_semantic_search(spark, sf_dir):
    """The tool's answer: the index alone, with kind and file of each hit."""
    return v01_symbol_search(spark, sf_dir).join(adapter.symbols(spark, sf_dir).select("id", "kind", "file_path"), "id")


@query("j02_index_hits", "select p.id, p.tf, s.name, s.kind from (select id, count(*) as tf from (select id, unnest(ws) as term from words) x where term = 'machinery' group by id) p join symbols s on s.id = p.id", SYMBOL_WORDS)
def j02_index_hits(spark, sf_dir):
    hits = textsearch.postings(_symbol_texts(spark, sf_dir)).filter("term = 'machinery'").select("id", "tf")
    return hits.join(adapter.symbols(spark, sf_dir).select("id", "name", "kind"), "id")


#: Three lines of code for each part; every one has the word, two in scope.
SCOPED = "select p_partkey as id, 'import os' || p_partkey || '{nl}x = important(1){nl}def imported():' as text from {part}"


@query("v03_scoped_grep", "select p_partkey as id, 1 as line, 'import os' || p_partkey as text from part")
def v03_scoped_grep(spark, sf_dir):
    return textsearch.grep(spark.sql(SCOPED.format(nl="\\n", **adapter.spark_names(sf_dir))), "import", scope="imports", most=None)


@query("v03_scoped_definitions", "select p_partkey as id, 3 as line, 'def imported():' as text from part")
def v03_scoped_definitions(spark, sf_dir):
    return textsearch.grep(spark.sql(SCOPED.format(nl="\\n", **adapter.spark_names(sf_dir))), "import", scope="definitions", most=None)


TOK = {
    "toks": "select doc_id as id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) > 1) as ts from documents",
    "dfs": "select term, count(*) as df from (select unnest(list_distinct(ts)) as term from toks) x group by term",
}
FNV = "list_reduce(list_prepend(cast(2166136261 as bigint), list_transform(string_split({t}, ''), lambda c: cast(ascii(c) as bigint))), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"


@query("a17_document_frequencies", "select term, df from dfs", TOK)
def a17_document_frequencies(spark, sf_dir):
    return textsearch.document_frequencies(_docs(spark, sf_dir))


@query("a18_term_frequencies", "select id, term, count(*) as tf from (select id, unnest(ts) as term from toks) x group by id, term", {"toks": TOK["toks"]})
def a18_term_frequencies(spark, sf_dir):
    return textsearch.term_frequencies(_docs(spark, sf_dir))


@query(
    "v04_tfidf",
    "select id, bucket, round(w / sqrt(sum(w * w) over (partition by id)), 6) as weight from sums where w <> 0",
    {
        **TOK,
        "hashed": f"select term, ln(1 + (select count(*) from documents) / cast(1 + df as double)) as idf, {FNV.format(t='term')} % 256 as bucket, case when {FNV.format(t="(term || '_sign')")} % 2 = 0 then 1e0 else -1e0 end as sign from dfs",
        "sums": "select t.id, h.bucket, sum(t.tf / cast(t.len as double) * h.idf * h.sign) as w from (select id, len, term, count(*) as tf from (select id, len(ts) as len, unnest(ts) as term from toks) x group by 1, 2, 3) t join hashed h on h.term = t.term group by 1, 2",
    },
)
def v04_tfidf(spark, sf_dir):
    return textsearch.tfidf(_docs(spark, sf_dir))


@query("v06_embedding_store", "select vec_id as id, case when vec_id % 10 = 0 then 2 else 64 end as size, case when vec_id % 10 = 0 then null else round(cast(embedding[1] as double), 6) end as first from embeddings union all select -1, 64, 1e0")
def v06_embedding_store(spark, sf_dir):
    """Vectors after an upsert that replaces every tenth by one of a wrong length and adds one; a wrong length reads as null."""
    e = adapter.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    changes = e.filter("id % 10 = 0").withColumn("v", F.slice("v", 1, 2)).unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.array_repeat(F.lit(1.0), 64).alias("v")))
    stored = tables.upsert(e, changes.select(F.col("id").cast(e.schema["id"].dataType), "v"), ["id"])
    return stored.select("id", F.size("v").alias("size"), F.round(textsearch.vector_of(F.col("v"), 64)[0], 6).alias("first"))


@query("v06_embeddings", "select count(*) as n, count(*) filter (len(embedding) = 64) as sound, count(distinct label) as labels from embeddings")
def v06_embeddings(spark, sf_dir):
    return adapter.table(spark, sf_dir, "embeddings").agg(F.count("*").alias("n"), F.count_if(F.size("embedding") == 64).alias("sound"), F.count_distinct("label").alias("labels"))


COSINE = "select e.vec_id as id, round(list_dot_product(cast(e.embedding as double[]), cast(q.embedding as double[])) / (sqrt(list_dot_product(cast(e.embedding as double[]), cast(e.embedding as double[]))) * sqrt(list_dot_product(cast(q.embedding as double[]), cast(q.embedding as double[])))), 6) as similarity from embeddings e, (select embedding from embeddings where vec_id = 0) q where e.vec_id <> 0 order by similarity desc, id limit 20"


@query("v07_cosine_top", COSINE)
@query("o05_top_k", COSINE)
def v07_cosine_top(spark, sf_dir):
    e = adapter.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return textsearch.cosine_top(e, e.filter("id = 0"), 20, 64)


@query("v08_embedding_text", "select id, kind || ' ' || name || ' in ' || file_path as text from symbols")
def v08_embedding_text(spark, sf_dir):
    s = adapter.symbols(spark, sf_dir)
    return s.select("id", textsearch.embedding_text(s).alias("text"))
