"""Text search: inverted index and BM25, TF-IDF vectors, cosine, grep over lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.paths import DEFINITION_LINE, IMPORT_LINE, is_safe_regex
from tessera.plans.cut import cut, is_small, small

#: BM25 constants.
K1, B = 1.2, 0.75
DIMENSIONS = 256


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def postings(docs: DataFrame, text: str = "text") -> DataFrame:
    """(id, term, tf, length) from docs (id, text): one row per distinct term of a document. Null texts have no terms."""
    words = docs.select("id", terms(F.coalesce(F.col(text), F.lit(""))).alias("words"))
    return words.select("id", F.size("words").alias("length"), F.explode("words").alias("term")).groupBy("id", "length", "term").agg(F.count("*").alias("tf")).select("id", "term", "tf", "length")


def _is(term: str):
    return lambda x: x == term


def bm25(docs: DataFrame, wanted: list[str], most: int = 20, text: str = "text") -> DataFrame:
    """(id, score): documents with all wanted terms, best first; ties by id. Inverse document frequencies are at least zero.

    Only the wanted terms' postings are formed; lengths come from the same scan, so the index is never shuffled whole.
    """
    words = docs.select("id", terms(F.coalesce(F.col(text), F.lit(""))).alias("words"))
    counts = [F.size(F.filter("words", _is(t))).alias(f"f{i}") for i, t in enumerate(wanted)]
    each = words.select("id", F.size("words").alias("length"), *counts)
    facts = each.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in range(len(wanted))])
    score = F.lit(0.0)
    for i in range(len(wanted)):
        idf = F.greatest(F.ln((F.col("n") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5)), F.lit(0.0))
        score = score + idf * F.col(f"f{i}") * (K1 + 1) / (F.col(f"f{i}") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    found = each.filter(" and ".join(f"f{i} > 0" for i in range(len(wanted))) or "false")
    return found.crossJoin(facts).select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(most)  # facts is one row


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits of two or more."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: F.length(t) > 1)


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash of an ASCII text, as a long."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: F.when(c == 0, h).otherwise((h.bitwiseXOR(c) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF))))


def document_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def term_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(id, len, term, tf): how often each term stands in each row of docs, counted where the text lies: the runs of its sorted tokens."""
    words = docs.select("id", F.sort_array(tokens(F.col(text))).alias("ts")).filter(F.size("ts") > 0)
    first = F.filter(F.sequence(F.lit(0), F.size("ts") - 1), lambda i: ~F.get("ts", i).eqNullSafe(F.get("ts", i - 1)))
    words = words.select("id", "ts", F.size("ts").alias("len"), first.alias("first"))
    runs = F.transform("first", lambda i, k: F.struct(F.get("ts", i).alias("term"), (F.coalesce(F.get("first", k + 1), F.col("len")) - i).cast("long").alias("tf")))
    return words.select("id", "len", F.inline(runs))


def term_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """(id, term, tf). Only documents that share an id are shuffled, to be counted as one."""
    shared = cut(docs.groupBy(F.col("id").alias("shared")).agg(F.count("*").alias("n")).filter("n > 1").select("shared"))
    each = term_counts(docs, text).select("id", "term", "tf")
    if shared.isEmpty():
        return each
    alike, several = F.col("id").eqNullSafe(F.col("shared")), small(shared)
    return each.join(several, alike, "left_anti").unionAll(each.join(several, alike, "left_semi").groupBy("id", "term").agg(F.sum("tf").alias("tf")))


#: Rows of (term, idf, bucket, sign), under 100 bytes each, that may be broadcast.
MOST_TERMS = 200_000


def tfidf(docs: DataFrame, text: str = "text", dimensions: int = DIMENSIONS, most_terms: int = MOST_TERMS) -> DataFrame:
    """(id, bucket, weight): hashed TF-IDF vectors of unit length, without their zeros. A term's sign comes from the hash of the term and "_sign".

    Terms are counted where the text lies. All terms' weights are broadcast if they are few; otherwise those of the terms in at
    least one in most_terms of all (document, term) pairs, of which there are no more than that, and the others are joined.
    What a document has in a bucket is shuffled once, by document, as numbers.
    """
    n = docs.agg(F.count("*").alias("n"))
    tf = term_counts(docs, text)
    idf = document_frequencies(docs, text).crossJoin(n).select("term", "df", F.ln(1 + F.col("n") / (1 + F.col("df"))).alias("idf"), (fnv1a(F.col("term")) % dimensions).alias("bucket"), F.when(fnv1a(F.concat("term", F.lit("_sign"))) % 2 == 0, 1.0).otherwise(-1.0).alias("sign"))  # n is one row
    idf = cut(idf)
    if is_small(idf, most_terms):
        met = tf.join(F.broadcast(idf.drop("df")), "term")
    else:
        pairs = idf.agg(F.sum("df")).first()[0]
        common = F.broadcast(idf.filter(F.col("df") >= pairs / most_terms).drop("df"))
        rare = tf.join(common, "term", "left_anti").join(idf.filter(F.col("df") < pairs / most_terms).drop("df").hint("merge"), "term")
        met = tf.join(common, "term").unionByName(rare)
    shares = met.select("id", "bucket", (F.col("tf") / F.col("len") * F.col("idf") * F.col("sign")).alias("share")).repartition("id")
    sums = shares.groupBy("id", "bucket").agg(F.sum("share").alias("w")).filter("w <> 0")
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return sums.select("id", "bucket", F.round(F.col("w") / norm, 6).alias("weight"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_of(v: Column, dimensions: int) -> Column:
    """A stored vector, null if it has another length."""
    return F.when(F.size(v) == dimensions, v)


def cosine_top(vectors: DataFrame, query: DataFrame, most: int, dimensions: int) -> DataFrame:
    """(id, similarity) of vectors (id, v) to the one row of query (id, v), without it; vectors of another length are left out, zero vectors score 0."""
    q = query.select(F.col("id").alias("qid"), F.col("v").alias("q")).limit(1)
    sized = vectors.filter(F.size("v") == dimensions).crossJoin(F.broadcast(q)).filter("id <> qid")  # one row
    norm = F.sqrt(dot(F.col("v"), F.col("v"))) * F.sqrt(dot(F.col("q"), F.col("q")))
    score = F.when(norm == 0, 0.0).otherwise(dot(F.col("v"), F.col("q")) / norm)
    return sized.select("id", F.round(score, 6).alias("similarity")).orderBy(F.desc("similarity"), "id").limit(most)


def embedding_text(symbols: DataFrame) -> Column:
    return F.concat_ws(" ", "kind", "name", F.lit("in"), "file_path")


def lines(files: DataFrame, text: str = "text") -> DataFrame:
    """files with line (from 1) and body, one row per line."""
    kept = [c for c in files.columns if c != text]
    return files.select(*kept, F.posexplode(F.split(text, "\n")).alias("at", "body")).select(*kept, (F.col("at") + 1).alias("line"), "body")


def grep(files: DataFrame, pattern: str, regex: bool = False, most: int | None = 50, largest: int = 512 * 1024, order: tuple[str, ...] = ("id",), scope: str | None = None) -> DataFrame:
    """(id, line, text): lines that hold pattern, without regard to case; the first most of them in order, then those of the scope.

    Texts longer than largest or with NUL are skipped; an unsafe pattern has no matches; text is trimmed to 200 characters.
    The scope filter (imports or definitions) comes after the limit.
    """
    if regex and not is_safe_regex(pattern):
        return files.select("id", F.lit(0).alias("line"), F.lit("").alias("text")).limit(0)
    sound = files.filter((F.octet_length("text") <= largest) & ~F.col("text").contains("\x00"))
    hit = F.col("body").rlike(f"(?i){pattern}") if regex else F.lower("body").contains(pattern.lower())
    found = lines(sound.select("id", "text")).filter(hit)
    found = found.orderBy(*order, "line").limit(most) if most else found
    if scope:
        found = found.filter(F.ltrim("body").rlike(IMPORT_LINE if scope == "imports" else DEFINITION_LINE))
    return found.select("id", "line", F.substring(F.trim("body"), 1, 200).alias("text"))


def literal(pattern: str) -> str:
    return re.escape(pattern)
