"""The queries of this package, each a thin use of its operator over a whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bestfit, divergence, fingerprints, html_text, language, license, mixing, packing, ppm, quality, ranked, simhash, warc
from tessera.plans.cut import checkpoint_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract_main_text(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), "source_size", "target", (F.col("copies") * F.col("mix_size")).alias("taken"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(_table(spark, sf_dir, "documents"))


def op4_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_documents(_table(spark, sf_dir, "documents"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_pages(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan_licenses(_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the archives into the shared checkpoint folder, under a name of this run's own, and reads them back."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    warc.archive_pages(_table(spark, sf_dir, "pages"), path)
    return warc.page_records(warc.read_warc(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.pack_best_fit(_table(spark, sf_dir, "documents"), tokenizer_path())


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(_table(spark, sf_dir, "documents"))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op2 aims at, without what it draws."""
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), "source_size", F.round("target", 3).alias("target"))


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op9 counts, without the verdict of the model."""
    out = quality.judge(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_text, op2_mixing, op3_fingerprints, op4_ppm_scores, op5_packing, op6_language, op7_licenses, op8_warc, op9_quality, op10_simhash, op11_ranked_search, op12_best_fit, op13_source_audit,
        mixing_targets, quality_counts,
    )
}

_SIZES = "select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size from documents"
#: Sharing runs until no target is above its bound; a round stops one more source at least.
_TARGETS = """
with recursive sized as ({sizes}), sources as (select source, sum(size) as source_size, (array[5, 2, 1])[1 + (row_number() over (order by source nulls last) - 1) % 3] as weight from sized group by source),
shared as (
  select 0 as round, source, source_size, weight, cast(null as double) as stopped, (select sum(source_size) from sources) * weight / (select cast(sum(weight) as double) from sources) as share from sources
  union all
  select round + 1, source, source_size, weight, now, case when now is null then left_over * weight / left_weight end from (
    select *, sum(source_size) over () - sum(coalesce(now, 0)) over () as left_over, cast(sum(case when now is null then weight end) over () as double) as left_weight, sum(case when now is not null and stopped is null then 1 else 0 end) over () as news
    from (select *, coalesce(stopped, case when share > 3 * source_size then 3e0 * source_size end) as now from shared) x) y
  where news > 0
),
last as (select source, source_size, coalesce(stopped, share) as target from shared where round = (select max(round) from shared))
select d.doc_id, d.size, cast(l.source_size as bigint) as source_size, round(l.target, 3) as target from sized d join last l on l.source is not distinct from d.source
"""
_COUNTS = """
with docs as (select doc_id, coalesce(text, '') as text, row_number() over () as r from documents),
worded as (select *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as w, string_split(text, chr(10)) as lines from docs),
windows as (select r, i, w[i:i + 2] as three, len(w) as n from (select r, w, unnest(generate_series(1, len(w) - 2)) as i from worded) x),
again as (select r, unnest([i, i + 1, i + 2]) as pos from (select r, i, count(*) over (partition by r, three) as times from windows) x where times > 1),
repeats as (select r, count(distinct pos) as n from again group by r),
filled as (select r, len(list_filter(lines, lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]'))) as n, len(list_distinct(list_filter(lines, lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')))) as different from worded)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(length(array_to_string(d.w, '')) as bigint) as word_chars, cast(length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
  cast(f.n - f.different as bigint) as n_dup_lines, cast(coalesce(p.n, 0) as bigint) as n_repeat_words, len(d.w) < 50 or 100 * coalesce(p.n, 0) > 50 * len(d.w) as base_failed
from worded d join filled f on f.r = d.r left join repeats p on p.r = d.r
"""
_WARC = """
with payloads as (select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as digest, octet_length(encode(coalesce(html, ''))) as n from pages),
top as (select digest, max(page_id) as page_id from payloads where n >= 1000 group by digest)
select p.page_id, cast(p.n as bigint) as payload_bytes, p.digest as payload_digest, case when t.page_id <> p.page_id then 'revisit' else 'response' end as record_type, case when t.page_id <> p.page_id then t.page_id end as refers_to
from payloads p left join top t on t.digest = p.digest and p.n >= 1000
"""

_RANKED = r"""
with found as (select row_number() over () as r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
tfs as (select r, doc_id, term, count(*) as tf from found group by all),
lengths as (select r, sum(tf) as n from tfs group by r),
total as (select cast(count(*) as bigint) as docs, cast(sum(n) as bigint) as terms from lengths),
weights as (select term, cast(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) as bigint) as w from tfs, total group by term),
ms as (select r, cast(10 + (90 * cast(n as hugeint) * docs) // terms as bigint) as m from lengths, total),
asked as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
scores as (select item_id, r, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score from asked join tfs using (term) join weights using (term) join ms using (r) group by all)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score from scores where score > 0 qualify rank <= 10
"""
_AUDIT = r"""
with docs as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
tfs as (select r, lang, source, term, count(*) as n from (select r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs) x group by all),
kept as (select lang, term, cast(sum(n) as hugeint) as n from tfs group by lang, term having count(*) >= 30),
sizes as (select lang, cast(count(*) as hugeint) as v, cast(sum(n) as hugeint) as total from kept group by lang),
grouped as (select distinct lang, source from docs),
counts as (select lang, source, term, cast(sum(n) as hugeint) as n from tfs semi join kept using (lang, term) group by all),
totals as (select g.lang, g.source, cast(coalesce(sum(n), 0) as hugeint) as total from grouped g left join counts using (lang, source) group by all),
shares as (select t.lang, t.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (t.total + 5 * s.v) as p, 1 + (1000000000::hugeint * (k.n + 5)) // (s.total + 5 * s.v) as q
  from totals t join sizes s using (lang) join kept k using (lang) left join counts c on c.lang = t.lang and c.source = t.source and c.term = k.term),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(f, 0) as bigint) as value from grouped a join grouped b on a.lang = b.lang and a.source <> b.source
  left join (select x.lang, x.source, y.source as item, sum(abs(x.p - y.p)) as f from shares x join shares y on x.lang = y.lang and x.term = y.term group by all) d on d.lang = a.lang and d.source = a.source and d.item = b.source),
every as (select * from pairs union all select lang, source, 'term', term, cast(p - q as bigint) from shares where n > 0 and p > q)
select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank from every qualify part = 'pair' or rank <= 50
"""

#: What the others give cannot be told in SQL (XXH64, fitted models, tokenizers, parsers, drawn samples); tests hold it against brute force.
ORACLES: dict[str, str] = {"op8_warc": _WARC, "op11_ranked_search": _RANKED, "op13_source_audit": _AUDIT, "mixing_targets": _TARGETS.format(sizes=_SIZES), "quality_counts": _COUNTS}
