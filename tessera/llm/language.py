"""Language identification by Bayesian fusion of text, declared language, address suffix and host.

The text's evidence is a naive Bayes model of byte trigrams, learned from all rows that declare one of the languages and
tempered, since neighbouring trigrams are not independent. A declared language is evidence by a confusion table: it is
right with odds `trust`. The prior comes from the host, smoothed towards its address suffix, which is smoothed towards all
rows; the counts behind it are grouped sums of what text and declaration say, less the row's own share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.html_text import main_text_of
from tessera.llm.text import WHITE, bounded, mix, packed, raw, slices
from tessera.plans.cut import cut, small

#: Trigram cells of a language, and of all languages together: more than 64 languages get fewer cells each. This bounds what reaches the driver.
CELLS, MOST_CELLS, LEAST_CELLS = 1 << 15, 1 << 21, 1 << 8
#: A text counts as at most so many independent trigrams, one in every DEPENDENT.
MOST_EVIDENCE, DEPENDENT = 200.0, 4.0
TRUST, HOST_PRIOR, SUFFIX_PRIOR = 0.9, 10.0, 20.0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[WHITE] = 32
_PLAIN = WHITE.copy()
_PLAIN[65:91] = _PLAIN[97:123] = _PLAIN[128:] = True


def cells_of(texts: pa.Array, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """The cells of the trigrams of letters and spaces of all texts, and where each text begins, with the end at last. Runs of spaces count once."""
    data, off = raw(texts)
    keep = _PLAIN[data]
    data = _LOWER[data]
    keep[1:] &= ~((data[1:] == 32) & (data[:-1] == 32))
    kept = np.concatenate([[0], np.cumsum(keep)])
    data, off = data[keep].astype(np.uint64), kept[off]
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    tri = data[:-2] << np.uint64(16) | data[1:-1] << np.uint64(8) | data[2:]
    inside = np.ones(len(tri), bool)
    for j in (1, 2):  # no trigram spans two texts
        inside[np.clip(off[1:-1] - j, 0, len(tri) - 1)] &= (off[1:-1] - j < 0) | (off[1:-1] - j >= len(tri))
    at = np.concatenate([[0], np.cumsum(inside)])[np.minimum(off, len(tri))]
    return (mix(tri[inside]) >> np.uint64(64 - cells.bit_length() + 1)).astype(np.int64), at


class Trigrams:
    """log-odds of every cell in every language, and how well texts of a language usually fit."""

    def __init__(self, languages: list[str], log_p: np.ndarray, usual: np.ndarray):
        self.languages, self.log_p, self.usual = languages, log_p, usual

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(tempered log likelihoods, fit): a row for each text. fit: mean log-odds of the best language, less that language's usual one; -inf without trigrams."""
        cells, at = cells_of(texts, self.log_p.shape[1] or CELLS)
        n = np.diff(at)
        mean = np.zeros((len(n), len(self.languages)))
        for j in range(len(self.languages)):
            total = np.concatenate([[0], np.cumsum(self.log_p[j][cells], dtype=np.float64)])
            mean[:, j] = (total[at[1:]] - total[at[:-1]]) / np.maximum(n, 1)
        weight = np.minimum(n / DEPENDENT, MOST_EVIDENCE)
        best = mean.argmax(axis=1) if len(self.languages) else np.zeros(len(n), int)
        fit = np.where(n > 0, mean[np.arange(len(n)), best] - self.usual[best], -np.inf) if len(self.languages) else np.full(len(n), -np.inf)
        return mean * weight[:, None], fit


def fit_trigrams(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Trigrams:
    """The model of all rows with a language, and of every language. At most MOST_CELLS counts reach the driver, or LEAST_CELLS a language if these are more."""
    rows = bounded(labelled).filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    languages = sorted(r[0] for r in rows.select("lang").distinct().collect())
    index = {x: i for i, x in enumerate(languages)}
    n_cells = CELLS
    while n_cells > LEAST_CELLS and n_cells * len(index) > MOST_CELLS:
        n_cells //= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(index), n_cells), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                cells, at = cells_of(part.column("text"), n_cells)
                of = np.array([index.get(x, -1) for x in part.column("lang").to_pylist()])
                for j in range(len(index)):
                    use = np.repeat(of == j, np.diff(at))
                    n[j] += np.bincount(cells[use], minlength=n_cells)
        j, cell = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(j.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(n[j, cell])], ["j", "cell", "n"])

    counts = np.zeros((len(index), n_cells))
    if index:
        got = rows.mapInArrow(run, "j int, cell int, n long").groupBy("j", "cell").agg(F.sum("n").alias("n")).toArrow()
        counts[got.column("j").to_numpy(), got.column("cell").to_numpy()] = got.column("n").to_numpy()
    p = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
    log_p = np.log(p)
    usual = (counts * log_p).sum(axis=1) / np.maximum(counts.sum(axis=1), 1)
    return Trigrams(languages, log_p, usual)


def host_of(url: Column) -> Column:
    """The host of an address, lower-cased, without user, port and a leading "www."."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", "")


def suffix_of(host: Column) -> Column:
    return F.when(host.contains("."), F.substring_index(host, ".", -1)).otherwise("")


def text_evidence(model: Trigrams, text: str = "text") -> Column:
    """struct(log_text array<double>, fit double)"""

    @F.pandas_udf("log_text array<double>, fit double")
    def run(texts: pd.Series) -> pd.DataFrame:
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string(), from_pandas=True)], ["t"])
        got = [model.scores(part.column(0)) for part in slices(batch, "t")]
        return pd.DataFrame({"log_text": [list(row) for s, _ in got for row in s], "fit": [float(x) for _, f in got for x in f]})

    return run.asNondeterministic()(F.coalesce(F.col(text), F.lit("")))  # else filters on it are pushed below and evaluate it again


def _norm(logs: Column) -> Column:
    """Logarithms to probabilities that sum to one."""
    top = F.array_max(logs)
    odds = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(odds, lambda x: x / F.aggregate(odds, F.lit(0.0), lambda a, b: a + b))


def fuse(rows: DataFrame, model: Trigrams, trust: float = TRUST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows with log_text, declared, host, suffix and own (what text and declaration say alone), and the summed own of hosts and suffixes."""
    k = len(model.languages)
    wrong = float(np.log((1 - trust) / max(k - 1, 1)))
    said = F.array(*[F.when(F.col("declared").eqNullSafe(x), float(np.log(trust))).otherwise(wrong) for x in model.languages])
    known = F.coalesce(F.col("declared").isin(model.languages), F.lit(False))
    rows = rows.withColumn("log_own", F.zip_with("log_text", F.when(known, said).otherwise(F.array_repeat(F.lit(0.0), k)), lambda a, b: a + b)).withColumn("own", _norm(F.col("log_own")))
    sums = [F.sum(F.col("own")[j]).alias(f"n{j}") for j in range(k)]
    hosts = rows.groupBy("host", "suffix").agg(*sums)
    return rows, hosts, hosts.groupBy("suffix").agg(*[F.sum(f"n{j}").alias(f"s{j}") for j in range(k)])


def prior_table(hosts: DataFrame, suffixes: DataFrame, k: int) -> DataFrame:
    """(host, suffix, counts, suffix_share): the sums of each host and the smoothed shares of its suffix."""
    everything = suffixes.agg(*[F.coalesce(F.sum(f"s{j}"), F.lit(0.0)) for j in range(k)]).first()
    total = sum(everything)
    share = [(n + 1.0) / (total + k) for n in everything]
    of_suffix = sum((F.col(f"s{j}") for j in range(k)), F.lit(0.0))
    s = suffixes.select("suffix", F.array(*[(F.col(f"s{j}") + SUFFIX_PRIOR * share[j]) / (of_suffix + SUFFIX_PRIOR) for j in range(k)]).alias("suffix_share"))
    return hosts.join(small(s), "suffix").select("host", "suffix", F.array(*[f"n{j}" for j in range(k)]).alias("counts"), "suffix_share")


def posterior() -> Column:
    """From log_own, own, counts and suffix_share. The row's own share is taken out of its host's counts."""
    others = F.zip_with("counts", "own", lambda n, o: F.greatest(n - o, F.lit(0.0)))
    total = F.aggregate(others, F.lit(0.0), lambda a, b: a + b)
    prior = F.zip_with(others, "suffix_share", lambda n, s: F.log((n + HOST_PRIOR * s) / (total + HOST_PRIOR)))
    return _norm(F.zip_with("log_own", prior, lambda a, b: a + b))


def identified(rows: DataFrame, model: Trigrams, columns: list[str], least_fit: float = -2.0, trust: float = TRUST) -> DataFrame:
    """columns of rows (log_text, fit, declared, host, suffix and more) with language, posterior and text_fit.

    language is null where the text has no trigram or fits its best language worse than usual by more than -least_fit a trigram.
    """
    if not model.languages:
        return rows.select(*columns, F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("posterior"), F.col("fit").alias("text_fit"))
    fused, hosts, suffixes = fuse(rows, model, trust)
    hosts = cut(hosts)
    sums = [F.sum(f"n{j}").alias(f"s{j}") for j in range(len(model.languages))]
    table = cut(prior_table(hosts, hosts.groupBy("suffix").agg(*sums), len(model.languages)))
    out = fused.join(small(table), ["host", "suffix"]).withColumn("p", posterior()).withColumn("best", F.array_max("p"))
    language = F.element_at(F.array(*[F.lit(x) for x in model.languages]), F.array_position("p", F.col("best")).cast("int"))
    return out.select(*columns, F.when(F.col("fit") >= least_fit, language).alias("language"), F.col("best").alias("posterior"), F.col("fit").alias("text_fit"))


def identify_pages(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """(page_id, url, host, declared, language, posterior, text_fit) of every page, by its main text, lang attribute and address.

    labelled (text, lang) trains the text model. Null or empty html has no text: its language is null, though its posterior
    tells what declaration and host say. An address without a host belongs to the empty host. Rows that repeat get equal results.
    """
    model = fit_trigrams(labelled)
    # a tag without the attribute is matched too, so that the search goes on behind it and stays linear
    tags = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?i)<html(?:[^>]*\slang\s*=\s*["']?([A-Za-z]{2,3})|[^>]*)"""), 1)
    declared = F.lower(F.try_element_at(F.filter(tags, lambda x: x != ""), F.lit(1)))
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), declared.alias("declared"), main_text_of("html").alias("text"))
    rows = rows.withColumn("suffix", suffix_of(F.col("host"))).withColumn("e", text_evidence(model))
    rows = cut(rows.select("page_id", "url", "host", "suffix", "declared", "e.log_text", "e.fit"))
    return identified(rows, model, ["page_id", "url", "host", "declared"])


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs (text, lang, source) whose language is told with a posterior of at least `least`; lang becomes that language.

    The declared lang is the markup's; the source stands for the host, and for its own suffix. Texts are read by two narrow
    passes and joined with one row per source. Where no row declares a language there is nothing to learn from and nothing to
    judge by: all rows stay as they are. No column of docs can clash with what is added here.
    """
    model = fit_trigrams(docs)
    if not model.languages:
        return docs
    source = F.coalesce("source", F.lit(""))
    rows = packed(docs, "text", F.col("lang").alias("declared"), source.alias("host"), suffix_of(source).alias("suffix")).withColumn("e", text_evidence(model))
    out = identified(rows.select("row", "declared", "host", "suffix", "e.log_text", "e.fit"), model, ["row"])
    out = out.filter(F.col("language").isNotNull() & (F.col("posterior") >= least))
    return out.select(*[F.col("language").alias("lang") if c == "lang" else F.col("row")[c].alias(c) for c in docs.columns])
