"""Quality rules as weak supervision: rules vote good, bad or not at all, and a model of their accuracies gives the verdict.

Documents that fail the base rules are rejected as they are. The votes of all others are counted by pattern; with m rules there are at most 3^m patterns, so the counts have a fixed
bound and hold everything that expectation-maximisation needs. It estimates how often each rule votes each way on good and
on bad documents, and the share of good ones; the posterior probability of quality then replaces the demand that all rules pass.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import Words, bounded, mix, packed, slices
from tessera.plans.cut import cut

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
FEATURES = f"{COUNTS}, n_lines long, n_distinct long, n_upper long, n_letters long, n_digits long, n_bangs long, n_bars long"
#: Kinds of rarer bytes: capitals, digits, marks of shouting, bars, other symbols.
_RARE = np.zeros(256, np.uint8)
_RARE[SYMBOLS] = 5
_RARE[65:91] = 1
_RARE[48:58] = 2
_RARE[list(b"!?")] = 3
_RARE[ord("|")] = 4
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[192:] = True  # a letter beyond ASCII counts once, by its first byte


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def features_of(texts: pa.Array) -> dict[str, np.ndarray]:
    """Counts over whole texts; null texts count as empty."""
    words = Words(texts)
    data, off = words.data, words.off
    h = words.hashes()
    starts = (data & 0xC0) != 0x80  # code points
    chars = np.concatenate([[0], np.cumsum(starts, dtype=np.int64)])
    n_docs = len(words.count)
    word_chars = _sums(chars[words.end] - chars[words.start], words.first)
    # windows of three words that occur twice or more in their document; their words count once each
    doc = words.doc
    covered = np.zeros(len(h), bool)
    if len(h) > 2:
        w = mix(mix(h[:-2] * np.uint64(3) + doc[:-2].astype(np.uint64)) + mix(h[1:-1] * np.uint64(5)) * np.uint64(7) + h[2:])
        whole = doc[:-2] == doc[2:]
        order = np.sort(w[whole])
        twice = np.unique(order[1:][order[1:] == order[:-1]])
        if len(twice):
            at = np.minimum(np.searchsorted(twice, w), len(twice) - 1)
            again = np.flatnonzero((twice[at] == w) & whole)
            for j in range(3):
                covered[again + j] = True
    key = np.sort(doc.astype(np.uint64) << np.uint64(40) | h >> np.uint64(24))
    distinct = np.bincount((key[np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]])] >> np.uint64(40)).astype(np.int64), minlength=n_docs)
    lines, dup = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
    blank = bytes(range(9, 14)) + b" "
    for i in range(n_docs):
        seen: set[bytes] = set()
        some = [x for x in data[off[i] : off[i + 1]].tobytes().split(b"\n") if x.strip(blank)]
        seen.update(some)
        lines[i], dup[i] = len(some), len(some) - len(seen)
    kind = _RARE[data]
    rare = np.flatnonzero(kind)
    kind, of = kind[rare], np.searchsorted(off, rare, "right") - 1
    upper, digits, bangs, bars, others = (np.bincount(of[kind == j], minlength=n_docs) for j in range(1, 6))
    letters, symbols = _sums(_LETTER[data], off), bars + others
    return {
        "n_words": words.count, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": _sums(covered, words.first), "n_lines": lines,
        "n_distinct": distinct, "n_upper": upper, "n_letters": letters, "n_digits": digits, "n_bangs": bangs, "n_bars": bars,
    }


def features(text: str = "text") -> Column:
    """A struct of counts for a column of texts."""

    @F.pandas_udf(", ".join(FEATURES.split(", ")))
    def run(texts: pd.Series) -> pd.DataFrame:
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string(), from_pandas=True)], ["t"])
        parts = [pd.DataFrame(features_of(part.column(0))) for part in slices(batch, "t")]
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({c.split()[0]: pd.Series([], dtype="int64") for c in FEATURES.split(", ")})

    return run.asNondeterministic()(F.coalesce(F.col(text), F.lit("")))  # else filters on it are pushed below and evaluate it again


#: name, SQL for a vote against, SQL for a vote in favour; neither: the rule abstains. Written over the counts of FEATURES.
RULES = (
    ("length", "n_words < 50", "n_words >= 100 and n_words <= 100000"),
    ("word_length", "word_chars < 3 * n_words or word_chars > 10 * n_words", "n_words >= 20 and word_chars between 4 * n_words and 7 * n_words"),
    ("symbols", "10 * n_symbols > n_words", "n_words >= 20 and 100 * n_symbols <= n_words"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words", "n_words >= 20 and 100 * n_repeat_words <= 10 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 30 * n_lines and n_lines >= 3", "n_lines >= 5 and n_dup_lines = 0"),
    ("capitals", "100 * n_upper > 30 * n_letters and n_letters > 0", "n_letters >= 100 and 100 * n_upper <= 10 * n_letters"),
    ("shouting", "100 * n_bangs > 30 * n_words", "n_words >= 50 and 100 * n_bangs <= 2 * n_words"),
    ("bars", "100 * n_bars > 10 * n_words", "n_words >= 50 and n_bars = 0"),
    ("variety", "n_words >= 50 and 100 * n_distinct < 15 * n_words", "n_words between 50 and 5000 and 100 * n_distinct >= 40 * n_words"),
    ("letters", "2 * n_letters < word_chars", "n_words >= 20 and 100 * n_letters >= 85 * word_chars"),
)


def pattern(rules: tuple = RULES) -> Column:
    """The votes as digits in base 3: 0 against, 1 abstains, 2 in favour."""
    return sum((F.when(F.expr(bad), 0).when(F.expr(good), 2).otherwise(1) * (3**i) for i, (_, bad, good) in enumerate(rules)), F.lit(0)).cast("int")


class LabelModel:
    """Accuracies of m rules with votes 0, 1, 2, given that rules err independently within good and within bad documents."""

    def __init__(self, m: int, prior: float = 0.7):
        self.prior = prior
        self.odds = np.tile([[[0.3, 0.1, 0.6], [0.01, 0.29, 0.7]]], (m, 1, 1))  # rule, class (bad, good), vote: a vote against is rare on good documents, a vote in favour tells little

    @staticmethod
    def votes(patterns: np.ndarray, m: int) -> np.ndarray:
        return (patterns[:, None] // 3 ** np.arange(m)) % 3

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        m = len(self.odds)
        votes = self.votes(patterns, m)
        score = np.log([1 - self.prior, self.prior]) + sum(np.log(self.odds[j, :, :]).T[votes[:, j]] for j in range(m))
        return 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -700, 700)))

    def fit(self, patterns: np.ndarray, n: np.ndarray, rounds: int = 200) -> LabelModel:
        """Expectation-maximisation over counted patterns, smoothed by one document a vote. A rule is never let vote against what it says: the classes cannot swap."""
        m, votes = len(self.odds), self.votes(patterns, len(self.odds))
        for _ in range(rounds if len(patterns) else 0):
            good = self.posterior(patterns)
            new = np.empty_like(self.odds)
            for j in range(m):
                for c, share in enumerate((n * (1 - good), n * good)):
                    count = np.bincount(votes[:, j], share, 3) + 1
                    new[j, c] = count / count.sum()
                if new[j, 0, 0] * new[j, 1, 2] < new[j, 0, 2] * new[j, 1, 0]:
                    new[j] = new[j].mean(axis=0)
            prior = float(np.clip((n * good).sum() / n.sum(), 0.02, 0.98))
            moved = max(abs(prior - self.prior), np.abs(new - self.odds).max())
            self.prior, self.odds = prior, new
            if moved < 1e-6:
                break
        return self


def fit_votes(counted: DataFrame, m: int) -> DataFrame:
    """(pattern, quality) for each of the counted patterns (pattern, n), at most 3^m of them."""
    rows = counted.collect()
    patterns, n = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)
    good = LabelModel(m).fit(patterns, n).posterior(patterns) if len(rows) else []
    return counted.sparkSession.createDataFrame([(int(p), float(g)) for p, g in zip(patterns, good, strict=True)], "pattern int, quality double")


BASE_FAILED = "(n_words < 50 or 100 * n_repeat_words > 50 * n_words)"


def judge(docs: DataFrame, rules: tuple = RULES, least: float = 0.5) -> DataFrame:
    """(doc_id, counts, base_failed, quality, kept) of every document.

    kept: not base_failed, and the posterior probability of quality (null if base_failed) is at least `least`. Null texts have no words. Rows that
    repeat are judged alike. Other columns of docs are not read. The posterior of a pattern is broadcast: at most 3^m rows.
    """
    counted = cut(bounded(docs).select("doc_id", features().alias("f")).select("doc_id", "f.*").withColumn("pattern", pattern(rules)))
    quality = fit_votes(counted.filter(f"not {BASE_FAILED}").groupBy("pattern").agg(F.count("*").alias("n")), len(rules))
    out = counted.join(F.broadcast(quality), "pattern", "left").withColumn("base_failed", F.expr(BASE_FAILED))
    out = out.withColumn("quality", F.when(~F.col("base_failed"), F.col("quality")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))


def keep_good(docs: DataFrame, rules: tuple = RULES, least: float = 0.5) -> DataFrame:
    """The rows of docs that `judge` keeps, by two narrow passes: one counts patterns, one filters. Texts are not shuffled.

    Null and empty texts fail the base rules and go; rows that repeat stay or go together; an empty table gives an empty one.
    No column of docs can clash with what is added here.
    """
    def voted(rows: DataFrame) -> DataFrame:
        return rows.withColumn("f", features()).select("*", "f.*").filter(f"not {BASE_FAILED}").withColumn("pattern", pattern(rules))

    quality = fit_votes(voted(bounded(docs).select("text")).groupBy("pattern").agg(F.count("*").alias("n")), len(rules))
    good = F.broadcast(quality.filter(F.col("quality") >= least).select("pattern"))
    return voted(packed(docs, "text")).join(good, "pattern", "left_semi").select("row.*")
