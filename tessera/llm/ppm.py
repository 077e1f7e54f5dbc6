"""Language-model scores by prediction by partial matching over bytes.

Documents are read as their lower-cased words joined by spaces, ended by a line feed, which no word can hold; a document's
first byte follows the end of another. The training documents are counted once as byte strings of order + 1, merged by a
grouped sum. A shorter context counts each longer one that it ends once (update exclusion), so it tells what follows where
the longer one is new. A byte is coded at the longest context that training has, with method D's escape (half a count for
each distinct byte) and with the bytes of the longer context excluded at the shorter one; below the empty context all bytes
are equally likely. The odds of all bytes at a context sum to one.

Nothing that was counted is left out. The trie is never in one place: all contexts that end in the same LOW + 1 bytes form one
branch, and a task works out the odds of every string of its branches, whether of training or met in held-out documents
only; the contexts of at most LOW bytes, whose number the alphabet bounds, are broadcast to it. Of the odds, those of the
`most_table` strings that occur most are broadcast to the documents; a document's other strings meet theirs in a shuffled
join, together with its rarer words.

The base is a unigram model of words. Its counts grow with the corpus, so only words with at least `heavy` of all training
tokens (at most 1 / heavy of them) are broadcast; a document's other words meet their counts in a shuffled join in which
no word can be hot.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import ceil, log10

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import bounded, mix, slices
from tessera.plans.cut import cut

ORDER, MOST_TABLE, HEAVY = 5, 1 << 20, 2e-6
#: Bytes of the longest contexts that all tasks have; there are at most 256 ** (LOW + 1) strings of them, in text some hundred thousand.
LOW = 2
#: Strings of a trie that a task builds at once; a branch is never cut.
BRANCHES = 1 << 20
#: Bytes of text counted or scored at once: some ten arrays of eight times the size.
PART = 1 << 20
END_BYTE = 0x0A
#: Distinct keys that a counting task holds before it passes them on.
HELD = 400_000


def tokens(text: str | None) -> list[bytes]:
    """bytes.lower and bytes.split know only the ASCII letters and white space."""
    return (text or "").encode().lower().split()


def stream(docs: list[list[bytes]], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The byte strings of order + 1 as integers, one for every byte of every document with its end, and where each document begins."""
    text = b"".join(b"\n" * order + b" ".join(words) + b"\n" for words in docs)
    sizes = np.array([sum(map(len, words)) + max(len(words), 1) for words in docs], np.int64)
    data = np.frombuffer(text, np.uint8)
    last = np.ones(len(data), bool)
    begin = np.concatenate([[0], np.cumsum(sizes + order)])[:-1]
    for j in range(order):
        last[begin + j] = False
    keys = np.zeros(len(data), np.uint64)
    for j in range(order + 1):
        keys[order:] |= data[order - j : len(data) - j].astype(np.uint64) << np.uint64(8 * j)
    return keys[last], np.concatenate([[0], np.cumsum(sizes)])[:-1]


class Model:
    """The trie as sorted arrays: for each order from 0 the byte strings, ascending, and what their contexts sum up to."""

    def __init__(self):
        self.order = -1
        self.keys, self.kept, self.contexts, self.total, self.share, self.shared, self.shared_kept, self.n = ([] for _ in range(8))

    def add(self, keys: np.ndarray, n: np.ndarray) -> Model:
        """The next order, from its strings, ascending, and their counts."""
        keys, n, k = keys.astype(np.uint64), n.astype(np.float64), self.order + 1
        contexts, first = np.unique(keys >> np.uint64(8), return_index=True)

        def of(v: np.ndarray) -> np.ndarray:
            return np.add.reduceat(v, first) if len(first) else v[:0]

        below = np.zeros(len(keys))
        if k:  # how often the shorter context has the bytes that follow this one
            below = self.n[k - 1][np.searchsorted(self.keys[k - 1], keys & np.uint64(256**k - 1))]
        for held, new in ((self.keys, keys), (self.kept, (n - 0.5).astype(np.float32)), (self.contexts, contexts), (self.total, of(n)), (self.share, of(n - 0.5)), (self.shared, of(below)), (self.shared_kept, of(below - 0.5)), (self.n, n)):
            held.append(new)
        self.order = k
        return self

    def with_strings(self, keys: np.ndarray, n: np.ndarray, order: int) -> Model:
        """A model that has the orders of this one and those up to order, from the strings of that order in whole branches."""
        out = Model()
        out.order = self.order
        for name in ("keys", "kept", "contexts", "total", "share", "shared", "shared_kept", "n"):
            setattr(out, name, list(getattr(self, name)))
        levels = [(keys, n)]
        for k in range(order, self.order + 1, -1):
            levels.insert(0, np.unique(levels[0][0] & np.uint64(256**k - 1), return_counts=True))
        for level in levels:
            out.add(*level)
        return out

    @staticmethod
    def _find(where: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(where):
            return np.zeros(len(what), np.int64), np.zeros(len(what), bool)
        at = np.minimum(np.searchsorted(where, what), len(where) - 1)
        return at, where[at] == what

    def log2(self, keys: np.ndarray) -> np.ndarray:
        """Of each byte string, the logarithm of the odds of its last byte after the others."""
        out, left = np.zeros(len(keys)), np.arange(len(keys))
        above = np.full(len(keys), -1)  # the longer context, if it is in the trie
        for k in range(self.order, -1, -1):
            if not len(self.keys[k]):
                continue
            key = keys[left] & np.uint64(256 ** (k + 1) - 1)
            c, known = self._find(self.contexts[k], key >> np.uint64(8))
            e, seen = self._find(self.keys[k], key)
            total, share = self.total[k][c], self.share[k][c]
            if k < self.order and len(self.keys[k + 1]):
                a = above[left]
                total, share = total - np.where(a >= 0, self.shared[k + 1][a], 0.0), share - np.where(a >= 0, self.shared_kept[k + 1][a], 0.0)
            with np.errstate(divide="ignore", invalid="ignore"):
                step = np.where(seen, np.log2(self.kept[k][e] / total), np.where(total > 1e-9, np.log2((total - share) / total), 0.0))
            out[left] += np.where(known, step, 0.0)
            above[left] = np.where(known, c, -1)
            left = left[~(known & seen)]
        out[left] -= np.log2(256 - len(self.keys[0]))
        return out


class Table:
    """An open-addressing table of strings and their logarithms, for one probe or two a byte."""

    def __init__(self, keys: np.ndarray, value: np.ndarray):
        self.keys, self.value, self.slots = keys.astype(np.uint64), value.astype(np.float32), None

    def __getstate__(self) -> dict:
        return {"keys": self.keys, "value": self.value, "slots": None}

    def build(self) -> Table:
        if self.slots is None:
            self.bits = max(4, int(1.5 * len(self.keys)).bit_length())
            slots, values = np.full(1 << self.bits, _NONE, np.uint64), np.zeros(1 << self.bits, np.float32)
            slot, left = self._slot(self.keys), np.arange(len(self.keys))
            while len(left):
                free = left[slots[slot[left]] == _NONE]
                slots[slot[free]] = self.keys[free]  # of several, the last stays
                won = free[slots[slot[free]] == self.keys[free]]
                values[slot[won]] = self.value[won]
                left = left[slots[slot[left]] != self.keys[left]]
                slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            self.slots, self.values, self.keys, self.value = slots, values, None, None  # a worker keeps one form
        return self

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The logarithms of keys, 0 where there is none, and the places of those."""
        slot = self._slot(keys)
        out, got = self.values[slot], self.slots[slot]
        left = np.flatnonzero(got != keys)
        got, missing = got[left], [np.zeros(0, np.int64)]
        while len(left):
            none = got == _NONE
            missing.append(left[none])
            left = left[~none]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            got = self.slots[slot[left]]
            same = got == keys[left]
            out[left[same]] = self.values[slot[left[same]]]
            left, got = left[~same], got[~same]
        missing = np.sort(np.concatenate(missing))
        out[missing] = 0
        return out.astype(np.float64), missing


_NONE = np.uint64(2**64 - 1)


def _string_counts(docs: DataFrame, order: int) -> DataFrame:
    """(key, n, met): how often each byte string of order + 1 occurs in training documents, and in all. docs: text, held_out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def merged() -> pa.RecordBatch:
            keys, *n = (np.concatenate(x) for x in zip(*held, strict=True))
            by = np.argsort(keys)
            keys = keys[by]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            held[:] = [(keys[first], *(np.add.reduceat(x[by], first) for x in n))]
            return pa.RecordBatch.from_arrays([pa.array(held[0][0].astype(np.int64)), pa.array(held[0][1]), pa.array(held[0][2])], ["key", "n", "met"])

        for batch in batches:
            for part in slices(batch, "text", PART):
                texts, out = part.column("text").to_pylist(), part.column("held_out").to_pylist()
                for learn in (True, False):
                    keys, _ = stream([tokens(t) for t, h in zip(texts, out, strict=True) if h != learn], order)
                    keys.sort()
                    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
                    met = np.diff(np.append(first, len(keys)))
                    held.append((keys[first], met if learn else np.zeros(len(met), np.int64), met))
                if sum(len(k) for k, *_ in held) > 3 * HELD:
                    out = merged()
                    if out.num_rows > 3 * HELD // 2:
                        yield out
                        held.clear()
        if held:
            yield merged()

    return docs.select("text", "held_out").mapInArrow(run, "key long, n long, met long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("met").alias("met"))


def low_orders(counted: DataFrame, order: int) -> Model:
    """The orders up to LOW of the trie of all counted strings (key, n), of which those with n > 0 count."""
    low = min(LOW, order)
    level, levels = counted.filter("n > 0").select("key", "n"), []
    if order > low:
        longer = level.select(F.col("key").bitwiseAND(F.lit(256 ** (low + 2) - 1)).alias("key")).distinct()
        level = longer.groupBy(F.col("key").bitwiseAND(F.lit(256 ** (low + 1) - 1)).alias("key")).agg(F.count("*").alias("n"))
    rows = level.toArrow()
    keys, n = (rows.column(c).to_numpy() for c in ("key", "n"))
    by = np.argsort(keys)
    levels = [(keys[by], n[by])]
    for k in range(low, 0, -1):
        levels.insert(0, np.unique(levels[0][0] & (256**k - 1), return_counts=True))
    model = Model()
    for level in levels:
        model.add(*level)
    return model


def string_odds(counted: DataFrame, low: Model, order: int) -> DataFrame:
    """(key, met, log2): the logarithm of the odds of every counted string (key, n, met), branch by branch of the trie."""
    shared = counted.sparkSession.sparkContext.broadcast(low)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # branch, key, n, met

        def scored(branch: np.ndarray, key: np.ndarray, n: np.ndarray, met: np.ndarray) -> pa.RecordBatch:
            by = np.argsort(key)
            key, n, met = key[by], n[by], met[by]
            model = shared.value
            if order > model.order:
                model = model.with_strings(key[n > 0].astype(np.uint64), n[n > 0], order)
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(met), pa.array(model.log2(key.astype(np.uint64)))], ["key", "met", "log2"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(tuple(batch.column(c).to_numpy() for c in ("branch", "key", "n", "met")))
            if sum(len(x[0]) for x in held) >= BRANCHES:
                every = [np.concatenate(x) for x in zip(*held, strict=True)]
                whole = int(np.searchsorted(every[0], every[0][-1]))  # the last branch may go on
                if whole:
                    yield scored(*(x[:whole] for x in every))
                held = [tuple(x[whole:] for x in every)]
        if held:
            yield scored(*(np.concatenate(x) for x in zip(*held, strict=True)))

    branch = F.shiftright("key", 8).bitwiseAND(F.lit(256 ** (LOW + 1) - 1))
    return counted.withColumn("branch", branch).repartition("branch").sortWithinPartitions("branch").mapInArrow(run, "key long, met long, log2 double")


def most_met(odds: DataFrame, most: int) -> int:
    """The least number of occurrences such that at most `most` strings have it."""
    steps = dict(odds.groupBy(F.floor(8 * F.log2("met")).alias("step")).count().collect())
    kept, least = sum(steps.values()), 0
    for step in sorted(steps):
        if kept <= most:
            break
        kept -= steps[step]
        least = ceil(2 ** ((step + 1) / 8))
    return least


def _token_counts(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(c: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], ["token", "c"])

        c: Counter = Counter()
        for batch in batches:
            for text in (t.as_py() for t in batch.column("text")):
                c.update(tokens(text))
                c[b""] += 1  # the end
                if len(c) > HELD:
                    yield out(c)
                    c = Counter()
        yield out(c)

    return docs.select("text").mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


SCORES = "doc_id long, tie long, token binary, n int, main struct<n_tokens:long, n_known:long, base_score:double, score:double, held_out:boolean>"


def score_documents(docs: DataFrame, training: Column | None = None, order: int = ORDER, most_table: int = MOST_TABLE, heavy: float = HEAVY) -> DataFrame:
    """Every document with held_out, n_tokens, n_known, train_tokens, base_score and score.

    training says which rows the models learn from (default: crc32 of doc_id as text, modulo 5, is not 1; null counts as
    the text "null"). score is log10 of the model's odds of the whole text with its end. A null or empty text is its end
    alone. Without training rows the models are uniform. Rows that repeat are scored alike. Extra columns are not read.
    order: bytes of context, at most 6. most_table and heavy bound what is broadcast; they do not change results.
    """
    if training is None:
        training = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) % 5 != 1
    docs = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), (~F.coalesce(training, F.lit(False))).alias("held_out"))
    counts = cut(_token_counts(docs.filter("not held_out")))
    total, distinct = counts.filter("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    below = total + 0.5 * (distinct + 1)
    frequent = {bytes(r[0]): log10((r[1] + 0.5) / below) for r in counts.filter((F.col("c") >= heavy * total) & (F.col("c") > 0)).collect()}
    frequent.setdefault(b"", log10(0.5 / below))
    ends_known = int(total > 0)
    strings = cut(_string_counts(docs, order))
    odds = cut(string_odds(strings, low_orders(strings, order), order))
    least = most_met(odds, most_table)
    top = odds.filter(F.col("met") >= least).select("key", F.col("log2").cast("float").alias("log2")).toArrow()
    shared = docs.sparkSession.sparkContext.broadcast((Table(top.column("key").to_numpy(), top.column("log2").to_numpy()), frequent))
    del top

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, words = shared.value
        table.build()
        for batch in batches:
            for part in slices(batch, "text", PART):
                texts = [tokens(t) for t in part.column("text").to_pylist()]
                keys, begin = stream(texts, order)
                found, missing = table.find(keys)
                score = np.add.reduceat(found, begin) * log10(2)
                rarer = np.searchsorted(missing, np.append(begin, len(keys)))
                rows: list[tuple] = []
                for i, (doc, tie, held, text, s) in enumerate(zip(*(part.column(c).to_pylist() for c in ("doc_id", "tie", "held_out")), texts, score.tolist(), strict=True)):
                    base, known, rest = words[b""], ends_known, []
                    for word, n in Counter(text).items():
                        if word in words:
                            base += n * words[word]
                            known += n
                        else:
                            rest.append((doc, tie, word, n, None))
                    if rarer[i] < rarer[i + 1]:
                        rest += [(doc, tie, b"\t" + key.to_bytes(8), -n, None) for key, n in Counter(keys[missing[rarer[i] : rarer[i + 1]]].tolist()).items()]
                    # no word begins with a line feed, so this row meets no count and its key spreads over the partitions
                    rows.append((doc, tie, b"\n%d" % tie, 0, (len(text) + 1, known, base, s, held)))
                    rows += rest
                doc, tie, word, n, main = zip(*rows, strict=True)
                names = ("n_tokens", "n_known", "base_score", "score", "held_out")
                packed = pa.StructArray.from_arrays(
                    [pa.array([m and m[i] for m in main], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()))], names, mask=pa.array([m is None for m in main])
                )
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(tie, pa.int64()), pa.array(word, pa.binary()), pa.array(n, pa.int32()), packed], ["doc_id", "tie", "token", "n", "main"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("tie"), "held_out", "text").mapInArrow(run, SCORES)
    # words hold no white space: a tab and a string's eight bytes are no word
    string = F.concat(F.lit(b"\t"), F.unhex(F.lpad(F.hex("key"), 16, "0")))
    facts = counts.select("token", "c", F.lit(0.0).alias("log2")).unionAll(odds.filter(F.col("met") < least).select(string, F.lit(0).cast("long"), "log2"))
    rare = rows.join(facts, "token", "left")
    c, n = F.coalesce("c", F.lit(0)), F.col("n")
    repeats = F.count("main")
    per = rare.groupBy("doc_id", "tie").agg(
        repeats.alias("repeats"),
        *[F.max(f"main.{c}").alias(c) for c in ("n_tokens", "n_known", "base_score", "score", "held_out")],  # one row has them; apart, they need no sort
        (F.sum(F.when((c > 0) & (n > 0), n).otherwise(0)) / repeats).cast("long").alias("known"),
        (F.sum(F.when(n > 0, n * F.log10((c + 0.5) / F.lit(float(below)))).otherwise(0.0)) / repeats).alias("base"),
        (F.sum(F.when(n < 0, -n * F.col("log2")).otherwise(0.0)) * log10(2) / repeats).alias("rarer"),
    )
    out = per.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("known")).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base_score") + F.col("base")).alias("base_score"), (F.col("score") + F.col("rarer")).alias("score"),
    )
