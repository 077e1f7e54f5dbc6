"""Packing token sequences: first-fit decreasing with a tournament tree of bin capacities, in randomised groups of documents.

Texts are tokenised where they lie and only piece lengths are shuffled. A document longer than a sequence is cut into full
pieces, each a sequence of its own, and a rest; the rests are packed group by group. Groups are dealt by a hash of the
row, equal rows apart, so no source, key or repeated row makes a group large, and groups do not depend on each other.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import FORGET, bounded, trim

LENGTH, END = 2048, 1
#: Bytes of text that are tokenised at once.
GATHERED = 8 << 20
#: Documents of a group on average.
GROUP_ROWS = 8_192
#: Distinct chunks, and distinct pre-tokens, of a generation that a worker remembers.
REMEMBERED = 100_000
# The rules of a tokenizer file under which Latin text needs lower-casing and LATIN_PARTS only.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN_RULES = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": PARTS}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
]
#: Printable characters up to U+00FF; canonical composition leaves them alone, and each has one lower-case form.
LATIN = re.compile(r"[!-~\xa1-\xac\xae-\xff]*")
_LETTERS, _NUMBERS = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
MARKS = frozenset(".,;:!?)")
LATIN_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}]+")
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
#: Characters as byte-level pre-tokenizers write their UTF-8 bytes.
LATIN_BYTES = {c: "".join(_BYTES[b] for b in chr(c).encode()) for c in range(128, 256)}
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Tree:
    """A tournament over bins: each inner node holds the most capacity below it, so the first bin that fits is one descent."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.most = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """The first bin with room for size, which is taken from it."""
        most, at = self.most, 1
        while at < self.leaves:
            at *= 2
            if most[at] < size:
                at += 1
        most[at] -= size
        found, at = at - self.leaves, at // 2
        while at:
            a, b = most[2 * at], most[2 * at + 1]
            most[at] = a if a > b else b
            at //= 2
        return found


def first_fit_decreasing(sizes: list[int], capacity: int = LENGTH) -> tuple[list[int], list[int]]:
    """Bin and offset of each size (1 to capacity), in the order given. Equal sizes keep that order."""
    tree = Tree(len(sizes), capacity)
    bins, offsets, used = [0] * len(sizes), [0] * len(sizes), {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        b = bins[i] = tree.place(sizes[i])
        offsets[i] = used.get(b, 0)
        used[b] = offsets[i] + sizes[i]
    return bins, offsets


class Remembered(dict):
    """A dict of at most two generations: what was asked for since the last but one time that it was full stays."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.older = most, {}

    def missing(self, keys: set[str]) -> set[str]:
        """The keys that are not known. Makes room first if there is none."""
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()
        new = keys.difference(self)
        if self.older and (again := new.intersection(self.older)):
            self.update(zip(again, map(self.older.__getitem__, again), strict=True))
            new -= again
        return new


class Tokenizer:
    """Ids of whole texts by a tokenizers file.

    A file with the rules PLAIN_RULES never joins what white space parts: the ids of a text are those of its chunks between
    spaces one after another, and those of a chunk are its pre-tokens' ones. Each distinct chunk is taken apart and each
    distinct pre-token encoded once; a chunk beyond Latin-1 is encoded by the library. With any other file, and with
    apart=False, the library encodes texts whole.
    """

    def __init__(self, path: str, apart: bool = True):
        from tokenizers import Tokenizer as Rust

        self.rust = Rust.from_file(path)
        self.chunks, self.tokens = Remembered(REMEMBERED), Remembered(REMEMBERED)
        rules = [json.loads(part.__getstate__()) if part else None for part in (self.rust.normalizer, self.rust.pre_tokenizer)]
        self.apart = apart and json.dumps(rules, sort_keys=True) == json.dumps(PLAIN_RULES, sort_keys=True)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.rust.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, chunks: set[str]) -> None:
        latin, of_latin = LATIN.fullmatch, LATIN_PARTS.findall
        plain = [c for c in chunks if latin(c) and "<|" not in c]  # <| may begin a special token
        odd = list(chunks.difference(plain))
        self.chunks.update(zip(odd, self.whole(odd), strict=True))
        # a word, and a word with one mark after it, need no pattern
        parts = [(c,) if c.isalpha() else (c[:-1], c[-1]) if c[:-1].isalpha() and c[-1] in MARKS else of_latin(c) for c in map(str.lower, plain)]
        encode, tokens = self.rust.model.tokenize, self.tokens
        for p in tokens.missing(set(itertools.chain.from_iterable(parts))):
            tokens[p] = array("I", [t.id for t in encode(p if p.isascii() else p.translate(LATIN_BYTES))]).tobytes()
        self.chunks.update(zip(plain, [tokens[ps[0]] if len(ps) == 1 else b"".join([tokens[p] for p in ps]) for ps in parts], strict=True))

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """An array of ids for each text, END not included."""
        texts = pc.fill_null(texts, "")
        if not self.apart:
            return [np.frombuffer(x, "<u4") for x in self.whole(texts.to_pylist())]
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        chunks = split.flatten().dictionary_encode()
        distinct = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.learn(self.chunks.missing(set(distinct)))
        each = list(map(self.chunks.__getitem__, distinct))
        size = np.fromiter(map(len, each), np.int64, len(each)) // 4
        flat = np.frombuffer(b"".join(each), "<u4")
        begin = np.concatenate([[0], np.cumsum(size)])[:-1]
        index = chunks.indices.to_numpy()
        n = size[index]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(begin[index] - ends[:-1], n) + np.arange(ends[-1])]
        of_text = ends[np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])]
        return [ids[a:b] for a, b in zip(of_text[:-1], of_text[1:], strict=True)]


@functools.cache
def tokenizer_of(path: str, apart: bool) -> Tokenizer:
    """One for all packing tasks of a worker."""
    FORGET.append(tokenizer_of.cache_clear)
    return Tokenizer(path, apart)


def gathered(batches: Iterator[pa.RecordBatch], limit: int = GATHERED) -> Iterator[pa.RecordBatch]:
    """The batches joined to about limit bytes: the more text at once, the fewer chunks that are distinct."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held += [batch] if batch.num_rows else []
        if sum(b.nbytes for b in held) >= limit:
            yield pa.concat_batches(held)
            held = []
            trim()
    if held:
        yield pa.concat_batches(held)


def tokenized_pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, apart: bool = True, gather: int = GATHERED) -> DataFrame:
    """(doc_id, tie, nth, start, length, ids_crc32, doc_tokens): every document's ids and the end id, cut into pieces of at most length.

    tie is a hash of the text and nth numbers equal rows within a task, so a task that is run again gives the same rows in any order.
    """


    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer_of(tokenizer, apart)
        seen: dict[tuple, int] = {}
        for part in gathered(batches, gather):
            out: list[tuple] = []
            for doc, tie, ids in zip(part.column("doc_id").to_pylist(), part.column("tie").to_pylist(), tok.ids(part.column("text")), strict=True):
                ids = np.append(ids, end).astype("<u4")
                seen[doc, tie] = nth = seen.get((doc, tie), -1) + 1
                out += [(doc, tie, nth, at, min(length, len(ids) - at), zlib.crc32(ids[at : at + length].tobytes()), len(ids)) for at in range(0, len(ids), length)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "tie", "nth", "start", "length", "ids_crc32", "doc_tokens"])

    slim = bounded(docs).select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tie"), "text")
    return slim.mapInArrow(run, "doc_id long, tie long, nth long, start long, length long, ids_crc32 long, doc_tokens long")


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, group_rows: int = GROUP_ROWS, seed: int = 42, gather: int = GATHERED) -> DataFrame:
    """The pieces of all documents with their sequence and offset.

    A null or empty text is the end id alone. Rows that repeat are documents of their own. Pieces lie without gaps from
    offset 0 of their sequence; sequence_id is the group's number times 2^32 plus the bin, so it is unique but not dense.
    An empty table gives no pieces. Other columns of docs are not read. gather: bytes of text that are tokenised at once; less
    takes less memory and more time.
    """
    groups = max(1, -(-docs.count() // group_rows))
    pieces = tokenized_pieces(docs, tokenizer, length, end, gather=gather).withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "tie", "nth"), F.lit(groups)))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in ("doc_id", "tie", "nth", "start")])
        sizes = rows.column("length").to_numpy()
        whole = sizes == length
        rest = np.flatnonzero(~whole)
        bins, offsets = first_fit_decreasing(sizes[rest].tolist(), length)
        sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        sequence[rest], offset[rest] = bins, offsets
        sequence[whole] = np.arange(whole.sum()) + (max(bins) + 1 if bins else 0)
        sequence += rows.column("group")[0].as_py() << 32
        kept = rows.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        return kept.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return pieces.groupBy("group").applyInArrow(run, PIECES)
