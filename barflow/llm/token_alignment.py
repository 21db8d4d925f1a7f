"""Alignment of two tokenizers over a corpus whose texts are told apart exactly.

Documents are grouped by their full text, so each distinct text is tokenised and aligned
once and counts as often as it occurs. Tasks cut the distinct texts into blocks of bounded
size. A block's rows are its texts, each with the numbers of the id pairs that it links,
and a dictionary of these pairs with the number of documents of the block that hold each. Spark adds the
dictionaries up, finds each left id's highest count, and joins the totals back to the
blocks, where every text's measures are sums over its pairs. What is shuffled is a row per
block and pair, not one per text and pair. Measures then join the documents by the
text's SHA-256.

Within a text, neither tokenizer has tokens that cross from a character that is no white space to
a space. There the text falls into chunks that are aligned on their own, and a task looks
each distinct chunk up once. A text with a chunk that does not come out whole is aligned
as one piece.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import _parts
from .common import cut, ship

ship(__name__)

#: Bytes of text in a block (a single longer text is a block of its own), pairs in a row of a dictionary, and chunks kept before the table starts anew.
BLOCK_BYTES, DICTIONARY_ROWS, MAX_CHUNKS = 8_000_000, 10_000, 400_000
#: What a byte-level tokenizer's own expression splits at.
BYTE_LEVEL = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BOUNDARY = re.compile(r"(?<=\S)(?= )")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteLevel:
    """A byte-level BPE tokenizer of a JSON file; strings of special tokens are plain text.

    Merges that make ids in rising order say the same as the ids themselves, which is
    verified; then ranks encode much faster than the file's own library.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model, before, known = whole["model"], whole["pre_tokenizer"] or {}, _byte_of()
        special = {t["content"] for t in whole["added_tokens"] if t["special"]}
        ranks = {bytes(known[c] for c in token): k for token, k in model["vocab"].items() if token not in special}
        self.tokens = [b""] * (1 + max(model["vocab"].values()))
        for token, k in ranks.items():
            self.tokens[k] = token
        made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        first = {ranks.get(bytes([b]), -1) for b in range(256)}
        plain = model["type"] == "BPE" and not whole["normalizer"] and not model.get("ignore_merges")
        if not plain or before.get("type") != "ByteLevel" or not before.get("use_regex") or before.get("add_prefix_space"):
            raise ValueError(f"{path} is no plain byte-level BPE tokenizer")
        if first & set(made) or -1 in first or made != sorted(made) or len(made) + 256 != len(ranks):
            raise ValueError(f"the merges of {path} are not in the order of its ids")
        self.coder = tiktoken.Encoding("left", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def encode(self, chunks: list[str]) -> list[list[int]]:
        """Ids of each chunk, which begins with a space."""
        return [self.coder.encode_ordinary(c) for c in chunks]


class Pieces:
    """A sentencepiece tokenizer that puts a space before each text."""

    def __init__(self, path: str):
        self.coder = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.coder.id_to_piece(k) for k in range(self.coder.get_piece_size())]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError(f"{path} has pieces that go on after a space")
        self.tokens = [
            bytes([int(p[1:-1], 16)]) if self.coder.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)
        ]

    def encode(self, chunks: list[str]) -> list[list[int]]:
        return self.coder.encode([c[1:] for c in chunks], num_threads=1)


@dataclass
class Aligned:
    """Measures of some chunks: counts and groups for each, pair codes with the chunk's number in ``at``."""

    whole: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    groups: list[str]
    at: np.ndarray
    pairs: np.ndarray


class Aligner:
    """Both tokenizers, and the chunks and pairs that a task has seen."""

    def __init__(self, left: str, right: str):
        self.a, self.b = ByteLevel(left), Pieces(right)
        self.size_a, self.size_b = (np.array([len(t) for t in x.tokens]) for x in (self.a, self.b))
        self.words_a = np.array([f"{k}{end}" for k in range(len(self.a.tokens)) for end in ",|"], object)
        self.words_b = np.array([f"{k}{end}" for k in range(len(self.b.tokens)) for end in ",;\n"], object)
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.numbers: dict[int, int] = {}
        self.groups: list[str] = []
        self.counts, self.glued, self.odd = np.zeros((0, 3), np.int64), np.zeros(0, bool), np.zeros(0, bool)
        self.starts, self.pairs = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def align(self, chunks: list[str]) -> Aligned:
        """Align chunks, each beginning with a space; those whose tokens do not give them again come out empty."""
        ids = self.a.encode(chunks), self.b.encode(chunks)
        given = [c.encode() for c in chunks]
        whole = np.array([
            b"".join(map(self.a.tokens.__getitem__, x)) == g == b"".join(map(self.b.tokens.__getitem__, y)) for x, y, g in zip(*ids, given)
        ], bool)
        for part in ids:
            for k in np.flatnonzero(~whole):
                part[k] = []
        n_a, n_b = (np.array([len(x) for x in part], np.int64) for part in ids)
        flat_a, flat_b = (np.fromiter((k for x in part for k in x), np.int64) for part in ids)
        if not len(flat_a):
            zero = np.zeros(0, np.int64)
            return Aligned(whole, n_a, n_b, np.zeros(len(chunks), np.int64), [""] * len(chunks), zero, zero)
        end_a, end_b = np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b])
        ends, is_end = np.zeros(end_a[-1] + 1, np.int8), (1, 2)
        ends[end_a] += is_end[0]
        ends[end_b] += is_end[1]
        place = np.flatnonzero(ends)
        kind = ends[place]
        # Both sides' tokens over each stretch between ends; a stretch lies in one token of either side.
        over_a, over_b = (np.cumsum(kind & bit > 0) - (kind & bit > 0) for bit in is_end)
        common = np.flatnonzero(kind == 3)
        done_a, done_b = np.r_[0, over_a[common] + 1], np.r_[0, over_b[common] + 1]
        group_a = np.repeat(np.arange(len(common)), np.diff(done_a))
        group_b = np.repeat(np.arange(len(common)), np.diff(done_b))
        chunk_of = np.repeat(np.arange(len(chunks)), n_a)[over_a]
        last_a, last_b = np.zeros(len(flat_a), np.int64), np.zeros(len(flat_b), np.int64)
        last_a[done_a[1:] - 1] = 1
        last_b[done_b[1:] - 1] = 1
        last_b[np.cumsum(n_b)[n_b > 0] - 1] = 2
        words = np.empty(len(flat_a) + len(flat_b), object)
        words[np.arange(len(flat_a)) + done_b[group_a]] = self.words_a[2 * flat_a + last_a]
        words[np.arange(len(flat_b)) + done_a[group_b + 1]] = self.words_b[3 * flat_b + last_b]
        lines = iter("".join(words.tolist()).split("\n"))
        groups = [next(lines) if n else "" for n in n_a.tolist()]
        n_groups = np.bincount(chunk_of[common], minlength=len(chunks))
        return Aligned(whole, n_a, n_b, n_groups, groups, chunk_of, flat_a[over_a] << 32 | flat_b[over_b])

    def _number(self, codes: np.ndarray) -> np.ndarray:
        """The task's numbers of pair codes; new ones are entered."""
        distinct, back = np.unique(codes, return_inverse=True)
        numbers = self.numbers
        return np.fromiter((numbers.setdefault(c, len(numbers)) for c in distinct.tolist()), np.int32, len(distinct))[back]

    def learn(self, keys: list[str]) -> None:
        """Enter chunks by what follows their first space."""
        for part in _parts([len(k) for k in keys], 1_000_000):
            some = keys[part]
            found = self.align([" " + k for k in some])
            self.at.update(zip(some, range(len(self.groups), len(self.groups) + len(some))))
            self.groups += found.groups
            self.counts = np.concatenate([self.counts, np.stack([found.n_a, found.n_b, found.n_groups], 1)])
            self.glued = np.append(self.glued, [not k or k[-1].isspace() for k in some])
            self.odd = np.append(self.odd, ~found.whole)
            ends = self.starts[-1] + np.cumsum(np.bincount(found.at, minlength=len(some)))
            self.starts = np.append(self.starts, ends)
            self.pairs = np.append(self.pairs, self._number(found.pairs))

    def texts(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Per text n_a, n_b and n_groups; its groups; and (text, pair number) of each link."""
        if len(self.at) > MAX_CHUNKS:
            self.forget()
        cuts = [t.split(" ") for t in texts]
        seen: set[str] = set()
        for x in cuts:
            seen.update(x)
        self.learn([k for k in seen if k not in self.at])
        found = [np.fromiter(map(self.at.__getitem__, x), np.int64, len(x)) for x in cuts]
        again = [k for k, x in enumerate(found) if self.glued[x[:-1]].any()]  # a space there may follow white space
        cuts = {k: [c[1:] for c in BOUNDARY.split(" " + texts[k])] for k in again}
        self.learn(list({c for x in cuts.values() for c in x}.difference(self.at)))
        for k, x in cuts.items():
            found[k] = np.fromiter(map(self.at.__getitem__, x), np.int64, len(x))
        counts = np.array([self.counts[x].sum(axis=0) for x in found], np.int64).reshape(-1, 3)
        groups = [";".join(map(self.groups.__getitem__, x.tolist())) for x in found]
        direct = []
        for k in [k for k, x in enumerate(found) if self.odd[x].any()]:
            one = self.align([" " + texts[k]])
            counts[k], groups[k], found[k] = (one.n_a[0], one.n_b[0], one.n_groups[0]), one.groups[0], np.zeros(0, np.int64)
            direct.append((k, self._number(one.pairs)))
        chunks = np.concatenate(found) if found else np.zeros(0, np.int64)
        sizes = self.starts[chunks + 1] - self.starts[chunks]
        first = np.repeat(self.starts[chunks] - (np.cumsum(sizes) - sizes), sizes)
        text = np.repeat(np.repeat(np.arange(len(texts)), [len(x) for x in found]), sizes)
        pair = self.pairs[first + np.arange(len(first))]
        for k, more in direct:
            text, pair = np.append(text, np.full(len(more), k)), np.append(pair, more)
        return counts, groups, text, pair


BLOCK = "block long, text_key binary, n_a long, n_b long, n_groups long, groups string, pair array<int>, times array<int>, start int, code array<long>, held array<long>"


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(values, kind))


def _block_rows(aligner: Aligner, number: int, keys: list[bytes], copies: list[int], texts: list[str], digest: bool) -> Iterator[pa.RecordBatch]:
    """A block's texts, each pair it links once with the number of its links; then the block's dictionary."""
    counts, groups, text, pair = aligner.texts(texts)
    if digest:
        groups = [hashlib.sha256(g.encode()).hexdigest() if n else "" for g, n in zip(groups, counts[:, 0].tolist())]
    key = np.sort(text << 32 | pair)
    fresh = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.r_[fresh, len(key)])
    text, pair = key[fresh] >> 32, key[fresh] & 0xFFFFFFFF
    used = np.zeros(len(aligner.numbers) + 1, bool)
    used[pair] = True
    place = np.cumsum(used) - 1
    held = np.zeros(int(used.sum()), np.int64)
    np.add.at(held, place[pair], np.array(copies, np.int64)[text])
    code = np.fromiter(aligner.numbers, np.int64, len(aligner.numbers))[np.flatnonzero(used)]
    n, sizes = len(texts), np.bincount(text, minlength=len(texts))
    names = [c.split()[0] for c in BLOCK.split(", ")]
    columns = [
        pa.array([number] * n, pa.int64()), pa.array(keys, pa.binary()), *(pa.array(counts[:, k]) for k in range(3)), pa.array(groups, pa.string()),
        _lists(place[pair], sizes, pa.int32()), _lists(times, sizes, pa.int32()),
        pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64())),
    ]
    yield pa.RecordBatch.from_arrays(columns, names)
    for start in range(0, len(code), DICTIONARY_ROWS):
        part = slice(start, start + DICTIONARY_ROWS)
        values = {"block": number, "start": start, "code": code[part].tolist(), "held": held[part].tolist()}
        yield pa.RecordBatch.from_pylist([values], schema=pa.schema([pa.field(c, x.type) for c, x in zip(names, columns)]))


def _blocks(left: str, right: str, digest: bool):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        aligner, number = Aligner(left, right), TaskContext.get().partitionId() << 32
        keys, copies, texts, size = [], [], [], 0
        for batch in batches:
            for key, n, text in zip(*(c.to_pylist() for c in batch.columns)):
                if texts and size + len(text) > BLOCK_BYTES:
                    yield from _block_rows(aligner, number, keys, copies, texts, digest)
                    keys, copies, texts, size, number = [], [], [], 0, number + 1
                keys.append(key)
                copies.append(n)
                texts.append(text)
                size += len(text)
        if texts:
            yield from _block_rows(aligner, number, keys, copies, texts, digest)

    return run


MEASURES = "text_key binary, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def _measure(texts: pa.Table, known: pa.Table) -> pa.Table:
    """A block's texts with the sums over their links of what the pairs count."""
    order = np.argsort(known["place"].to_numpy())
    count, best = known["count"].to_numpy()[order], known["best"].to_numpy()[order].astype(np.int64)
    pairs, times = texts["pair"].combine_chunks(), texts["times"].combine_chunks()
    pair, n = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
    text = np.repeat(np.arange(len(texts)), pairs.value_lengths().to_numpy())
    sums = np.zeros((3, len(texts)), np.int64)
    for row, of in zip(sums, (n, n * best[pair] if len(pair) else n, n * count[pair] if len(pair) else n)):
        np.add.at(row, text, of)
    same = texts.select(["text_key", "n_a", "n_b", "n_groups"])
    for name, row in zip(("n_links", "n_best", "count_sum"), sums):
        same = same.append_column(name, pa.array(row))
    return same.append_column("groups", texts["groups"])


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(code, count, best): in how many documents an id pair (left << 32 | right) is linked, and whether that is its left id's highest count."""
    entries = blocks.filter("code is not null").select(F.inline(F.arrays_zip("code", "held")))
    counts = entries.groupBy("code").agg(F.sum("held").alias("count"))
    highest = F.max("count").over(Window.partitionBy(F.shiftright("code", 32)))
    return counts.select("code", "count", (F.col("count") == highest).alias("best"))


def _key(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def align(docs: DataFrame, left: str, right: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum and ``groups``.

    ``left`` is the JSON file of a byte-level BPE tokenizer and ``right`` a sentencepiece
    model, both at places that every worker can read. ``groups`` lists the ids between
    byte offsets where both sides end, as ``a1,a2|b1;a3|b2,b3``, or its SHA-256 in
    hexadecimal if ``digest``. A text that is null or empty, or that either side's tokens
    do not give again byte by byte, has zeros and no groups. Equal texts are aligned once and
    get equal rows; ids may be null or repeated. Other columns are not read. A task holds
    one block of texts, or a single text that is longer.
    """
    known = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    texts = known.filter(F.length("_text") > 0).groupBy("_text").agg(F.count(F.lit(1)).alias("copies"))
    given = texts.select(_key(F.col("_text")).alias("text_key"), "copies", "_text")
    blocks = cut(given.mapInArrow(_blocks(left, right, digest), BLOCK))
    entries = blocks.filter("code is not null").select("block", "start", F.posexplode("code").alias("k", "code"))
    back = entries.join(pair_counts(blocks), "code").select(
        F.col("block").alias("of_block"), (F.col("start") + F.col("k")).alias("place"), "count", "best"
    )
    of_text = blocks.filter("text_key is not null").drop("start", "code", "held")
    measures = of_text.groupBy("block").cogroup(back.groupBy("of_block")).applyInArrow(_measure, MEASURES)
    # A document without text has a key that no text has, other for each id, so that such rows do not meet in one task.
    key = F.coalesce(F.when(F.length("_text") > 0, _key(F.col("_text"))), F.unhex(F.hex(F.xxhash64("_id"))))
    out = known.select("_id", key.alias("text_key")).join(measures, "text_key", "left")
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    return out.select(
        F.col("_id").alias(id_col), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce("groups", F.lit("")).alias("groups")
    )
