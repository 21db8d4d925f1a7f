"""Benchmark decontamination by spaced-seed hashing.

Fixed masks pick some of the words in a span and ignore the others, so a seed survives
substitutions at ignored places. Training texts are hashed under every mask in their
scan; a Bloom filter of fixed size over the benchmark's seeds drops nearly all seeds that
no benchmark item has, and none that one has. What is left joins the benchmark's seed
table, and each joined diagonal is verified by extending over both word sequences.

Items of few words may lose every such seed to the substitutions they tolerate. They are
cut into one piece more than that: a piece stays whole, and its first three words are a
seed. Items of one or two words would be found in any text; they leak only where they are
the whole of one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, row_key, ship, whole_text

ship(__name__)

#: Which words of a span count, for each mask. Six words count in each.
MASKS = ("111111", "11011011", "1011010011", "1100110011", "10101010101")
#: What counts in the first words of a piece of a short item.
PIECE = "111"
#: A leak is an extension whose matches less twice its substitutions reach this, or a whole item that is shorter.
MIN_SCORE, MISMATCH = 10, 2
#: A leak is a whole item, too, of which this share of words is equal; items of fewer words are matched as they stand.
SAME, MIN_TOLERANT = 0.8, 6
#: Words kept on either side of hits for the extension.
AROUND = 256
#: log2 of the filter's bits: at least (16 MB), at most (64 MB), and the bits it should have per seed of the benchmark.
MIN_BITS, MAX_BITS, BITS_A_SEED = 27, 29, 64

_SEPARATORS = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
_TO_SPACE = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of a text's words; letters A to Z count as small, ASCII punctuation as space."""
    words = text.encode("utf-8", "surrogatepass").lower().translate(_TO_SPACE).split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def seeds(hashes: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
    """Number and (places, seeds) for each mask, that of pieces and whole short texts last, over texts laid end to end; ``ends`` has each word's end of text."""
    for number, mask in enumerate((*MASKS, PIECE)):
        n = len(hashes) - len(mask) + 1
        if n <= 0:
            continue
        total = np.full(n, number + 1, np.uint64)
        for k, bit in enumerate(mask):
            if bit == "1":
                total = _mix(total * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + n])
        inside = np.flatnonzero(np.arange(len(mask), n + len(mask)) <= ends[:n])
        yield number, (inside, total[inside])
    place = np.arange(len(hashes))
    first = place == np.r_[0, ends[:-1]][: len(ends)]
    for size in range(1, len(PIECE)):  # texts of fewer words than any mask
        whole = np.flatnonzero(first & (ends - place == size))
        total = np.full(len(whole), len(MASKS) + 1 + size, np.uint64)
        for k in range(size):
            total = _mix(total * np.uint64(0xD6E8FEB86659FD93) + hashes[whole + k])
        yield len(MASKS) + size, (whole, total)


def _probes(found: np.ndarray, log_bits: int) -> tuple[np.ndarray, np.ndarray]:
    bits = np.uint64((1 << log_bits) - 1)
    return (found & bits).astype(np.int64), ((found >> np.uint64(64 - log_bits)) & bits).astype(np.int64)


def _laid_out(texts: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [word_hashes(t) for t in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    starts = np.cumsum(sizes) - sizes
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), starts, np.repeat(starts + sizes, sizes)


def pieces(n: int) -> list[int]:
    """Where an item of n words has its pieces' seeds; none where the score finds all that ``SAME`` allows."""
    if n < len(PIECE) or n * (SAME - MISMATCH * (1 - SAME)) >= MIN_SCORE:
        return []
    wrong = n - int(np.ceil(SAME * n - 1e-6)) if n >= MIN_TOLERANT else 0
    return [n * k // (wrong + 1) for k in range(wrong + 1)]


def _benchmark_seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        hashes, starts, ends = _laid_out(batch["text"])
        sizes = np.diff([*starts, len(hashes)])
        owner = np.repeat(np.arange(len(batch)), sizes)
        heads = [start + k for start, n in zip(starts, sizes) for k in pieces(int(n))]
        for number, (places, found) in seeds(hashes, ends):
            if number == len(MASKS):
                chosen = np.isin(places, heads)
                places, found = places[chosen], found[chosen]
            who = owner[places]
            yield pd.DataFrame({"seed": found.view(np.int64), "item": batch["item"].to_numpy()[who], "item_at": (places - starts[who]).astype(np.int32)})


def _item_words(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([word_hashes(t).view(np.int64) for t in texts])


def _filter_words(log_bits: int):
    """Set words of the filter, one row each, merged by bit_or afterwards."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.concatenate(_probes(batch["seed"].to_numpy().view(np.uint64), log_bits))
            word, inverse = np.unique(found >> 6, return_inverse=True)
            bits = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(bits, inverse, np.uint64(1) << (found & 63).astype(np.uint64))
            yield pd.DataFrame({"word": word, "bits": bits.view(np.int64)})

    return run


def _filter(bench: DataFrame) -> np.ndarray:
    """The Bloom filter: of a size for the benchmark's seeds, but of ``MAX_BITS`` at most; no more than its words reach the driver."""
    log_bits = min(MAX_BITS, max(MIN_BITS, int(bench.count() * BITS_A_SEED).bit_length()))
    words = bench.select("seed").mapInPandas(_filter_words(log_bits), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(1 << (log_bits - 6), np.uint64)
    rows = words.toArrow()
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def _regions(filter_of: "object") -> "object":
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = filter_of.value
        log_bits = 5 + len(table).bit_length()
        has = lambda p: (table[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1)
        for whole in batches:
            for part in range(0, len(whole), 512):  # bounds the hash arrays, not the rows
                batch = whole.iloc[part : part + 512]
                hashes, starts, ends = _laid_out(batch["text"])
                hits = []
                for _, (places, found) in seeds(hashes, ends):
                    one, two = _probes(found, log_bits)
                    keep = np.flatnonzero(has(one))
                    keep = keep[has(two[keep]).astype(bool)]
                    hits.append((places[keep], found[keep]))
                if not hits or not sum(len(p) for p, _ in hits):
                    continue
                places = np.concatenate([p for p, _ in hits])
                order = np.argsort(places, kind="stable")
                places, found = places[order], np.concatenate([f for _, f in hits])[order]
                doc = np.searchsorted(starts, places, side="right") - 1
                new = np.flatnonzero(np.r_[True, (np.diff(doc) != 0) | (np.diff(places) > AROUND)])
                rows = []
                for a, b in zip(new, [*new[1:], len(places)]):
                    d = doc[a]
                    low = max(starts[d], places[a] - AROUND)
                    high = min(ends[places[a]], places[b - 1] + AROUND)
                    rows.append((
                        batch["row_id"].iloc[d], batch["row_hash"].iloc[d], int(low - starts[d]), hashes[low:high].view(np.int64),
                        found[a:b].view(np.int64), (places[a:b] - low).astype(np.int32),
                    ))
                yield pd.DataFrame(rows, columns=["row_id", "row_hash", "region", "words", "seeds", "at"])

    return run


def _score(words: Column, item: Column, diagonal: Column) -> Column:
    """Best-scoring run of aligned words: +1 for equal words, -MISMATCH for a substitution."""
    first = F.greatest(F.lit(0), -diagonal)
    last = F.least(F.size(item), F.size(words) - diagonal) - 1
    state = F.aggregate(
        F.sequence(first, last),
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("best")),
        lambda a, k: F.struct(
            F.greatest(F.lit(0), a["now"] + F.when(F.get(item, k) == F.get(words, k + diagonal), 1).otherwise(-MISMATCH)).alias("now"),
            F.greatest(a["best"], a["now"] + F.when(F.get(item, k) == F.get(words, k + diagonal), 1).otherwise(-MISMATCH)).alias("best"),
        ),
    )
    return F.when(last >= first, state["best"]).otherwise(0)


def _same_share(words: Column, item: Column, diagonal: Column) -> Column:
    """Share of an item's words that are equal where the whole item stands in the words; zero where it does not."""
    inside = (diagonal >= 0) & (diagonal + F.size(item) <= F.size(words))
    here = F.slice(words, F.greatest(diagonal, F.lit(0)) + 1, F.size(item))
    same = F.aggregate(F.zip_with(item, here, lambda a, b: F.when(a == b, 1).otherwise(0)), F.lit(0), lambda a, b: a + b)
    return F.when(inside, same / F.size(item)).otherwise(0.0)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_id, row_hash, item_id, score) of every benchmark item that a document holds, with substitutions.

    ``row_id`` and ``row_hash`` are ``row_key`` of the document. An item leaks where
    its best run reaches the score, or where it stands whole with ``SAME`` of its words.
    Items of three to five words leak as they stand, those of one or two only where they
    are a whole text. An item with a null id is an item like any other and is told apart
    by its row; one id may have several texts, which give a row each. Nulls and empty
    texts hold nothing; repeated rows give one set of results.
    """
    items = cut(
        benchmark.select("item_id", whole_text("text").alias("text")).distinct()
        .withColumns({"item": F.monotonically_increasing_id(), "item_words": F.pandas_udf(_item_words, "array<long>")("text")})
    )
    bench = cut(items.select("item", "text").mapInPandas(_benchmark_seeds, "seed long, item long, item_at int"))
    shared = docs.sparkSession.sparkContext.broadcast(_filter(bench))
    texts = docs.select(*row_key(id_col, text_col), whole_text(text_col).alias("text"))
    regions = cut(
        texts.mapInPandas(
            _regions(shared),
            "row_id long, row_hash long, region int, words array<long>, seeds array<long>, at array<int>",
        )
    )
    hits = regions.select("row_id", "row_hash", "region", F.explode(F.arrays_zip("seeds", "at")).alias("h"))
    found = (
        hits.select("row_id", "row_hash", "region", F.col("h.seeds").alias("seed"), F.col("h.at").alias("at"))
        .join(bench, "seed").select("row_id", "row_hash", "region", "item", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct()
    )
    aligned = found.join(regions.select("row_id", "row_hash", "region", "words").dropDuplicates(["row_id", "row_hash", "region"]), ["row_id", "row_hash", "region"])
    scored = aligned.join(items.select("item", "item_id", "item_words"), "item").select(
        "row_id", "row_hash", "item", "item_id",
        _score(F.col("words"), F.col("item_words"), F.col("diagonal")).alias("score"),
        _same_share(F.col("words"), F.col("item_words"), F.col("diagonal")).alias("same"), F.size("item_words").alias("n"),
    )
    tolerant = (F.col("n") >= MIN_TOLERANT) & (F.col("same") >= SAME - 1e-6)
    return (
        scored.filter((F.col("score") >= F.least(F.lit(MIN_SCORE), F.col("n"))) | tolerant)
        .groupBy("row_id", "row_hash", "item").agg(F.max("score").alias("score"), F.first("item_id").alias("item_id"))
        .select("row_id", "row_hash", "item_id", "score")
    )


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_items`` it holds, the item of the best score (least id on ties) and that score."""
    best = leaks(docs, benchmark, id_col, text_col).groupBy("row_id", "row_hash").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.min_by("item_id", F.struct(-F.col("score"), "item_id")).alias("best_item"),
        F.max("score").alias("best_score"),
    )
    rows = docs.select(F.col(id_col), *row_key(id_col, text_col))
    return rows.join(best, ["row_id", "row_hash"], "left").select(
        id_col, F.coalesce("n_items", F.lit(0)).alias("n_items"), "best_item", F.coalesce("best_score", F.lit(0)).alias("best_score"),
        F.col("n_items").isNotNull().alias("leaked"),
    )


def drop_leaked(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold no benchmark item, with their own columns only."""
    found = cut(leaks(docs, benchmark, id_col, text_col).select("row_id", "row_hash").distinct())
    packed = docs.select(F.struct(*docs.columns).alias("_row"), *row_key(id_col, text_col))
    return packed.join(found, ["row_id", "row_hash"], "left_anti").select("_row.*")
