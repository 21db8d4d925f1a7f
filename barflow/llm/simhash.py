"""SimHash near-duplicates by pivot distance tables.

A fingerprint's table row holds its Hamming distances to many reference fingerprints
(pivots), the same for all. Since |d(x, p) - d(y, p)| <= d(x, y), a pair whose
coordinates differ by more than the link distance somewhere cannot link and is
discarded; the fingerprints of the survivors are compared.

Coordinates discard pairs but cannot name them: two unrelated fingerprints agree within
four at one pivot in 57 of 100 cases, and sixteen pivots leave one such pair in a
thousand or fewer. So pairs to discard come from a pigeonhole rule. The 64 bits are cut
into runs; links differ in ``LINK_BITS`` = 4 bits at most, which touch at most four runs,
so linked fingerprints have all other runs in common. There is a join key for each choice
of these, and no link is lost. The number of runs grows with the number of fingerprints
(``runs_for``): more runs make longer keys, which few unrelated fingerprints share.

Copies share one fingerprint and one row here. A dense group of near copies is not
compared pair by pair: first every fingerprint is compared with one hub of its bucket
(the one that most documents carry), then only fingerprints that are not yet connected
with their hub are compared with their bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations
from math import comb
from operator import and_

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, discard, free_shuffles, row_key, ship, whole_text
from .components import components

ship(__name__)

SHINGLE, SEED, LINK_BITS, PIVOTS = 4, 42, 4, 16
#: Fewest and most runs of bits, and what a row of a key costs as compared with a pair.
MIN_RUNS, MAX_RUNS, ROW_COST = 6, 10, 20


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _references(n: int) -> list[int]:
    """n spread-out 64-bit numbers: multiples of the golden ratio's fraction."""
    return [((k + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1) for k in range(n)]


def _runs(n: int) -> list[int]:
    """A mask for each of n runs of bits."""
    edges = [64 * k // n for k in range(n + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]


def runs_for(n: int) -> int:
    """Runs at which n fingerprints cost least: rows of all keys, and pairs that share one by chance."""
    cost = lambda r: comb(r, LINK_BITS) * (ROW_COST * n + n * n / 2 ** (64 * (r - LINK_BITS) // r + 1))
    return min(range(MIN_RUNS, MAX_RUNS + 1), key=cost)


def fingerprint(text: str) -> int:
    """64-bit SimHash of a text's word shingles, as a signed long; zero without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - SHINGLE + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(SHINGLE, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, stops)])
    # Bits of the big-endian digests, most significant first; parts bound the unpacked array.
    rows, counts = np.frombuffer(hashes, np.uint8).reshape(-1, 8), np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        counts += np.unpackbits(rows[k : k + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([fingerprint(t) for t in texts], dtype="int64")


def with_fingerprint(docs: DataFrame, text_col: str = "text", out: str = "fp") -> DataFrame:
    """The documents with their fingerprint in column ``out``, which replaces one of that name."""
    column = F.pandas_udf(_fingerprints, T.LongType())
    return docs.withColumn(out, column(whole_text(text_col)))


def _distance(x: Column | int, y: Column) -> Column:
    return F.bit_count(F.lit(x).bitwiseXOR(y) if isinstance(x, int) else x.bitwiseXOR(y))


def pivot_table(classes: DataFrame, runs: int = MIN_RUNS) -> DataFrame:
    """classes (fp, n): with ``pivots``, the distances to all references in bytes of longs, and ``keys``, one for each choice of runs."""
    fp, packed = F.col("fp"), []
    for k, p in enumerate(_references(PIVOTS)):
        if k % 8 == 0:
            packed.append(F.lit(0).cast("long"))
        packed[-1] = packed[-1].bitwiseOR(F.shiftleft(_distance(_signed(p), fp).cast("long"), 8 * (k % 8)))
    masks = [sum(chosen) for chosen in combinations(_runs(runs), runs - LINK_BITS)]
    keys = [F.xxhash64(fp.bitwiseAND(F.lit(_signed(m))), F.lit(k)) for k, m in enumerate(masks)]
    return classes.select("fp", "n", F.array(*packed).alias("pivots"), F.array(*keys).alias("keys"))


def _may_link(x: str, y: str) -> Column:
    """Largest coordinate difference within the link distance."""
    at = lambda side, k: F.shiftrightunsigned(F.col(f"{side}.pivots")[k // 8], 8 * (k % 8)).bitwiseAND(F.lit(255))
    return reduce(and_, [F.abs(at(x, k) - at(y, k)) <= LINK_BITS for k in range(PIVOTS)])


def _link(x: str, y: str) -> Column:
    return _may_link(x, y) & (_distance(F.col(f"{x}.node"), F.col(f"{y}.node")) <= LINK_BITS)


def links(
    rows: DataFrame, close: Callable[[str, str], Column], verify: Callable[[DataFrame], DataFrame] = cut
) -> DataFrame:
    """Stored links (src, dst) that connect what the full link graph connects.

    rows: a stored table (key, node, n, ...); only nodes that share a key can link. A pair
    links if ``close``, over the aliases it gets, holds and ``verify``, which stores what
    it is given, keeps it. First each node is compared with the hub of each of its buckets, the node of largest n. Then
    nodes that are not connected with a hub of theirs are compared with their whole
    bucket. A dense bucket, all in one component by then, gives nothing more.
    """
    payload = [c for c in rows.columns if c not in ("key", "n")]
    hubs = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("size"), F.max_by(F.struct(*payload), F.struct("n", "node")).alias("hub")
    ).filter("size > 1")
    hubs = cut(hubs.select("key", "hub.*"))
    free_shuffles(rows.sparkSession)
    pairs = lambda df, x, y: df.select(F.col(f"{x}.node").alias("src"), F.col(f"{y}.node").alias("dst")).distinct()
    near_hub = rows.alias("x").join(hubs.alias("h"), F.col("x.key") == F.col("h.key"))
    spokes = verify(pairs(near_hub.filter((F.col("x.node") != F.col("h.node")) & close("x", "h")), "x", "h"))
    named = components(spokes)
    component = lambda df, out: df.join(named, "node", "left").select(*df.columns, F.coalesce("component", "node").alias(out))
    hub_of = component(hubs.select("key", "node"), "hub_c").select("key", "hub_c")
    known = cut(component(rows.select("key", *payload), "c").join(hub_of, "key"))
    free_shuffles(rows.sparkSession)
    apart = known.filter("c <> hub_c")
    met = apart.alias("x").join(known.alias("y"), F.col("x.key") == F.col("y.key")).filter(
        (F.col("x.c") != F.col("y.c")) & ((F.col("y.c") == F.col("y.hub_c")) | (F.col("x.node") < F.col("y.node"))) & close("x", "y")
    )
    more = verify(pairs(met, "x", "y"))
    found = cut(spokes.union(more))
    discard(hubs, spokes, named, known, more)
    free_shuffles(rows.sparkSession)
    return found


def linked_fingerprints(prints: DataFrame) -> DataFrame:
    """Stored table (fp, first, component) of the distinct fingerprints of prints (_id, fp): least id, and class by links."""
    classes = cut(prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("first")))
    table = pivot_table(classes, runs_for(classes.count()))
    rows = cut(table.select(F.explode("keys").alias("key"), F.col("fp").alias("node"), "n", "pivots"))
    found = links(rows, _link)
    discard(rows)
    named = components(found)
    discard(found)
    return cut(classes.join(named.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component")
    ))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``fingerprint`` (16 hexadecimal digits) and ``component_id``, the least id reachable by links.

    Nulls: a null text counts as empty; texts without words have fingerprint zero and
    link like any other. A null id keeps its row and never names a component unless the
    component has no other id. Repeated rows give a row each; extra columns are not read.
    """
    prints = cut(with_fingerprint(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text").select("_id", "fp"))
    class_of = linked_fingerprints(prints)
    least = class_of.groupBy("component").agg(F.min("first").alias("component_id"))
    member = cut(class_of.join(least, "component").select("fp", "component_id"))
    return prints.join(member.hint("merge"), "fp").select(
        F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


# Near copies by similarity. Sets of similarity t and more share one of their first
# n - ceil(t * n) + 1 shingles in any order that is the same for all sets. These are the
# keys, so no pair is lost. The order takes rare shingles first: those that many texts
# hold among their first ones come last. Which they are is a matter of cost only.

SET_SHINGLE, SIMILARITY = 5, 0.8
#: Bits of a set's parity map: two maps differ in no more bits than their sets do in shingles.
PARITY_BITS = 512
#: Texts from which a shingle comes late in the order, and the shingles (most frequent first) that the order knows at most.
HOT, MAX_HOT = 16, 1 << 20
#: Slack of the bounds against rounding; it only adds pairs to verify.
SLACK = 1e-6


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's five-word shingles (the whole text if it has fewer words; none without words)."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(SET_SHINGLE, len(words))
    total = np.full(len(words) - size + 1 if size else 0, size, np.uint64)
    for k in range(size):
        total = (total ^ each[k : k + len(total)]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return np.unique(total)


def prefix_size(n: int, similarity: float) -> int:
    """Shingles of which two sets of this similarity share one at least."""
    return n and n - int(np.ceil(similarity * n - SLACK)) + 1


def _firsts(similarity: float):
    """Shingles at which each text may meet another, and the number of texts of the batch that have them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(t) for t in batch["text"]]
            firsts = [s[: 2 * prefix_size(len(s), similarity)] for s in sets]
            shingles, n = np.unique(np.concatenate(firsts) if firsts else np.empty(0, np.uint64), return_counts=True)
            yield pd.DataFrame({"shingle": shingles.view(np.int64), "n": n})

    return run


def _hot(texts: DataFrame, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles, sorted, and the binary order of magnitude of their texts."""
    counts = texts.select("text").mapInPandas(_firsts(similarity), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    rows = counts.filter(F.col("n") >= HOT).orderBy(F.desc("n"), "shingle").limit(MAX_HOT).toArrow()
    shingles, n = rows["shingle"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(shingles)
    return shingles[order], np.frexp(n[order].astype(float))[1].astype(np.int8)


def _profiles(hot_of: "object", similarity: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hot, level = hot_of.value
        for batch in batches:
            rows = []
            for text in batch["text"]:
                s = shingle_set(text)
                late = np.zeros(len(s), np.int8)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                    late = np.where(hot[at] == s, level[at], 0)
                keys = s[np.argsort(late, kind="stable")][: prefix_size(len(s), similarity)]
                parity = np.bincount((s & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
                rows.append((
                    xxhash.xxh64_intdigest(s.tobytes()), len(s), keys.view(np.int64), np.packbits(parity.astype(np.uint8)).view(np.int64),
                ))
            yield pd.DataFrame({
                "id": batch["id"].to_numpy(), "row_id": batch["row_id"].to_numpy(), "row_hash": batch["row_hash"].to_numpy(),
                "node": np.array([r[0] for r in rows], np.uint64).view(np.int64), "size": np.array([r[1] for r in rows], np.int32),
                "keys": [r[2] for r in rows], "parity": [r[3] for r in rows],
            })

    return run


def _may_be_alike(similarity: float) -> Callable[[str, str], Column]:
    """Bounds that every pair of this similarity meets at its first common key: sizes, shingles left there, and parity maps."""

    def close(x: str, y: str) -> Column:
        at = lambda side, c: F.col(f"{side}.{c}")
        both = at(x, "size") + at(y, "size")
        left = F.least(at(x, "size") - at(x, "place"), at(y, "size") - at(y, "place"))
        apart = sum((F.bit_count(at(x, "parity")[k].bitwiseXOR(at(y, "parity")[k])) for k in range(PARITY_BITS // 64)), F.lit(0))
        return (
            (F.least(at(x, "size"), at(y, "size")) >= F.lit(similarity) * F.greatest(at(x, "size"), at(y, "size")) - SLACK)
            & (left >= F.lit(similarity / (1 + similarity)) * both - SLACK)
            & (apart <= F.lit((1 - similarity) / (1 + similarity)) * both + SLACK)
        )

    return close


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"node": batch["node"], "shingles": [shingle_set(t).view(np.int64) for t in batch["text"]]})


def _alike(texts: DataFrame, nodes: DataFrame, similarity: float) -> Callable[[DataFrame], DataFrame]:
    """Keeps pairs whose shingle sets are alike; sets are read for those pairs' nodes only."""

    def verify(pairs: DataFrame) -> DataFrame:
        near = cut(pairs)
        ends = near.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        chosen = cut(nodes.join(ends, "node", "left_semi").select("node", "row_id", "row_hash"))
        free_shuffles(near.sparkSession)
        sets = cut(texts.join(chosen, ["row_id", "row_hash"]).select("node", "text").mapInPandas(_sets, "node long, shingles array<long>").dropDuplicates(["node"]))
        free_shuffles(near.sparkSession)
        of = lambda end: sets.select(F.col("node").alias(end), F.col("shingles").alias(f"s_{end}"))
        both = F.size(F.array_intersect("s_src", "s_dst"))
        alike = cut(
            near.join(of("src"), "src").join(of("dst"), "dst").filter(
                both >= F.lit(similarity) * (F.size("s_src") + F.size("s_dst") - both)
            ).select("src", "dst")
        )
        discard(near, chosen, sets)
        free_shuffles(near.sparkSession)
        return alike

    return verify


def similar_documents(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_id, row_hash, id, component, component_id): groups of documents that links of similarity 0.8 or more connect.

    Similarity is that of the sets of five-word shingles, letters A to Z in small. Texts
    with equal sets, texts without words among them, are always one group. Ids are cast
    to long; a null id never names a group unless there is no other.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), *row_key(id_col, text_col), whole_text(text_col).alias("text"))
    hot = docs.sparkSession.sparkContext.broadcast(_hot(texts, similarity))
    free_shuffles(docs.sparkSession)
    wide = cut(texts.mapInPandas(_profiles(hot, similarity), "id long, row_id long, row_hash long, node long, size int, keys array<long>, parity array<long>"))
    who = cut(wide.select("id", "row_id", "row_hash", "node"))
    nodes = cut(
        wide.groupBy("node").agg(
            F.count(F.lit(1)).alias("n"), F.min("id").alias("first"),
            *[F.first(c).alias(c) for c in ("row_id", "row_hash", "size", "keys", "parity")],
        )
    )
    discard(wide)
    free_shuffles(docs.sparkSession)
    shared = cut(nodes.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("key"))
    met = cut(nodes.select(F.posexplode("keys").alias("place", "key"), "node").join(shared, "key", "left_semi"))
    slim = cut(nodes.drop("keys"))
    discard(nodes)
    nodes = slim
    free_shuffles(docs.sparkSession)
    rows = cut(met.join(nodes.select("node", "n", "size", "parity"), "node").select("key", "node", "n", "place", "size", "parity"))
    discard(shared, met)
    free_shuffles(docs.sparkSession)
    found = links(rows, _may_be_alike(similarity), _alike(texts, nodes, similarity))
    discard(rows)
    groups = components(found)
    named = cut(nodes.join(groups, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component")))
    discard(found, groups, nodes)
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    member = cut(named.join(least, "component").select("node", "component", "component_id"))
    discard(named)
    free_shuffles(docs.sparkSession)
    return who.select("row_id", "row_hash", "id", "node").join(member, "node").drop("node")


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored table (row_id, row_hash, class): documents of a class are connected by links of their fingerprints."""
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), *row_key(id_col, text_col), F.col(text_col).alias("_text"))
    prints = cut(with_fingerprint(texts, "_text").select("_id", "row_id", "row_hash", "fp"))
    linked = linked_fingerprints(prints)
    found = cut(prints.join(linked.select("fp", F.col("component").alias("class")), "fp").select("row_id", "row_hash", "class").distinct())
    discard(prints, linked)
    free_shuffles(docs.sparkSession)
    return found


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of copies and near copies, that of the least id, with its own columns only.

    A group is what links of SimHash fingerprints, found by pivot distance tables, and links of
    this similarity, found exactly, connect together. Rows that repeat both id and text count once.
    A group without any id keeps the row of least text hash.
    """
    classes = simhash_classes(docs, id_col, text_col)
    alike = cut(similar_documents(docs, similarity, id_col, text_col).select("row_id", "row_hash", "id", "component"))
    both = alike.join(classes, ["row_id", "row_hash"]).select("class", "component").distinct()
    least = both.groupBy("class").agg(F.min("component").alias("src"), F.max("component").alias("last")).filter("src <> last")
    merged = components(both.join(least, "class").select("src", F.col("component").alias("dst")))
    named = alike.join(merged.withColumnRenamed("component", "_c"), alike["component"] == merged["node"], "left")
    first = named.groupBy(F.coalesce("_c", "component").alias("group")).agg(
        F.min(F.struct(F.col("id").isNull().alias("no_id"), "row_id", "row_hash")).alias("k")
    )
    keys = cut(first.select("k.row_id", "k.row_hash"))
    discard(classes, alike, merged)
    packed = docs.select(F.struct(*docs.columns).alias("_row"), *row_key(id_col, text_col))
    return packed.join(keys, ["row_id", "row_hash"], "left_semi").dropDuplicates(["row_id", "row_hash"]).select("_row.*")
