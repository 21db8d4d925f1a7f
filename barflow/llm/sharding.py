"""Reproducible shuffle and shards by a Feistel permutation with cycle walking.

Rows get global numbers 0 .. N-1 from counts per bucket, a keyed permutation moves each
number to its place in the shuffle, and a place gives its shard and slot by division.
Nothing is sorted globally: the number of a row is the offset of its bucket plus its rank
inside, and the bucket offsets are a table of ``BUCKETS`` rows at most.
"""

from __future__ import annotations

from collections.abc import Callable
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, whole_text

BUCKETS, ROUNDS, WALK, SEED = 4096, 6, 64, 20240229


def _mixed(x: Column, key: int, modulus: int) -> Column:
    """Round function: a keyed hash of one half, below the modulus."""
    return F.pmod(F.xxhash64(x, F.lit(key)), F.lit(modulus))


def _whole(x: Column, by: int) -> Column:
    """Integer quotient of a number that is not negative; the division is exact."""
    return ((x - F.pmod(x, F.lit(by))) / by).cast("long")


def domain(n: int) -> tuple[int, int]:
    """Sides a, b of the least near-square domain of n numbers or more: n <= a * b < n + a."""
    a = max(1, isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def permute(x: Column, n: int, seed: int = SEED) -> Column:
    """The place of number x under a keyed permutation of 0 .. n-1.

    Feistel rounds over the domain's two coordinates permute a * b numbers; numbers that
    land outside are sent through again until they land inside (cycle walking). Under one
    in sqrt(n) does so at a time; a walk that would not end in ``WALK`` steps raises an
    error rather than giving a wrong place (for n up to WALK ** 2 none can be longer).
    """
    a, b = domain(n)

    def turn(k: int) -> Callable[[Column], Column]:
        if k % 2:
            return lambda h: F.struct(h["l"].alias("l"), F.pmod(h["r"] + _mixed(h["l"], seed + k, b), F.lit(b)).alias("r"))
        return lambda h: F.struct(F.pmod(h["l"] + _mixed(h["r"], seed + k, a), F.lit(a)).alias("l"), h["r"].alias("r"))

    def once(v: Column) -> Column:
        # A lambda binds each round's result, so that no round is written out twice.
        halves = F.array(F.struct(F.pmod(v, F.lit(a)).alias("l"), _whole(v, a).alias("r")))
        for k in range(ROUNDS):
            halves = F.transform(halves, turn(k))
        return F.transform(halves, lambda h: h["l"] + h["r"] * F.lit(a))[0]

    walked = F.aggregate(
        F.sequence(F.lit(2), F.lit(WALK)), once(x), lambda v, _: F.when(v < n, v).otherwise(once(v))
    )
    place = F.when(once(x) < n, once(x)).otherwise(walked)
    return F.when(place < n, place).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def number_rows(rows: DataFrame, out: str = "row_number") -> DataFrame:
    """``rows`` with gapless global numbers from 0 that depend on the rows alone, not on how they are stored.

    Equal rows are counted first and get consecutive numbers, so a row that is repeated
    without bound is one row in its bucket.
    """
    names = rows.columns
    counted = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    placed = cut(counted.withColumn("_bucket", F.pmod(F.xxhash64(*names), F.lit(BUCKETS))))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    # At most BUCKETS rows of two longs are ordered in one task and broadcast.
    offsets = placed.groupBy("_bucket").agg(F.sum("_n").alias("_all")).select(
        "_bucket", F.coalesce(F.sum("_all").over(before(Window.orderBy("_bucket"))), F.lit(0)).alias("_offset")
    )
    inside = F.coalesce(F.sum("_n").over(before(Window.partitionBy("_bucket").orderBy(*names))), F.lit(0))
    return (
        placed.withColumn("_before", inside)
        .join(F.broadcast(offsets), "_bucket")
        .select(*names, (F.col("_offset") + F.col("_before")).alias("_from"), F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_copy"))
        .select(*names, (F.col("_from") + F.col("_copy") - 1).alias(out))
    )


def shard(docs: DataFrame, shards: int = 8, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size, CRC-32 of the text, shard and slot; row counts of shards differ by one at most.

    A document's number comes from its id, size and checksum; documents that agree in all
    three are interchangeable. Nulls: a null text has size 1 and the checksum of the empty
    text; a null id is a value like any other. An empty table gives no rows. Extra
    columns are not read.
    """
    text = whole_text(text_col)
    rows = cut(
        docs.select(
            F.col(id_col).alias("_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
        )
    )
    place = number_rows(rows).withColumn("_place", permute(F.col("row_number"), rows.count(), seed))
    return place.select(
        F.col("_id").alias(id_col), "size", "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod("_place", F.lit(shards)).cast("int").alias("shard"),
        _whole(F.col("_place"), shards).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
