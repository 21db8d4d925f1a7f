"""Exact removal of long repeated byte strings with a logarithmic family of suffix arrays.

Two passes leave suffix arrays only where a repeat can be. (1) Every ``MATCH``-byte
window picks an anchor, the least of its ``PIECE``-byte hashes; equal windows pick equal
anchors at equal offsets. Consecutive windows with one anchor form a run, known by the
anchor's hash and the hash of all its bytes. Runs whose bytes occur again are repeats as
a whole, decided by counting. (2) The other runs whose anchor occurs again may be repeats
in part, at the edges of copied passages. Their bytes go to the partition of their
anchor, where batches of them get suffix arrays: the array of a new batch is merge-scanned
against the levels that exist, windows that are found are marked on both sides, and the
rest becomes a level; levels of equal size merge, so n batches leave log n levels.

Anchors that very many different runs share are split by a hash of each window's bytes,
which equal windows have in common. The family of a partition lives as long as its task:
a lost executor's partitions are built anew from the stored runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, free_shuffles, row_key, ship, whole_text

ship(__name__)

MATCH, PIECE = 200, 41
SPAN = MATCH - PIECE + 1  # pieces in a window
#: Bytes laid end to end at a time, windows per suffix array, runs of one anchor in one part, and windows that a task should hold.
CHUNK, BATCH_WINDOWS, PART_RUNS, TASK_WINDOWS = 1 << 20, 100_000, 2_000, 400_000
BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64."""
    up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _runs(data: np.ndarray, ends: np.ndarray, powers: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """(first window, windows, anchor's hash) of every run; ends: each byte's end of text."""
    n = len(data) - MATCH + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
    up, down = powers
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    value = (total[PIECE:] - total[:-PIECE]) * down[: len(data) - PIECE + 1]
    value ^= value >> np.uint64(32)
    value *= np.uint64(0xD6E8FEB86659FD93)
    value ^= value >> np.uint64(29)
    least, place = value, np.arange(len(value), dtype=np.int32)
    step = 1
    while step < SPAN:  # the leftmost least of 2, 4, 8 ... and at last SPAN pieces
        by = min(step, SPAN - step)
        right = least[by:] < least[:-by]
        least, place = np.where(right, least[by:], least[:-by]), np.where(right, place[by:], place[:-by])
        step += by
    starts = np.flatnonzero(np.arange(MATCH, n + MATCH) <= ends[:n])
    if not len(starts):
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
    anchor = place[starts]
    new = np.flatnonzero(np.r_[True, (np.diff(anchor) != 0) | (np.diff(starts) != 1)])
    return starts[new], np.diff(np.r_[new, len(starts)]), value[anchor[new]]


def _laid(texts: list[bytes]) -> Iterator[tuple[list[tuple[int, int]], bytes]]:
    """Texts laid end to end in chunks: ((index, offset in its text) per part, bytes); longer texts overlap by MATCH - 1."""
    parts, held, size = [], [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text) - MATCH + 1), CHUNK):
            piece = text[at : at + CHUNK + MATCH - 1]
            if len(piece) < MATCH:
                continue
            if size and size + len(piece) > CHUNK:
                yield parts, held
                parts, held, size = [], [], 0
            parts.append((k, at))
            held.append(piece)
            size += len(piece)
    if parts:
        yield parts, held


RUN = "h long, c long, row_id long, row_hash long, p int, n int"


def _runs_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    powers = _powers(2 * CHUNK + MATCH)
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        texts = [t.encode("utf-8", "surrogatepass") for t in batch["text"]]
        ids, hashes = batch["row_id"].to_numpy(), batch["row_hash"].to_numpy()
        for parts, held in _laid(texts):
            sizes = np.array([len(x) for x in held])
            stops = np.cumsum(sizes)
            flat = b"".join(held)
            first, count, anchor = _runs(np.frombuffer(flat, np.uint8), np.repeat(stops, sizes), powers)
            if not len(first):
                continue
            part = np.searchsorted(stops, first, side="right")
            whole = [digest(flat[a:b]) for a, b in zip(first.tolist(), (first + count + MATCH - 1).tolist())]
            who, offset = np.array(parts).T
            yield pd.DataFrame({
                "h": anchor.view(np.int64), "c": np.array(whole, np.uint64).view(np.int64),
                "row_id": ids[who[part]], "row_hash": hashes[who[part]],
                "p": (first - (stops - sizes)[part] + offset[part]).astype(np.int32), "n": count.astype(np.int32),
            })


class SuffixFamily:
    """Suffix arrays of growing size over windows; every window is marked once another one equals it.

    A level is a sorted array of distinct windows and the number of each one's owner.
    """

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.marked: list[np.ndarray] = []
        self.size = 0

    def add(self, windows: np.ndarray) -> None:
        """windows: an array of MATCH-byte strings."""
        owner = np.arange(self.size, self.size + len(windows))
        self.size += len(windows)
        self.marked.append(np.zeros(len(windows), bool))
        order = np.argsort(windows, kind="stable")  # the batch's suffix array
        windows, owner = windows[order], owner[order]
        same = windows[1:] == windows[:-1]
        self._mark(owner[1:][same])
        self._mark(owner[:-1][same])
        first = np.r_[True, ~same]
        windows, owner = windows[first], owner[first]
        for held, who in self.levels:  # merge-scan
            at = np.minimum(np.searchsorted(held, windows), len(held) - 1)
            hit = held[at] == windows
            self._mark(owner[hit])
            self._mark(who[at[hit]])
            windows, owner = windows[~hit], owner[~hit]
        while len(windows) and self.levels and len(self.levels[-1][0]) <= 2 * len(windows):
            held, who = self.levels.pop()
            windows, owner = np.concatenate([held, windows]), np.concatenate([who, owner])
            order = np.argsort(windows, kind="stable")
            windows, owner = windows[order], owner[order]
        if len(windows):
            self.levels.append((windows, owner))

    def _mark(self, owners: np.ndarray) -> None:
        sizes = np.cumsum([0, *map(len, self.marked)])
        batch = np.searchsorted(sizes, owners, side="right") - 1
        for b in np.unique(batch):
            self.marked[b][owners[batch == b] - sizes[b]] = True


def _windows(data: bytes, starts: np.ndarray) -> np.ndarray:
    view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), MATCH)
    return np.ascontiguousarray(view[starts]).view(f"S{MATCH}").ravel()


CUT = "h long, part int, row_id long, row_hash long, p int, starts array<int>, data binary"


def _cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes of the runs in doubt, each window with the part of its anchor's windows that it belongs to."""
    for batch in batches:
        rows = []
        for text, row_id, row_hash, runs in zip(batch["text"], batch["row_id"], batch["row_hash"], batch["runs"]):
            data = text.encode("utf-8", "surrogatepass")
            for run in runs:
                p, n, parts = run["p"], run["n"], run["parts"]
                piece, starts = data[p : p + n + MATCH - 1], np.arange(n, dtype=np.int32)
                if parts == 1:
                    rows.append((run["h"], 0, row_id, row_hash, p, starts, piece))
                    continue
                part = np.array([xxhash.xxh3_64_intdigest(piece[s : s + MATCH]) % parts for s in range(n)])
                rows += [(run["h"], x, row_id, row_hash, p, starts[part == x], piece) for x in np.unique(part).tolist()]
            if len(rows) > 5000:
                yield pd.DataFrame(rows, columns=["h", "part", "row_id", "row_hash", "p", "starts", "data"])
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=["h", "part", "row_id", "row_hash", "p", "starts", "data"])


SPANS = "row_id long, row_hash long, p int, n int"


def _repeats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spans of windows, in one partition of anchors, that occur again there."""
    family, owners = SuffixFamily(), []
    for batch in batches:
        counts = np.array([len(x) for x in batch["starts"]], np.int64)
        sizes = np.array([len(x) for x in batch["data"]], np.int64)
        flat, starts = b"".join(batch["data"]), np.concatenate(list(batch["starts"])).astype(np.int64)
        place = starts + np.repeat(np.cumsum(sizes) - sizes, counts)
        ids, hashes = np.repeat(batch["row_id"].to_numpy(), counts), np.repeat(batch["row_hash"].to_numpy(), counts)
        at = starts + np.repeat(batch["p"].to_numpy(), counts)
        for k in range(0, len(place), BATCH_WINDOWS):
            part = slice(k, k + BATCH_WINDOWS)
            family.add(_windows(flat, place[part]))
            owners.append((ids[part], hashes[part], at[part]))
    ids, hashes, at = (
        np.concatenate([x[c][m] for x, m in zip(owners, family.marked)] or [np.empty(0, np.int64)]) for c in range(3)
    )
    if not len(at):
        return
    order = np.lexsort((at, hashes, ids))
    at, ids, hashes = at[order], ids[order], hashes[order]
    new = np.r_[True, (np.diff(at) != 0) | (np.diff(ids) != 0) | (np.diff(hashes) != 0)]  # repeated rows have the same windows
    at, ids, hashes = at[new], ids[new], hashes[new]
    new = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (np.diff(ids) != 0) | (np.diff(hashes) != 0)])
    n = np.diff(np.r_[new, len(at)])
    yield pd.DataFrame({"row_id": ids[new], "row_hash": hashes[new], "p": at[new].astype(np.int32), "n": n.astype(np.int32)})


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_id, row_hash, p, n): windows that start at bytes p .. p + n - 1 and occur again anywhere, spans may overlap."""
    texts = docs.select(*row_key(id_col, text_col), whole_text(text_col).alias("text"))
    runs = cut(texts.mapInPandas(_runs_of, RUN))
    groups = cut(
        runs.groupBy("h", "c").agg(
            F.count(F.lit(1)).alias("copies"), *[F.first(x).alias(x) for x in ("row_id", "row_hash", "p", "n")]
        )
    )
    free_shuffles(docs.sparkSession)
    whole = cut(runs.join(groups.filter("copies > 1").select("h", "c"), ["h", "c"], "left_semi").select("row_id", "row_hash", "p", "n"))
    discard(runs)
    free_shuffles(docs.sparkSession)
    shared = groups.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("copies").alias("least")).filter("k > 1 and least = 1")
    doubt = groups.join(shared, "h").select(
        "row_id", "row_hash", F.struct("h", "p", "n", F.ceil(F.col("k") / PART_RUNS).cast("int").alias("parts")).alias("run")
    )
    by_row = cut(doubt.groupBy("row_id", "row_hash").agg(F.collect_list("run").alias("runs")))
    discard(groups)
    free_shuffles(docs.sparkSession)
    windows = by_row.agg(F.sum(F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["n"])).alias("n")).first()["n"] or 0
    pieces = texts.join(by_row, ["row_id", "row_hash"]).mapInPandas(_cut_out, CUT)
    # A number of its own: a task holds the windows of its partition.
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), windows // TASK_WINDOWS + 1)
    partial = cut(pieces.repartition(parts, "h", "part").mapInPandas(_repeats, SPANS))
    discard(by_row)
    free_shuffles(docs.sparkSession)
    return whole.union(partial)


def _without(texts: pd.Series, places: pd.Series, counts: pd.Series) -> pd.DataFrame:
    rows = []
    for text, p, n in zip(texts, places, counts):
        if text is None:
            rows.append((0, 0, None))
            continue
        data = text.encode("utf-8", "surrogatepass")
        edge = np.zeros(len(data) + 1, np.int64)
        np.add.at(edge, p, 1)
        np.add.at(edge, p + n + MATCH - 1, -1)
        gone = np.cumsum(edge[:-1]) > 0
        spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
        rows.append((int(gone.sum()), spans, np.frombuffer(data, np.uint8)[~gone].tobytes()))
    return pd.DataFrame(rows, columns=["n_removed", "n_spans", "kept"])


def strip_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept``, the bytes left of their text.

    A byte goes if a string of ``MATCH`` bytes over it also starts anywhere else, in the
    same document or another. ``kept`` is binary, since a cut may fall inside a character.
    A null text counts as empty and keeps no bytes; texts shorter than ``MATCH`` bytes
    stay whole; repeated rows count as copies of one another. Other columns pass through,
    but for those named like a result, which are replaced.
    """
    added = ("n_bytes", "n_removed", "n_spans", "kept")
    spans = repeated_windows(docs, id_col, text_col).groupBy("row_id", "row_hash").agg(
        F.collect_list("p").alias("_p"), F.collect_list("n").alias("_n")
    )
    packed = docs.select(F.struct(*[c for c in docs.columns if c not in added]).alias("_row"), whole_text(text_col).alias("_text"), *row_key(id_col, text_col))
    joined = packed.join(spans.hint("merge"), ["row_id", "row_hash"], "left")
    out = joined.select(
        "_row", "_text", F.pandas_udf(_without, "n_removed long, n_spans long, kept binary")(F.when(F.col("_p").isNotNull(), F.col("_text")), F.col("_p"), F.col("_n")).alias("_o")
    )
    return out.select(
        "_row.*", F.octet_length("_text").cast("long").alias("n_bytes"), "_o.n_removed", "_o.n_spans",
        F.coalesce("_o.kept", F.col("_text").cast("binary")).alias("kept"),
    )
