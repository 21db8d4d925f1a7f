"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time over windows of
labelled texts. It reads the bytes before a position in one direction and those from it on in
the other, labels every position, and a document's probabilities are the mean of its
positions'. A byte's input weights are a table row, and gates are softsign functions,
which cost a small part of exponentials.

Texts are read whole, in windows, so that thousands of them advance together by one
byte a step: each direction starts from an empty state ``LEAD`` bytes outside its window,
however long the text. Spark deals the documents out; nothing is shuffled but the training sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import _parts
from .common import ship

ship(__name__)

#: State per direction, bytes of a window and of the lead into it, cells of a batch of windows, and text bytes read at once.
HIDDEN, WINDOW, LEAD, CELLS, READ_BYTES = 8, 512, 32, 1 << 23, 4_000_000
#: Training: languages at most (the commonest), documents of a language at most (those of least hash), windows of a document, bytes of a window.
MAX_LANGS, MAX_DOCS, PLACES, TRAIN_BYTES = 64, 500, 3, 128
#: Training: steps, windows of a step, rate, seed.
STEPS, BATCH, RATE, SEED = 150, 384, 0.03, 5
FOLDS, HELD_OUT, UNDETERMINED = 4, 2, "und"


def _squash(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def _slope(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.abs(x)) ** 2


@dataclass
class Direction:
    """Gated recurrent cells: table (3H, 256) of input weights, turn (3H, H) of state weights; rows: keep, reset, candidate."""

    table: np.ndarray
    turn: np.ndarray

    def step(self, h: np.ndarray, bytes_: np.ndarray, x: np.ndarray, g: np.ndarray) -> None:
        """Advance states (H, n) by one byte each, in place; x and g are room for (3H, n)."""
        n = len(h)
        np.take(self.table, bytes_, axis=1, out=x, mode="clip")
        np.matmul(self.turn, h, out=g)
        gates = g[: 2 * n]
        gates += x[: 2 * n]
        room = x[: 2 * n]
        np.abs(gates, out=room)
        room += 1
        gates /= room
        gates *= 0.5
        gates += 0.5
        new, room = g[2 * n :], x[:n]
        new *= gates[n:]
        new += x[2 * n :]
        np.abs(new, out=room)
        room += 1
        new /= room
        h -= new
        h *= gates[:n]
        h += new

    def states(self, data: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
        """Training pass over data (steps, n): all states (steps + 1, H, n) and what the way back needs."""
        size, kept = self.turn.shape[1], []
        h = np.zeros((len(data) + 1, size, data.shape[1]), np.float32)
        for t, bytes_ in enumerate(data):
            x, u = self.table[:, bytes_], self.turn @ h[t]
            gates = x[: 2 * size] + u[: 2 * size]
            z, r = np.split(0.5 + 0.5 * _squash(gates), 2)
            m = x[2 * size :] + r * u[2 * size :]
            new = _squash(m)
            h[t + 1] = (new + z * (h[t] - new)) * live[t]
            kept.append((gates, z, r, u[2 * size :], m, new))
        return h, kept

    def back(self, data: np.ndarray, live: np.ndarray, h: np.ndarray, kept: list[tuple], out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of table and turn from those of the states, out (steps, H, n)."""
        size, steps = self.turn.shape[1], len(data)
        d_turn, d_in, d_h = np.zeros_like(self.turn), np.empty((steps, 3 * size, data.shape[1]), np.float32), 0
        for t in range(steps - 1, -1, -1):
            gates, z, r, u, m, new = kept[t]
            d = (out[t] + d_h) * live[t]
            d_m = d * (1 - z) * _slope(m)
            d_gates = 0.5 * _slope(gates) * np.concatenate([d * (h[t] - new), d_m * u])
            d_in[t] = np.concatenate([d_gates, d_m])
            d_u = np.concatenate([d_gates, d_m * r])
            d_turn += d_u @ h[t].T
            d_h = d * z + self.turn.T @ d_u
        flat, by = d_in.transpose(1, 0, 2).reshape(3 * size, -1), data.ravel()
        return np.stack([np.bincount(by, row, 256) for row in flat]).astype(np.float32), d_turn


@dataclass
class Network:
    """Both directions and the layer that turns their states into languages."""

    langs: list[str]
    ahead: Direction
    behind: Direction
    weights: np.ndarray  # (languages, 2H)
    bias: np.ndarray

    def loss(self, data: np.ndarray, live: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over live positions of windows (steps, n), and the gradients of all parameters."""
        h_a, kept_a = self.ahead.states(data, live)
        h_b, kept_b = self.behind.states(data[::-1], live[::-1])
        both = np.concatenate([h_a[1:], h_b[:0:-1]], axis=1)
        logits = self.weights @ both + self.bias[:, None]
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        at = label[None, None, :]
        found = np.take_along_axis(p, np.broadcast_to(at, (len(p), 1, len(label))), axis=1)[:, 0]
        n = live.sum()
        value = float(-(np.log(found + 1e-12) * live).sum() / n)
        np.put_along_axis(p, np.broadcast_to(at, (len(p), 1, len(label))), found[:, None] - 1, axis=1)
        p *= (live / n)[:, None, :]
        d_weights = np.tensordot(p, both, axes=([0, 2], [0, 2]))
        d_both = self.weights.T @ p
        size = len(self.ahead.turn[0])
        d_a = self.ahead.back(data, live, h_a, kept_a, d_both[:, :size])
        d_b = self.behind.back(data[::-1], live[::-1], h_b, kept_b, d_both[::-1, size:])
        return value, [*d_a, *d_b, d_weights, p.sum(axis=(0, 2))]

    def parameters(self) -> list[np.ndarray]:
        return [self.ahead.table, self.ahead.turn, self.behind.table, self.behind.turn, self.weights, self.bias]

    def read(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, labels: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Summed probabilities of each text's positions (texts, languages) and, if asked for, the label of every byte.

        ``data`` has the bytes of all texts, which lie at starts and have sizes.
        """
        n = -(-sizes // WINDOW)
        text = np.repeat(np.arange(len(sizes)), n)
        offset = (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * WINDOW
        left = sizes[text] - offset
        reach = np.minimum(left, WINDOW + LEAD)  # own bytes and those that the way back begins with
        order = np.argsort(-reach, kind="stable")
        total, marks = np.zeros((len(sizes), len(self.langs))), np.zeros(len(data) if labels else 0, np.uint8)
        wide = max(64, min(4096, CELLS // (WINDOW * len(self.langs))))
        for k in range(0, len(order), wide):
            some = order[k : k + wide]
            sums = self._windows(data, (starts[text] + offset)[some], offset[some] > 0, reach[some], marks if labels else None)
            np.add.at(total, text[some], sums.T)
        return total, marks if labels else None

    def _windows(self, data: np.ndarray, first: np.ndarray, led: np.ndarray, reach: np.ndarray, marks: np.ndarray | None) -> np.ndarray:
        """Summed probabilities (languages, windows); ``reach`` falls."""
        size, n = self.ahead.turn.shape[1], len(first)
        own = np.minimum(reach, WINDOW)
        # How many windows still have a byte at each place.
        active = np.searchsorted(-reach, -np.arange(1, reach[0] + 1), side="right")
        x, g, h = np.empty(3 * size * n, np.float32), np.empty(3 * size * n, np.float32), np.zeros((size, n), np.float32)
        logits = np.empty((own[0], len(self.langs), n), np.float32)

        def advance(side: Direction, place: int, m: int) -> np.ndarray:
            at = np.clip(first[:m] + place, 0, len(data) - 1)
            side.step(h[:, :m], data[at].astype(np.intp), x[: 3 * size * m].reshape(-1, m), g[: 3 * size * m].reshape(-1, m))
            return h[:, :m]

        if led.any():
            for place in range(-LEAD, 0):
                advance(self.ahead, place, n)
            h *= led
        for place in range(own[0]):
            m = active[place]
            np.matmul(self.weights[:, :size], advance(self.ahead, place, m), out=logits[place, :, :m])
        h[:] = 0
        sums = np.zeros((len(self.langs), n), np.float32)
        for place in range(reach[0] - 1, -1, -1):
            m = active[place]
            advance(self.behind, place, m)
            if place < own[0]:
                found = logits[place, :, :m]
                found += self.weights[:, size:] @ h[:, :m]
                found += self.bias[:, None]
                if marks is not None:
                    marks[first[:m] + place] = found.argmax(axis=0)
                found -= found.max(axis=0)
                np.exp(found, out=found)
                found /= found.sum(axis=0)
                sums[:, :m] += found
        return sums


def _fresh(langs: list[str], rng: np.random.Generator) -> Network:
    def side() -> Direction:
        turn = np.concatenate([np.linalg.qr(rng.standard_normal((HIDDEN, HIDDEN)))[0] for _ in range(3)])
        return Direction(rng.normal(0, 0.3, (3 * HIDDEN, 256)).astype(np.float32), turn.astype(np.float32))

    weights = rng.normal(0, 0.3, (len(langs), 2 * HIDDEN)).astype(np.float32)
    return Network(langs, side(), side(), weights, np.zeros(len(langs), np.float32))


def fit(windows: list[tuple[str, bytes]], steps: int = STEPS) -> Network | None:
    """A network trained on (language, bytes); each language is seen equally often. None without windows."""
    langs = sorted({lang for lang, _ in windows})
    if not langs:
        return None
    rng = np.random.default_rng(SEED)
    of = [[np.frombuffer(b[:TRAIN_BYTES], np.uint8) for lang, b in windows if lang == own] for own in langs]
    net = _fresh(langs, rng)
    first, second = ([np.zeros_like(p) for p in net.parameters()] for _ in range(2))
    for k in range(1, steps + 1):
        label = np.resize(rng.permutation(len(langs)), max(BATCH, len(langs)))
        chosen = [of[c][rng.integers(len(of[c]))] for c in label]
        data, live = np.zeros((TRAIN_BYTES, len(label)), np.intp), np.zeros((TRAIN_BYTES, len(label)), np.float32)
        for column, window in enumerate(chosen):
            data[: len(window), column] = window
            live[: len(window), column] = 1
        _, slopes = net.loss(data, live, label)
        rate = RATE * min(1, 2 * (1 - k / (steps + 1)))
        for p, m, v, d in zip(net.parameters(), first, second, slopes):
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            p -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return net


def held_out(id_col: str) -> Column:
    """Documents whose language is never learned from; a null id counts as not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def _lettered(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, bytes]]:
    """(language, bytes) windows to learn from.

    Up to ``MAX_LANGS`` languages (the commonest, then by name), of each up to
    ``MAX_DOCS`` documents that are not held out, of each up to ``PLACES`` windows evenly
    spaced over the whole text.
    """
    text = F.col(text_col)
    known = docs.filter(~held_out(id_col) & F.col(lang_col).isNotNull() & _lettered(text)).select(F.col(lang_col).alias("lang"), text.alias("text"))
    langs = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS)
    share = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / (1 << 30)
    # First by a threshold on the hash, so that few rows of a common language are put in order.
    few = known.withColumn("o", share).join(F.broadcast(langs), "lang").filter(F.col("o") * F.col("count") <= 2 * MAX_DOCS + 50)
    few = few.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("o", F.md5("text")))).filter(F.col("k") <= MAX_DOCS)
    data = few.select("lang", "o", F.col("text").cast("binary").alias("b")).withColumn("rest", F.greatest(F.lit(0), F.octet_length("b") - TRAIN_BYTES))
    place = F.explode(F.array_distinct(F.array(*[F.floor(F.col("rest") * k / max(1, PLACES - 1)).cast("int") for k in range(PLACES)])))
    cut = data.select("lang", "o", "b", place.alias("place")).select("lang", "o", "place", F.substring("b", F.col("place") + 1, F.lit(TRAIN_BYTES)).alias("b"))
    return sorted((r.lang, bytes(r.b)) for r in cut.select("lang", "b").collect())


def _runs(marks: np.ndarray, start: int, size: int, langs: list[str]) -> list[dict]:
    own = marks[start : start + size]
    edges = np.flatnonzero(np.r_[True, own[1:] != own[:-1], True]) if size else np.zeros(1, int)
    return [{"start": a, "n_bytes": b - a, "lang": langs[own[a]]} for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text", runs: bool = False) -> DataFrame:
    """One row per document: id, ``held_out``, ``lang_pred`` and ``score``; with ``runs`` also the labels of all bytes.

    The score is the mean probability of the predicted language over the text's bytes, and
    of languages with equal means the first by name is predicted. A text that is null,
    empty or has no letter is ``und`` with score 0, and so is every text without a
    network. ``runs`` lists the stretches of bytes with one label (start, n_bytes, lang);
    such texts have none. Repeated documents each have their row; other columns are not read.
    """
    lettered = _lettered(F.col(text_col))
    given = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.when(lettered, F.col(text_col)).cast("binary").alias("_text"))
    if net is None:
        out = given.select(F.col(id_col), "held_out", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
        return out.withColumn("runs", F.array().cast("array<struct<start:int,n_bytes:int,lang:string>>")) if runs else out
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType())]
    fields += [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    run_type = pa.list_(pa.struct([("start", pa.int32()), ("n_bytes", pa.int32()), ("lang", pa.string())]))
    if runs:
        one = [T.StructField("start", T.IntegerType()), T.StructField("n_bytes", T.IntegerType()), T.StructField("lang", T.StringType())]
        fields.append(T.StructField("runs", T.ArrayType(T.StructType(one))))
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes_all = pc.binary_length(whole.column(2)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for part in _parts(sizes_all.tolist(), READ_BYTES):
                batch, sizes = whole.slice(part.start, part.stop - part.start), sizes_all[part]
                data = np.frombuffer(b"".join(x for x in batch.column(2).to_pylist() if x), np.uint8)
                starts = np.cumsum(sizes) - sizes
                total, marks = net.read(data, starts, sizes, runs)
                best = total.argmax(axis=1)
                score = np.where(sizes > 0, total[np.arange(len(sizes)), best] / np.maximum(1, sizes), 0.0)
                pred = [net.langs[b] if n else UNDETERMINED for b, n in zip(best.tolist(), sizes.tolist())]
                columns = [batch.column(0), batch.column(1), pa.array(pred), pa.array(np.minimum(1.0, score))]
                if runs:
                    found = [_runs(marks, a, n, net.langs) for a, n in zip(starts.tolist(), sizes.tolist())]
                    columns.append(pa.array(found, run_type))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return given.mapInArrow(run, schema)
