"""Byte-level BPE encoding and decoding by recursive DuckDB queries, one database per task.

A task splits its texts with the tokenizer's pattern and looks each distinct piece up
once. New pieces that are no token themselves become token-position rows of an in-memory
database; a recursive query joins them with the merge table, contracts every word's
leftmost pair of least rank, and goes on until no pair merges. Only words that still
merge are carried from round to round. Decoding joins ids with the vocabulary and
aggregates bytes in the order of positions.

One pair a round would cost a long piece the square of its length. There, every pair
goes at once that is the leftmost of least rank within the reach of the longest token.
Such a pair merges as it stands whatever happens farther away: a neighbour can only
change before it by a token that begins with a lower rank inside that reach. This holds
if each token's own bytes merge to that token, which is verified before it is used.

Spark deals the documents out; nothing is shuffled. A task holds one batch of texts, a
table of pieces of bounded size, and a database of bounded memory on one thread that
writes no files.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, whole_text

ship(__name__)

#: Words per recursive query, tokens per decoding query, and pieces kept before the table starts anew.
WORDS_A_QUERY, TOKENS_A_QUERY, MAX_PIECES = 20_000, 400_000, 600_000
#: Bytes from which a piece is long, rows of long pieces per query, and rows that a query's rounds may hold together.
LONG_PIECE, LONG_ROWS, ROWS_A_QUERY = 96, 200_000, 2_000_000
#: DuckDB's memory, and what it may take while it contracts long pieces.
MEMORY, LONG_MEMORY = "200MB", "600MB"

# A pair's rank, place and end are packed in one number, so that one minimum finds the leftmost pair of least rank.
ENCODE = """
WITH RECURSIVE s(k, w, i, j, tok, nxt, r) AS (
  SELECT 0, w, i, CASE WHEN nxt >= 0 THEN i + 1 END, tok, nxt, m.r FROM start LEFT JOIN merges m ON m.a = tok AND m.b = nxt
  UNION ALL
  SELECT x.k, x.w, x.i, x.j, x.tok, x.nxt, CASE WHEN x.a IS NULL THEN x.r ELSE m.r END FROM (
    SELECT s.k + 1 AS k, s.w, s.i, s.r,
      CASE WHEN s.i = b.i THEN b.j2 ELSE s.j END AS j,
      CASE WHEN s.i = b.i THEN b.r ELSE s.tok END AS tok,
      CASE WHEN s.i = b.i THEN b.nxt2 WHEN s.j = b.i THEN b.r ELSE s.nxt END AS nxt,
      CASE WHEN s.i = b.i THEN b.r WHEN s.j = b.i THEN s.tok END AS a
    FROM s JOIN (
      SELECT c.w, c.i, c.j, c.r, g.j AS j2, g.nxt AS nxt2 FROM (
        SELECT w, (p >> 40)::INT AS r, ((p >> 20) & 1048575)::INT AS i, (p & 1048575)::INT AS j
        FROM (SELECT w, min((r::BIGINT << 40) | (i::BIGINT << 20) | j) AS p FROM s WHERE r IS NOT NULL GROUP BY w)
      ) c JOIN s g ON g.w = c.w AND g.i = c.j
    ) b ON s.w = b.w AND s.i <> b.j
  ) x LEFT JOIN merges m ON m.a = x.a AND m.b = x.nxt
)
SELECT w, i, tok, r FROM s JOIN (SELECT w, max(k) AS k FROM s GROUP BY w) last USING (w, k) ORDER BY w, i
"""

# Pairs of one rank that overlap in a row go every other one, from the left.
ENCODE_LONG = """
WITH RECURSIVE s(k, w, i, tok, r) AS (
  SELECT 0, w, i, tok, m.r FROM start LEFT JOIN merges m ON m.a = tok AND m.b = nxt
  UNION ALL
  SELECT x.k, x.w, x.i, x.tok, m.r FROM (
    SELECT k, w, i, tok, lead(tok) OVER o AS nxt FROM (
      SELECT k + 1 AS k, w, i, CASE WHEN go THEN r ELSE tok END AS tok FROM (
        SELECT *, coalesce(lag(go) OVER o, false) AS gone FROM (
          SELECT *, coalesce(r = least_r AND (n - max(CASE WHEN fresh THEN n END) OVER o) % 2 = 0, false) AS go FROM (
            SELECT *, row_number() OVER o AS n, r IS DISTINCT FROM lag(r) OVER o AS fresh,
              min(r) OVER (PARTITION BY w ORDER BY i ROWS BETWEEN {reach} PRECEDING AND {reach} FOLLOWING) AS least_r
            FROM s WHERE k < {rounds} AND w IN (SELECT w FROM s WHERE r IS NOT NULL)
            WINDOW o AS (PARTITION BY w ORDER BY i)
          ) WINDOW o AS (PARTITION BY w ORDER BY i)
        ) WINDOW o AS (PARTITION BY w ORDER BY i)
      ) WHERE NOT gone
    ) WINDOW o AS (PARTITION BY w ORDER BY i)
  ) x LEFT JOIN merges m ON m.a = x.tok AND m.b = x.nxt
)
SELECT w, i, tok, r FROM s JOIN (SELECT w, max(k) AS k FROM s GROUP BY w) last USING (w, k) ORDER BY w, i
"""

# Every way to cut a token into two tokens, with the token's rank.
MERGES = """
CREATE TABLE merges AS SELECT x.id AS a, y.id AS b, r FROM (
  SELECT id AS r, hex[:2 * k] AS head, hex[2 * k + 1:] AS tail FROM vocabulary, unnest(range(1, len(hex) // 2)) t(k)
) JOIN vocabulary x ON x.hex = head JOIN vocabulary y ON y.hex = tail
"""

DECODE = """
SELECT doc, list(v.bytes ORDER BY pos) AS tokens FROM ids JOIN vocabulary v USING (id) GROUP BY doc ORDER BY doc
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}


class Codec:
    """One task's tokenizer: the vocabulary in a database and the pieces seen so far."""

    def __init__(self, path: str, pattern: str | None = None):
        self.ranks = read_ranks(path)
        self.pieces: dict[str, bytes] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        ids, tokens = pa.array(self.ranks.values(), pa.int32()), pa.array(list(self.ranks), pa.binary())
        self.db.register("incoming", pa.table({"id": ids, "bytes": tokens, "hex": [t.hex() for t in self.ranks]}))
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM incoming")
        self.db.unregister("incoming")
        if pattern:
            self.split = regex.compile(pattern).findall
            self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
            self.reach = max(map(len, self.ranks))
            self._exact_reach: bool | None = None
            self.db.execute(MERGES)

    def _query(self, sql: str, word: np.ndarray, at: np.ndarray, tok: np.ndarray) -> pa.Table:
        inside = np.r_[word[1:] == word[:-1], np.zeros(min(1, len(word)), bool)]
        self.db.register("start", pa.table({"w": word, "i": at, "tok": tok, "nxt": np.where(inside, np.roll(tok, -1), -1).astype(np.int32)}))
        return self.db.sql(sql).to_arrow_table()

    def _contract(self, words: list[bytes], long: bool = False) -> list[bytes]:
        """Ids of each word as little-endian 32-bit integers."""
        sizes = np.array([len(w) for w in words])
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        at = (np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        tok = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        rows = self._query(self._long(len(tok)) if long else ENCODE, word, at, tok)
        while long and rows["r"].null_count < len(rows):
            rows = self._query(self._long(len(rows)), *(rows[c].to_numpy() for c in ("w", "i", "tok")))
        ids = rows["tok"].to_numpy().astype("<u4").tobytes()
        ends = 4 * np.cumsum(np.bincount(rows["w"].to_numpy(), minlength=len(words)))
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _long(self, rows: int) -> str:
        return ENCODE_LONG.format(reach=self.reach, rounds=max(1, min(32, ROWS_A_QUERY // rows)))

    def exact_reach(self) -> bool:
        """Whether every token's own bytes merge to that token."""
        if self._exact_reach is None:
            tokens = list(self.ranks)
            parts = (self._contract(tokens[k : k + WORDS_A_QUERY]) for k in range(0, len(tokens), WORDS_A_QUERY))
            self._exact_reach = all(len(ids) == 4 for part in parts for ids in part)
        return self._exact_reach

    def learn(self, pieces: set[str]) -> None:
        """Enter the ids of new pieces; whole tokens need no merging."""
        words = []
        for piece in pieces:
            data = piece.encode("utf-8", "surrogatepass")
            if (rank := self.ranks.get(data)) is not None:
                self.pieces[piece] = rank.to_bytes(4, "little")
            else:
                words.append((piece, data))
        words.sort(key=lambda w: len(w[1]))  # words of like length end together
        long = [w for w in words if len(w[1]) >= LONG_PIECE] if words and len(words[-1][1]) >= LONG_PIECE and self.exact_reach() else []
        for k in range(0, len(words) - len(long), WORDS_A_QUERY):
            part = words[k : min(k + WORDS_A_QUERY, len(words) - len(long))]
            self.pieces.update(zip([p for p, _ in part], self._contract([d for _, d in part])))
        if long:
            self.db.execute(f"SET memory_limit = '{LONG_MEMORY}'")
            for part in _parts([len(d) for _, d in long], LONG_ROWS):
                self.pieces.update(zip([p for p, _ in long[part]], self._contract([d for _, d in long[part]], long=True)))
            self.db.execute(f"SET memory_limit = '{MEMORY}'")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        if len(self.pieces) > MAX_PIECES:
            self.pieces.clear()
        cut = [self.split(t) for t in texts]
        new: set[str] = set()
        for pieces in cut:
            new.update(pieces)
        self.learn(new.difference(self.pieces))
        ids = self.pieces.__getitem__
        return [b"".join(map(ids, pieces)) for pieces in cut]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """Bytes of each id sequence."""
        out: list[bytes] = []
        for cut in _parts([len(x) for x in ids], TOKENS_A_QUERY):
            part = ids[cut]
            doc = np.repeat(np.arange(len(part), dtype=np.int32), [len(x) for x in part])
            flat = np.concatenate(part).astype(np.int32)
            self.db.register("ids", pa.table({"doc": doc, "pos": np.arange(len(flat), dtype=np.int32), "id": flat}))
            rows = self.db.sql(DECODE).to_arrow_table()
            found = dict(zip(rows["doc"].to_pylist(), _joined(rows["tokens"].combine_chunks())))
            out += [found.get(d, b"") for d in range(len(part))]
        return out


def _joined(lists: pa.ListArray) -> list[bytes]:
    """The values of each list end to end, as they lie in the array's buffer."""
    values = lists.values
    _, offsets, data = values.buffers()
    ends = np.frombuffer(offsets, np.int32)[values.offset :][lists.offsets.to_numpy()].tolist()
    flat = data.to_pybytes() if data else b""
    return [flat[a:b] for a, b in zip(ends, ends[1:])]


def _parts(sizes: list[int], most: int) -> Iterator[slice]:
    """Consecutive slices whose sizes sum up to ``most`` at most; a single one may be larger."""
    start = total = 0
    for k, n in enumerate(sizes):
        if k > start and total + n > most:
            yield slice(start, k)
            start, total = k, 0
        total += n
    if len(sizes) > start:
        yield slice(start, len(sizes))


def _small(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose values of one column sum up to about ``most`` bytes; a single row may be larger."""
    for part in _parts(pc.binary_length(batch.column(column)).fill_null(0).to_pylist(), most):
        yield batch.slice(part.start, part.stop - part.start)


BATCH_BYTES = 8_000_000


def _codes(found: list[bytes], packed: bool) -> pa.Array:
    if packed:
        return pa.array(found, pa.binary())
    ends = np.cumsum([0, *(len(x) // 4 for x in found)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<i4"), pa.int32()))


def encode(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    text_col: str = "text",
    out: str = "ids",
    packed: bool = False,
    decoded: str | None = None,
) -> DataFrame:
    """The documents with the token ids of their text in a new column ``out``, which replaces one of that name.

    ``vocabulary`` is the place of a rank file that every worker can read and ``pattern``
    the expression that cuts texts into pieces. Ids are an array, or bytes (little-endian
    unsigned 32-bit integers) if ``packed``. With ``decoded``, the ids are also decoded
    again, into a binary column of that name. Special tokens are ordinary text. A null or
    empty text has no ids. Every row, repeated or not, is encoded; other columns pass
    through. A piece that does not break may have about a million bytes.
    """
    rest = [c for c in docs.columns if c not in (out, decoded)]
    given = docs.select(*rest, whole_text(text_col).alias("_bpe_text"))
    kind = T.BinaryType() if packed else T.ArrayType(T.IntegerType(), False)
    added = [T.StructField(out, kind), *([T.StructField(decoded, T.BinaryType())] if decoded else [])]
    schema = T.StructType([*docs.select(*rest).schema.fields, *added])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary, pattern)
        for whole in batches:
            for batch in _small(whole, len(rest), BATCH_BYTES):
                found = codec.encode(batch.column(len(rest)).to_pylist())
                columns = [*batch.columns[: len(rest)], _codes(found, packed)]
                if decoded:
                    columns.append(pa.array(codec.decode([np.frombuffer(x, "<u4") for x in found]), pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names)

    return given.mapInArrow(run, schema)


def decode(rows: DataFrame, vocabulary: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """The rows with the bytes of their ids in a new binary column ``out``; null or empty ids give no bytes.

    Ids are an array of integers or bytes as ``encode`` packs them.
    """
    rest = [c for c in rows.columns if c != out]
    packed = isinstance(rows.schema[ids_col].dataType, T.BinaryType)
    none = F.lit(b"") if packed else F.array().cast("array<int>")
    given = rows.select(*rest, F.coalesce(F.col(ids_col), none).alias("_bpe_ids"))
    schema = T.StructType([*rows.select(*rest).schema.fields, T.StructField(out, T.BinaryType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary)
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                given = batch.column(len(rest))
                ids = [np.frombuffer(x.as_py(), "<u4") if packed else x.values.to_numpy() for x in given]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(codec.decode(ids), pa.binary())], names)

    return given.mapInArrow(run, schema)
