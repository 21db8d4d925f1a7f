"""Token alignment against a plain walk over both libraries' own results."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from barflow.llm import queries as registered
from barflow.llm import token_alignment
from barflow.llm.common import table

LEFT, RIGHT = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def walk(docs):
    """The rows of COLUMNS for (id, text) pairs."""
    a_side = Tokenizer.from_file(LEFT)
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=RIGHT)
    known = token_alignment._byte_of()
    a_bytes = {k: bytes(known[c] for c in t) for t, k in a_side.get_vocab().items() if t != "<|endoftext|>"}

    def b_bytes(k):
        piece = b_side.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if b_side.is_byte(k) else piece.replace("▁", " ").encode()

    found, counts = [], Counter()
    for key, text in docs:
        given = (" " + (text or "")).encode()
        a = a_side.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        ends = [], []
        for side, ids, of in zip(ends, (a, b), (a_bytes.__getitem__, b_bytes)):
            parts = [of(k) for k in ids]
            if b"".join(parts) != given:
                break
            at = 0
            for part in parts:
                side.append(at := at + len(part))
        if not text or not (ends[0] and ends[1]):
            found.append((key, [], [], [], ""))
            continue
        i = j = 0
        links, groups, own = [], [], ([], [])
        while i < len(a):
            links.append((a[i], b[j]))
            x, y = ends[0][i], ends[1][j]
            if x <= y:
                own[0].append(a[i])
                i += 1
            if y <= x:
                own[1].append(b[j])
                j += 1
            if x == y:
                groups.append("|".join(",".join(map(str, o)) for o in own))
                own = [], []
        counts.update(set(links))
        found.append((key, a, b, links, ";".join(groups)))
    best = Counter()
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    return [
        (key, len(a), len(b), groups.count(";") + 1 if groups else 0, len(links), sum(counts[p] == best[p[0]] for p in links),
         sum(counts[p] for p in links), hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        for key, a, b, links, groups in found
    ]


def order(rows):
    return sorted(map(tuple, rows), key=str)


def test_query_equals_the_walk(spark, sf_dir):
    rows = registered.QUERIES["op13_token_alignment"](spark, sf_dir).withColumnRenamed("groups_sha256", "groups").select(COLUMNS).collect()
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    assert order(rows) == order(walk(docs))


def test_odd_texts(spark):
    texts = ["", None, " ", "  ", "a ", "a  b", " a", "a\n b", "a \nb", "a\n\n b", "\tb  c \n d", "x▁y", "▁"]
    texts += ["<s> </s> <|endoftext|> <0x41>", "\x00 a\x00b", "\x1c a \x1d b", "a \x85b\xa0 \xa0c", "it's we'll  'tis", "1234 5678  90", "\r\n a\r\n"]
    texts += ["word" * 3000, "a" * 5 + " " * 40 + "b", " ".join(["the"] * 5000), "日本語 テキスト  の", "😀 👍🏽 x", "é ﬁ Ａ"]
    rng = random.Random(3)
    texts += ["".join(rng.choice("ab \n\t'.é1▁ 日 s") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    points = [*range(32, 0x2FF), *range(0x2000, 0x2070), 32, 32, 32, 10]
    texts += ["".join(chr(rng.choice(points)) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    texts += ["".join(chr(rng.choice([rng.randrange(0x20, 0xD800), rng.randrange(0xE000, 0x20000)])) for _ in range(30)) for _ in range(100)]
    docs = [*enumerate(texts), *((k, t) for k, t in enumerate(texts[:40])), (None, "one two"), (None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as block", "2 as text_key", "3 as _text", "4 as n_a").repartition(3)
    assert order(token_alignment.align(df, LEFT, RIGHT, digest=True).select(COLUMNS).collect()) == order(walk(docs))


def test_small_blocks_and_a_full_table_of_chunks(spark, monkeypatch):
    monkeypatch.setattr(token_alignment, "BLOCK_BYTES", 60)
    monkeypatch.setattr(token_alignment, "DICTIONARY_ROWS", 3)
    monkeypatch.setattr(token_alignment, "MAX_CHUNKS", 4)
    docs = [(k, " ".join(f"w{(k * j) % 11} the" for j in range(k % 13))) for k in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    assert order(token_alignment.align(df, LEFT, RIGHT, digest=True).select(COLUMNS).collect()) == order(walk(docs))


def test_groups_as_text(spark):
    df = spark.createDataFrame([(1, "unhappily yes"), (2, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["groups"] for r in token_alignment.align(df, LEFT, RIGHT).collect()}
    assert got[2] == "" and hashlib.sha256(got[1].encode()).hexdigest() == walk([(1, "unhappily yes")])[0][-1]


def test_every_code_point_is_split_alike():
    """The ranks with the byte-level expression say what the file's own library says, for every character in four contexts."""
    own = Tokenizer.from_file(LEFT)
    own.encode_special_tokens = True
    made = token_alignment.ByteLevel(LEFT)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 997 * 4):
        text = "".join(f" a{c}1{c} {c}{c}x" for c in points[k : k + 997])
        assert own.encode(text, add_special_tokens=False).ids == made.encode([text])[0]
