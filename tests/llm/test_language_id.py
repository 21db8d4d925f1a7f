"""The recurrent network: gradients, windows against a plain loop, held-out accuracy."""

import zlib

import numpy as np
import pytest

from barflow.llm import language_id
from barflow.llm import queries as registered
from barflow.llm.common import table


@pytest.fixture(scope="module")
def net(spark, sf_dir):
    return language_id.fit(language_id.sample(table(spark, sf_dir, "documents")), 60)


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    net = language_id._fresh(["a", "b", "c"], rng)
    for side in (net.ahead, net.behind):
        side.table, side.turn = side.table.astype(float), side.turn.astype(float)
    net.weights, net.bias = net.weights.astype(float), net.bias.astype(float)
    data, live, label = rng.integers(0, 256, (7, 5)), np.ones((7, 5)), rng.integers(0, 3, 5)
    live[4:, 2] = 0
    _, slopes = net.loss(data, live, label)
    for p, d in zip(net.parameters(), slopes):
        at = np.unravel_index(np.abs(d).argmax(), d.shape)
        old, step = p[at], 1e-4
        p[at] = old + step
        above = net.loss(data, live, label)[0]
        p[at] = old - step
        below = net.loss(data, live, label)[0]
        p[at] = old
        assert (above - below) / (2 * step) == pytest.approx(d[at], rel=1e-3)


def plain(net, data):
    """Position probabilities of one text, byte by byte: windows with a lead on either side."""

    def run(side, some):
        h, out = np.zeros(side.turn.shape[1]), []
        size = len(h)
        for b in some:
            u, x = side.turn.astype(float) @ h, side.table[:, b].astype(float)
            z, r = np.split(0.5 + 0.5 * language_id._squash(x[: 2 * size] + u[: 2 * size]), 2)
            new = language_id._squash(x[2 * size :] + r * u[2 * size :])
            h = new + z * (h - new)
            out.append(h)
        return out

    found = []
    for a in range(0, len(data), language_id.WINDOW):
        b = min(len(data), a + language_id.WINDOW)
        lead, tail = max(0, a - language_id.LEAD), min(len(data), b + language_id.LEAD)
        ahead, behind = run(net.ahead, data[lead:b])[a - lead :], run(net.behind, data[a:tail][::-1])[::-1]
        for x, y in zip(ahead, behind):
            logits = net.weights.astype(float) @ np.concatenate([x, y]) + net.bias
            e = np.exp(logits - logits.max())
            found.append(e / e.sum())
    return np.array(found)


def test_windows_equal_a_plain_loop(net):
    rng = np.random.default_rng(1)
    w, lead = language_id.WINDOW, language_id.LEAD
    sizes = np.array([1, 7, 0, w - 1, w, w + 1, w + lead - 1, w + lead, w + lead + 1, 3 * w, 3 * w + 5])
    data = rng.integers(32, 123, sizes.sum()).astype(np.uint8)
    starts = np.cumsum(sizes) - sizes
    total, marks = net.read(data, starts, sizes, labels=True)
    for k, (a, n) in enumerate(zip(starts, sizes)):
        if n:
            each = plain(net, data[a : a + n])
            np.testing.assert_allclose(total[k], each.sum(axis=0), rtol=1e-3, atol=1e-3)
            sure = np.sort(each, axis=1)[:, -1] - np.sort(each, axis=1)[:, -2] > 1e-3
            assert (marks[a : a + n] == each.argmax(axis=1))[sure].all()
    assert not total[2].any()


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r for r in table(spark, folder, "documents").collect()}
    rows = registered.QUERIES["op12_language_id"](spark, folder).collect()
    assert len(rows) == len(docs) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in rows if r["held_out"]]
    assert np.mean(held) >= 0.98


def test_texts_without_letters_and_runs(spark, net):
    rows = [(1, None), (2, ""), (3, "123 !!\n"), (4, "the of and " * 200), (None, "the of and " * 200), (4, "Ü")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as held_out", "'x' as lang_pred", "2 as _text")
    got = language_id.identify(df, net, runs=True).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "2", "3", "4", "4", "None"]
    for r in got:
        if r["doc_id"] in (1, 2, 3):
            assert (r["lang_pred"], r["score"], r["runs"]) == ("und", 0.0, [])
        else:
            ends = [0] + [x["start"] + x["n_bytes"] for x in r["runs"]]
            assert [x["start"] for x in r["runs"]] == ends[:-1] and ends[-1] in (2200, 2)
            assert all(x["lang"] != y["lang"] for x, y in zip(r["runs"], r["runs"][1:]))


def test_nothing_to_learn_from_or_one_language(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, "def", None)], "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in language_id.identify(df, language_id.fit(language_id.sample(df))).collect()] == ["und", "und"]
    one = language_id.fit([("xx", b"abc")], 2)
    assert [(r["lang_pred"], r["score"]) for r in language_id.identify(df, one).collect()] == [("xx", 1.0)] * 2


def test_held_out_rows_teach_nothing(spark):
    ids = [k for k in range(60) if zlib.crc32(str(k).encode()) % 4 == 2]
    df = spark.createDataFrame([(k, f"text {k}", "zz" if k in ids else "aa") for k in range(60)], "doc_id long, text string, lang string")
    assert {lang for lang, _ in language_id.sample(df)} == {"aa"}
