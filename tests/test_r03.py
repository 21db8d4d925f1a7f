"""What the findings of round 3 named: cost of the story fold, pairs and letter counts, and the ratio of symbols with too few trades."""

import random
from types import SimpleNamespace

import duckdb
from pyspark.sql import functions as F

from barflow.functions import text as T
from barflow.llm import simhash
from barflow.operators import news
from barflow.queries import QUERIES, SQL


def reports(n, seed=3):
    rng = random.Random(seed)
    subjects = [[rng.randrange(40_000) for _ in range(120)] for _ in range(n)]
    for k in range(n):
        words = set(subjects[rng.randrange(k // 2, k + 1)])
        words -= set(rng.sample(sorted(words), rng.randrange(30)))
        yield SimpleNamespace(item_id=k, tokens=sorted(words), published_at=k, source=f"s{k % 7}:x", tier=1 + k % 4)


def test_a_report_is_not_compared_with_every_story():
    class Counted(set):
        seen = 0

        def __rand__(self, other):
            Counted.seen += 1
            return set(self) & set(other)

    stories = news.story_fold(0.6, 10**9)()
    for r in reports(600):
        story = stories.join(r)
        story["words"] = Counted(story["words"])
    compared = Counted.seen
    assert len(stories.active()) > 200 and compared < 600 * 5


def test_the_fold_gives_what_the_plain_fold_gives():
    window, stories, active = 150, news.story_fold(0.6, 150)(), []
    for r in reports(500):
        words = set(r.tokens)
        active = [c for c in active if r.published_at - c["last"] <= window]
        plain = next((c for c in active if len(words & c["words"]) >= 0.6 * (len(words | c["words"]) or 1)), None)
        if plain is None:
            plain = {"words": set(), "sources": set(), "tier": r.tier}
            active.append(plain)
        plain["words"] |= words
        plain["sources"].add(r.source.split(":")[0])
        plain["tier"], plain["last"] = min(plain["tier"], r.tier), r.published_at
        assert stories.join(r) == plain
    stories.forget(499)
    assert stories.active() == active


def test_pairs_are_all_there_and_words_are_not_dealt_one_by_one(spark):
    rng = random.Random(8)
    rows = []
    for k in range(240):
        words = [f"w{x}" for x in range(k % 12 * 20, k % 12 * 20 + 20)]
        for _ in range(rng.randrange(9)):
            words[rng.randrange(20)] = f"o{rng.randrange(50)}"
        rows.append((k, "st"[k // 12 % 2], " ".join(words)))
    rows.append((240, "s", ""))
    items = spark.createDataFrame(rows, "item_id long, symbol string, body string").withColumn("published_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    found = news.similar_pairs(items, 0.6)
    sets = [(i, s, set(t.split())) for i, s, t in rows if t]
    want = {(a, b): len(x & y) / len(x | y) for a, s, x in sets for b, t, y in sets if a < b and s == t and len(x & y) >= 0.6 * len(x | y)}
    assert len(want) > 100 and {(r["a"], r["b"]): r["similarity"] for r in found.collect()} == want
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()


def test_symbols_of_too_few_trades_have_a_ratio_in_query_and_sql(spark, sf_dir, tmp_path):
    cut = f"SELECT * FROM read_parquet('{sf_dir}/events.parquet') WHERE event_type <> 'view' OR ts < TIMESTAMP '2024-01-01' + (SELECT min(ts) - TIMESTAMP '2024-01-01' FROM read_parquet('{sf_dir}/events.parquet')) + INTERVAL 12 DAY"
    db = duckdb.connect()
    db.execute(f"COPY ({cut}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    db.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet')")
    got = sorted((r["symbol"], f"{r['sharpe']:.6f}") for r in QUERIES["per_trade_sharpe"](spark, str(tmp_path)).collect())
    names = db.execute(SQL["per_trade_sharpe"])
    assert ("view", "0.000000") in got
    assert got == sorted((a, f"{b:.6f}") for a, b in names.fetchall())


def test_copies_by_fingerprint_are_near_copies_in_the_pipeline(spark):
    phrase = " ".join(f"p{k}" for k in range(20))
    tails = [" ".join(f"{c}{k}" for k in range(30)) for c in "abc"]
    rows = [(7, f"{phrase} " * 300 + tails[0]), (3, f"{phrase} " * 300 + tails[1]), (9, tails[2]), (11, f"{tails[2]} x y"), (4, "one two")]
    a, b = (simhash.fingerprint(t) for _, t in rows[:2])
    assert (a ^ b).bit_count() <= simhash.LINK_BITS
    sets = [set(simhash.shingle_set(t).tolist()) for _, t in rows[:2]]
    assert len(sets[0] & sets[1]) < simhash.SIMILARITY * len(sets[0] | sets[1])
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == [3, 4, 9]


def test_letters_are_counted_at_once_and_texts_are_read_once(spark):
    rows = [(1, None), (2, ""), (3, "abc 12"), (4, "\u4e00\u9fff\ua000"), (5, "\u4e00 abcd"), (6, "ab \u4e00"), (7, "\U00020000 x"), (8, "\u4e00" * 3 + "zZ")]
    docs = spark.createDataFrame(rows, "k long, t string")
    got = {r["k"]: (r["n"]["cjk"], r["n"]["latin"], r["l"]) for r in docs.select("k", T.letter_counts(F.col("t")).alias("n"), T.language(F.col("t")).alias("l")).collect()}
    assert got == {1: (0, 0, "en"), 2: (0, 0, "en"), 3: (0, 3, "en"), 4: (2, 0, "zh"), 5: (1, 4, "mixed"), 6: (1, 2, "mixed"), 7: (0, 1, "en"), 8: (3, 2, "zh")}


def test_two_lexicons_split_a_text_once(spark, sf_dir):
    plan = QUERIES["bilingual_scores"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    assert "regexp_replace(" not in plan
