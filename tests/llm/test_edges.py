"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names for every operator and stage."""

import pytest

import corpus_pipeline
from barflow.llm import quality_rules, secret_scan, simhash, url_filter
from barflow.llm import queries as registered

LONG = " ".join(f"word{k % 5000}" for k in range(30_000))
ROWS = [
    (1, "one two three four five six seven eight nine ten eleven twelve", "en", "s1", 10),
    (1, "one two three four five six seven eight nine ten eleven twelve", "en", "s1", 10),
    (2, None, None, None, None),
    (3, "", "", "", 0),
    (None, "a text without an id but with plenty of words to count and keep here", "en", "s2", 60),
    (None, None, None, None, None),
    (4, LONG, "fr", "s3", len(LONG)),
    (5, " \t\n\r ", "de", "s1", 5),
    (6, "ONE two three four five six seven eight nine ten eleven twelve", "en", "s2", 10),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = {c: c for c in ("row_id", "row_hash", "_row", "_text", "_words", "ids", "decoded", "fp", "node", "key", "n_words", "kept", "host", "item", "score", "label", "value", "p", "n", "site")}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """Table folders: odd rows, and no rows."""
    from pyspark.sql import functions as F

    out = {}
    for name, n in (("odd", None), ("none", 0)):
        d = tmp_path_factory.mktemp(name)
        docs = spark.createDataFrame(ROWS[:n], SCHEMA).withColumns({c: F.lit(1) for c in CLASH})
        docs.write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 0), (6, None, None)][:n], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve"), (2, None), (None, "")][:n], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        pages = [(1, "http://a.Example.com/de/1?x", '<a href="https://b.example.org/en/2">'), (None, None, None), (2, "no scheme", ""), (3, "x://", "<a href=//c>"), (1, "http://a.Example.com/de/1?x", None)]
        spark.createDataFrame(pages[:n], "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "path", "rule", "_id", "kind")}).write.parquet(f"{d}/pages.parquet")
        vectors = [(1, [0.1, 0.2]), (1, [0.1, 0.2]), (2, [0.3, -0.5]), (None, [0.5, 0.5]), (3, None), (4, [None, 0.0]), (5, [float("nan"), 0.0])]
        embeddings = spark.createDataFrame(vectors[:n], "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("x", "_id", "n", "place")})
        embeddings.write.parquet(f"{d}/embeddings.parquet")
        out[name] = str(d)
    return out


@pytest.mark.parametrize("name", sorted(registered.QUERIES))
@pytest.mark.parametrize("kind", ["odd", "none"])
def test_queries(spark, folders, name, kind):
    rows = registered.QUERIES[name](spark, folders[kind]).collect()
    if kind == "none":
        assert rows == []
    elif name == "op5_secret_scan":
        assert all(r["doc_id"] == 4 or not r["is_secret"] for r in rows)
    elif name == "op1_url_filter":
        assert len(rows) == 5 and sum(r["host"] == "" for r in rows) == 3
    elif name == "op11_embedding_whitening":
        assert sorted(str(r["vec_id"]) for r in rows) == ["1"] * 4 + ["2"] * 2 + ["None"] * 2
    else:
        assert len(rows) == len(ROWS)
        assert [r["doc_id"] for r in rows].count(None) == 2


@pytest.mark.parametrize("kind", ["odd", "none"])
def test_pipeline_stages(spark, folders, kind):
    docs = spark.read.parquet(f"{folders[kind]}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folders[kind])
        rows = out.collect()
        if name != "byte_level_bpe":
            assert out.columns == docs.columns
        assert len(rows) <= len(ROWS)
        if kind == "none":
            assert not rows


def test_stages_one_after_another(spark, folders, tmp_path):
    """Rule failures go, lines stay, one of the equal sets stays, the benchmark's text goes, and what is left is encoded."""
    docs = spark.read.parquet(f"{folders['odd']}/documents.parquet")
    left = {"quality_rules": ["1", "1", "6", "None"], "line_dedup": ["1", "1", "6", "None"], "simhash_near_dedup": ["1", "None"], "decontamination": ["None"]}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folders["odd"]).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name in left:
            assert sorted(str(r["doc_id"]) for r in docs.collect()) == left[name]
    row = docs.collect()[0]
    assert docs.count() == 1 and row["round_trip"] and row["n_tokens"] == len(row["ids"]) > 0


def test_equal_sets_keep_one_and_ids_may_be_null(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    got = simhash.keep_one(rows).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "2", "4", "None"]


def test_filter_keeps_columns(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    got = quality_rules.filter_documents(rows)
    assert got.columns == rows.columns
    assert sorted(str(r["doc_id"]) for r in got.collect()) == ["1", "1", "6", "None"]


def test_one_class_of_findings_scores_as_that_class(spark):
    docs = spark.createDataFrame([(1, 'token = "0123456789abcdef0123456789abcdef01234567" and more', "s")], "doc_id long, text string, source string")
    for rows, score in (([("key = 00aa11bb22cc33dd44ee", "s", 1), (None, None, None)], 1.0), ([("key = 00aa11bb22cc33dd44ee", "s", None)], 0.0), ([], 0.0)):
        known = spark.createDataFrame(rows, "snippet string, path string, label int")
        assert [r["score"] for r in secret_scan.scan(docs, known).collect()] == [score]


def test_hosts_without_rules_are_allowed(spark):
    pages = spark.createDataFrame([(1, "http://plain.example.net/x", "")], "page_id long, url string, html string")
    assert [r["verdict"] for r in url_filter.judge(pages).collect()] == ["allow"]
