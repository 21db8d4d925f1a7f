"""Queries over news items and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.functions import text as T
from barflow.functions.windows import rounded
from barflow.operators import news
from barflow.plans import sql
from barflow.plans.features import shown
from barflow.plans.registry import query
from barflow.sources import bars as source

#: Words of the fixture's invented languages that stand for good and bad news.
GOOD, BAD = ("with", "avec", "mit", "para"), ("not", "pas", "nicht", "no")


def _hits(words: tuple[str, ...], col: str = "body") -> str:
    return " + ".join(f"regexp_matches(lower({col}), '(^|[^a-z0-9]){w}([^a-z0-9]|$)')::INT" for w in words)


_SENT = f"(CASE WHEN ({_hits(GOOD)}) + ({_hits(BAD)}) = 0 THEN 0 ELSE (({_hits(GOOD)}) - ({_hits(BAD)}))::DOUBLE / (({_hits(GOOD)}) + ({_hits(BAD)})) END)"
_TOKENS = "list_distinct(list_filter(string_split(regexp_replace(lower(body), '[^a-z0-9一-鿿 ]', ' ', 'g'), ' '), lambda x: x <> ''))"


@query(f"WITH {sql.NEWS} SELECT item_id, round({_SENT}, 6) + 0 AS sentiment FROM items")
def lexicon_sentiment(spark: SparkSession, folder: str) -> DataFrame:
    return news.items(spark, folder).select("item_id", rounded(T.sentiment(F.col("body"), GOOD, BAD)).alias("sentiment"))


@query("""SELECT doc_id AS item_id, list_sort(CASE WHEN contains(lower(text), 'the') OR contains(lower(text), 'ing') THEN CASE WHEN contains(lower(text), 'ment') THEN ['EN', 'FR'] ELSE ['EN'] END
WHEN contains(lower(text), 'ment') THEN ['FR'] WHEN contains(lower(text), 'token') THEN ['EN', 'FR'] ELSE [] END)::VARCHAR[] AS tags FROM documents""")
def symbol_tagging(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = T.tags(F.col("text"), {"EN": ("the", "ing"), "FR": ("ment",)}, ("token",))
    return docs.select(F.col("doc_id").alias("item_id"), F.array_sort(found).alias("tags"))


@query("""WITH c AS (SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[^一-鿿]', '', 'g')) AS cjk, length(regexp_replace(coalesce(text, ''), '[^a-zA-Z]', '', 'g')) AS latin FROM documents)
SELECT doc_id, CASE WHEN cjk + latin = 0 THEN 'en' WHEN cjk / (cjk + latin) >= 0.6 THEN 'zh' WHEN cjk / (cjk + latin) <= 0.15 THEN 'en' ELSE 'mixed' END AS language FROM c""")
def language_ratio(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", T.language(F.col("text")).alias("language"))


@query(f"""WITH {sql.NEWS}, b AS (SELECT item_id, symbol, published_at::DATE AS day, {_TOKENS} AS w FROM items)
SELECT x.item_id AS a, y.item_id AS b, round(len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))), 6) + 0 AS similarity
FROM b x JOIN b y ON x.symbol = y.symbol AND x.day = y.day AND x.item_id < y.item_id
WHERE len(x.w) > 0 AND len(y.w) > 0 AND len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))) >= 0.6""")
def token_jaccard_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return news.similar_pairs(news.items(spark, folder), 0.6).select("a", "b", rounded(F.col("similarity")).alias("similarity"))


_PANEL = f"""sn AS (SELECT *, 1 AS corroboration, {_SENT} AS s,
  CASE tier WHEN 1 THEN 1.0 WHEN 2 THEN 0.7 WHEN 3 THEN 0.4 WHEN 4 THEN 0.15 ELSE 0.1 END::DOUBLE AS a, date_trunc('hour', published_at)::TIMESTAMP + INTERVAL 1 HOUR AS bucket_end FROM items),
pn AS (SELECT symbol, bucket_end, round(sum(a * s) / sum(a), 3) AS sentiment, sum(a * s) / sum(a) AS raw, count(*) AS n_items, round(max(a), 3) AS max_authority, max(corroboration) AS corroboration,
  min(tier) AS best, list('[T' || tier || '|证' || corroboration || '] ' || title ORDER BY a DESC, published_at, item_id)[1:3] AS h FROM sn GROUP BY ALL)"""


def plain_items(spark: SparkSession, folder: str) -> DataFrame:
    return news.items(spark, folder).withColumn("corroboration", F.lit(1))


def panel(spark: SparkSession, folder: str) -> DataFrame:
    return news.bucket_panel(plain_items(spark, folder), T.sentiment(F.col("body"), GOOD, BAD))


@query(f"""WITH {sql.NEWS}, {_PANEL} SELECT symbol, bucket_end, sentiment + 0 AS sentiment, n_items, max_authority, corroboration, '情绪:' || CASE WHEN raw > 0.15 THEN '偏多' WHEN raw < -0.15 THEN '偏空' ELSE '中性' END
|| '(可信度' || CASE WHEN best <= 1 THEN '高' WHEN best <= 2 THEN '中' ELSE '低' END || '); ' || array_to_string(h, '; ') AS text FROM pn""")
def news_bucket_panel(spark: SparkSession, folder: str) -> DataFrame:
    return panel(spark, folder).withColumn("sentiment", F.col("sentiment") + F.lit(0.0))


_ALIGNED = f"""{sql.BARS}, {sql.NEWS}, {_PANEL}, al AS (SELECT b.symbol, b.ts, p.sentiment, p.n_items, p.max_authority, p.corroboration,
  (epoch_us(b.ts + INTERVAL 1 HOUR) - epoch_us(p.bucket_end + INTERVAL 5 MINUTE)) / 3.6e9 AS age
  FROM bars b ASOF LEFT JOIN pn p ON p.symbol = b.symbol AND b.ts + INTERVAL 1 HOUR >= p.bucket_end + INTERVAL 5 MINUTE),
fr AS (SELECT *, coalesce(age <= 24, false) AS fresh FROM al)"""


@query(f"""WITH {_ALIGNED} SELECT symbol, ts, round(CASE WHEN fresh THEN sentiment * exp(-age / 6) ELSE 0 END, 6) + 0 AS news_sentiment, CASE WHEN fresh THEN sentiment ELSE 0 END + 0 AS news_sentiment_raw,
CASE WHEN fresh THEN n_items ELSE 0 END::DOUBLE AS news_n_items, CASE WHEN fresh THEN max_authority ELSE 0 END AS news_max_authority, round(least(coalesce(age, 24), 24), 6) AS news_age_hours, fresh::INT::DOUBLE AS has_recent_news FROM fr""")
def asof_ttl_decay(spark: SparkSession, folder: str) -> DataFrame:
    df = news.align_panel(source.hourly(spark, folder), panel(spark, folder))
    return shown(df, "news_sentiment", "news_sentiment_raw", "news_n_items", "news_max_authority", "news_age_hours", "has_recent_news")


_TONE = "CASE WHEN p.raw > 0.15 THEN '偏多' WHEN p.raw < -0.15 THEN '偏空' ELSE '中性' END || '(可信度' || CASE WHEN p.best <= 1 THEN '高' WHEN p.best <= 2 THEN '中' ELSE '低' END"


@query(f"""WITH {_ALIGNED}, tx AS (SELECT b.symbol, b.ts, (epoch_us(b.ts + INTERVAL 1 HOUR) - epoch_us(p.bucket_end + INTERVAL 5 MINUTE)) / 3.6e9 AS age,
  '情绪:' || {_TONE} || '); ' || array_to_string(p.h, '; ') AS text FROM bars b ASOF LEFT JOIN pn p ON p.symbol = b.symbol AND b.ts + INTERVAL 1 HOUR >= p.bucket_end + INTERVAL 5 MINUTE)
SELECT symbol, ts, CASE WHEN coalesce(age <= 24, false) THEN text ELSE '' END AS news_text FROM tx""")
def news_text_asof(spark: SparkSession, folder: str) -> DataFrame:
    """The panel text that each bar's decision may read; empty where it has expired."""
    return news.align_panel(source.hourly(spark, folder), panel(spark, folder)).select("symbol", "ts", "news_text")


def _either(words: tuple[str, ...]) -> str:
    return " + ".join(
        f"regexp_matches(lower(text), '(^|[^a-z0-9]){w}([^a-z0-9]|$)')::INT" if w.isascii() and w.isalnum() else f"contains(lower(text), '{w}')::INT" for w in words
    )


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), c AS (SELECT *, length(regexp_replace(text, '[^一-鿿]', '', 'g')) AS cjk, length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) AS latin,
  {_hits(GOOD, 'text')} AS g, {_hits(BAD, 'text')} AS b, {_either(T.POSITIVE)} AS p, {_either(T.NEGATIVE)} AS n FROM d),
s AS (SELECT doc_id, CASE WHEN cjk + latin = 0 THEN 'en' WHEN cjk / (cjk + latin) >= 0.6 THEN 'zh' WHEN cjk / (cjk + latin) <= 0.15 THEN 'en' ELSE 'mixed' END AS language,
  CASE WHEN g + b = 0 THEN 0 ELSE (g - b)::DOUBLE / (g + b) END AS en, CASE WHEN p + n = 0 THEN 0 ELSE (p - n)::DOUBLE / (p + n) END AS zh FROM c)
SELECT doc_id, language, round(en, 6) + 0 AS en, round(zh, 6) + 0 AS zh, round(greatest(-1, least(1, CASE language WHEN 'en' THEN en WHEN 'zh' THEN zh ELSE 0.5 * en + 0.5 * zh END)), 6) + 0 AS score FROM s""")
def bilingual_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Each text's sentiment by the scorer of its language; the second one has the default words."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    both = T.sentiments(F.col("text"), (GOOD, BAD), (T.POSITIVE, T.NEGATIVE)).alias("both")
    scored = docs.select("doc_id", T.language(F.col("text")).alias("language"), both)
    scored = scored.select("doc_id", "language", F.col("both")[0].alias("en"), F.col("both")[1].alias("zh"))
    return shown(scored.withColumn("score", T.route(F.col("language"), F.col("en"), F.col("zh"))), "en", "zh", "score", keys=("doc_id", "language"))


@query(f"WITH {_ALIGNED} SELECT symbol, round(avg(fresh::INT), 6) + 0 AS news_coverage, CASE WHEN avg(fresh::INT) < 0.9 THEN 'low_news_coverage' END AS tag FROM fr GROUP BY symbol")
def news_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return shown(news.coverage(news.align_panel(source.hourly(spark, folder), panel(spark, folder)), 0.9), "news_coverage", keys=("symbol", "tag"))


@query(f"""WITH {sql.NEWS}, w AS (SELECT *, symbol || ',' || ['view', 'click', 'error'][item_id % 3 + 1] AS symbols FROM items)
SELECT item_id, published_at, source, symbols FROM w WHERE published_at BETWEEN '2024-01-05' AND '2024-01-25' AND list_contains(string_split(symbols, ','), 'view')
AND lower(trim(coalesce(source, ''))) <> 'src1' AND NOT starts_with(lower(trim(coalesce(source, ''))), 'src1:')""")
def corpus_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Items of three weeks that name one of two symbols, without those of a marked source."""
    second = F.get(F.array(*[F.lit(x) for x in ("view", "click", "error")]), F.pmod("item_id", F.lit(3)).cast("int"))
    rows = news.items(spark, folder).withColumn("symbols", F.concat_ws(",", "symbol", second))
    return news.select_items(rows, "2024-01-05", "2024-01-25", "view", marker="src1").select("item_id", "published_at", "source", "symbols")


@query("SELECT event_id, date_trunc('second', ts)::TIMESTAMP AS at FROM events")
def timestamp_parsing(spark: SparkSession, folder: str) -> DataFrame:
    """Times of ticks, written in the spellings that feeds use and read again."""
    rows = spark.read.parquet(f"{folder}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("t"))
    feed, iso = F.date_format("t", "d MMM yyyy HH:mm:ss"), F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss")
    spelt = (F.concat(F.date_format("t", "EEE"), F.lit(", "), feed, F.lit(" GMT")), F.concat(feed, F.lit(" +0000")), F.concat(iso, F.lit("Z")), iso)
    written = F.get(F.array(*spelt), F.pmod("event_id", F.lit(4)).cast("int"))
    return rows.select("event_id", T.parse_time(written).cast("timestamp_ntz").alias("at"))


@query("""WITH x AS (SELECT *, row_number() OVER (PARTITION BY source, md5(text) ORDER BY doc_id) AS k FROM documents) SELECT doc_id, source, n_chars FROM x WHERE k = 1""")
def corpus_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    small = docs.select("doc_id", "source", "n_chars", F.md5("text").alias("digest"))
    return source.keep_first(small, ["source", "digest"], ["doc_id"]).select("doc_id", "source", "n_chars")


@query("SELECT event_type AS symbol, (props->>'$.k')::BIGINT AS k, count(*) AS n, round(sum(value), 4) + 0 AS total FROM events GROUP BY ALL")
def json_payloads(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/events.parquet").withColumn("k", F.from_json("props", "k long")["k"])
    return rows.groupBy(F.col("event_type").alias("symbol"), "k").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("value"), 4).alias("total"))


@query("""SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '<a href="')) AS n_links FROM pages""")
def page_items(spark: SparkSession, folder: str) -> DataFrame:
    """Items from markup: title and number of links."""
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    return pages.select("page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"), F.regexp_count("html", F.lit('<a href="')).cast("long").alias("n_links"))


@query("""SELECT conv_id, count(*) AS n_turns, string_agg('<|' || role || '|>' || text, chr(10) ORDER BY turn, role, text) AS prompt FROM conversations GROUP BY conv_id""")
def chat_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations rendered as prompts; a conversation's turns are one group by nature."""
    rows = spark.read.parquet(f"{folder}/conversations.parquet")
    turn = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    lines = F.transform("t", lambda x: F.concat(F.lit("<|"), x["role"], F.lit("|>"), x["text"]))
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), turn.alias("t")).select("conv_id", "n_turns", F.array_join(lines, "\n").alias("prompt"))


@query()
def dedup_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Point-in-time corroboration of similar reports."""
    return news.snapshots(news.items(spark, folder)).drop("body")


@query()
def corroborated_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Panel of corroborated reports; sentiment is taken where texts are read, so that no text is shuffled."""
    items = news.items(spark, folder).withColumn("sentiment", T.sentiment(F.col("body"), GOOD, BAD))
    return news.bucket_panel(news.snapshots(items), F.col("sentiment"))
