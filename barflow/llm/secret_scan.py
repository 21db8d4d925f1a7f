"""Secret scan: candidates by shape or context, false positives removed by a random forest.

A candidate by shape is a run of twelve characters or more of the kind that keys are made
of, cut out of its word at quotes, commas, colons and the like, with a digit or with
capitals inside. A candidate by context has any shape and length: what is assigned to a
name with a keyword in it, follows a bearer or basic scheme, or stands where a URL has
its password. Its features are its length, its character transitions, how much of it the
corpus's own vocabulary covers, where it was found (the path's rate of candidates) and
the words beside it. The forest learns from labelled findings, a table of snippets whose
candidates are known to be secrets or not.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, whole_text, words_of

#: A run of key characters, and what a candidate must have besides.
RUN = r"[A-Za-z0-9][A-Za-z0-9_\-+/=.]{10,}[A-Za-z0-9=]"
MIXED = "[0-9]|[a-z][A-Z]"
#: Words that name a secret.
KEYWORDS = ("auth", "bearer", "credential", "key", "passwd", "password", "pwd", "secret", "token")
#: What a word assigns to such a name, and the password of a URL in a word.
ASSIGNED = "(?i)(?:" + "|".join(KEYWORDS) + r")[a-z0-9_\-]*[\"'`]?[=:]+[\"'`]?([^\s\"'`,;={}()<>\[\]]+)"
URL_PASSWORD = r"://[^/:@\s]*:([^@\s]+)@"
SCHEMES = ("bearer", "basic")
#: Sources whose rates are joined in the map tasks; more of them are joined by shuffle.
MAX_MAP_PATHS = 100_000
#: Labelled findings that the forest is fitted on at most (those of least hash), trees and depth.
MAX_TRAIN, TREES, DEPTH, SEED = 20_000, 30, 6, 7
#: Documents that must use a word before it counts as vocabulary; shorter letter runs are not looked up.
VOCABULARY_DOCS, MIN_LETTERS = 3, 3
#: A finding of this score or more is a secret.
THRESHOLD = 0.5


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(_id, path, place, head, value, before2, before, after): one row per candidate.

    ``place`` counts words from 0, ``head`` is what stands before the value in its own
    word. Equal values of one word are one candidate, and a run by shape inside a value by
    context is none of its own.
    """
    df = docs.select(
        F.col(id_col).alias("_id"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"),
        words_of(whole_text(text_col)).alias("_words"),
    )
    words = F.col("_words")
    beside = lambda i: F.coalesce(F.get(words, i), F.lit(""))
    named = lambda w: F.lower(w).rlike("|".join(KEYWORDS))
    shaped = lambda w: F.when(
        (F.length(w) >= 12) & w.rlike(MIXED), F.filter(F.regexp_extract_all(w, F.lit(RUN), F.lit(0)), lambda r: r.rlike(MIXED))
    ).otherwise(F.array().cast("array<string>"))
    inside = lambda w: F.when(
        w.contains("=") | w.contains(":"),
        F.concat(F.regexp_extract_all(w, F.lit(ASSIGNED), F.lit(1)), F.regexp_extract_all(w, F.lit(URL_PASSWORD), F.lit(1))),
    ).otherwise(F.array().cast("array<string>"))
    bare = lambda w: F.regexp_extract(w, r"^[\"'`({\[<]*([^\"'`,;{}()<>\[\]]*)", 1)
    ends = lambda w: F.endswith(w, F.lit("=")) | F.endswith(w, F.lit(":"))
    told = lambda b2, b: F.when(ends(b), named(b) | named(b2)).otherwise(F.lower(b).isin(*SCHEMES) & ends(b2))
    meant = lambda w, b2, b: F.concat(inside(w), F.when(told(b2, b), F.array(bare(w))).otherwise(F.array().cast("array<string>")))

    def values(w: Column, b2: Column, b: Column) -> Column:
        context = F.filter(meant(w, b2, b), lambda v: v.rlike("[A-Za-z0-9]") & ~F.lower(v).isin(*SCHEMES))
        return F.array_distinct(F.concat(context, F.filter(shaped(w), lambda r: ~F.exists(context, lambda v: v.contains(r)))))

    found = F.filter(
        F.transform(
            words,
            lambda w, i: F.struct(
                i.alias("place"), w.alias("word"), values(w, beside(i - 2), beside(i - 1)).alias("values"),
                beside(i - 2).alias("before2"), beside(i - 1).alias("before"), beside(i + 1).alias("after"),
            ),
        ),
        lambda c: F.size(c["values"]) > 0,
    )
    rows = df.select("_id", "path", F.explode(found).alias("c")).select("_id", "path", "c.*")
    rows = rows.select("_id", "path", "place", "word", F.explode("values").alias("value"), "before2", "before", "after")
    head = F.left("word", F.expr("locate(value, word) - 1"))
    return rows.select("_id", "path", "place", head.alias("head"), "value", "before2", "before", "after")


def _letter_runs(col: Column) -> Column:
    return F.filter(F.split(F.lower(col), "[^a-z]+"), lambda x: F.length(x) >= MIN_LETTERS)


def coverage(found: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(value, covered): share of a value's characters in letter runs that are words of ``VOCABULARY_DOCS`` documents or more."""
    runs = cut(found.select("value").distinct().select("value", F.explode_outer(_letter_runs(F.col("value"))).alias("run")))
    wanted = runs.select(F.col("run").alias("w")).filter("w is not null").distinct()
    spoken = docs.select(F.explode(F.array_distinct(F.filter(_letter_words(text_col), lambda x: F.length(x) >= MIN_LETTERS))).alias("w"))
    known = spoken.join(wanted, "w", "left_semi").groupBy("w").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= VOCABULARY_DOCS)
    hit = runs.join(known.select(F.col("w").alias("run"), F.lit(1).alias("hit")), "run", "left")
    return hit.groupBy("value").agg(
        (F.sum(F.when(F.col("hit") == 1, F.length("run")).otherwise(0)) / F.greatest(F.lit(1), F.first(F.length("value")))).alias("covered")
    )


def _letter_words(text_col: str) -> Column:
    """Words of letters only, such as stand free in a text; parts of keys do not count."""
    bare = F.transform(words_of(F.lower(whole_text(text_col))), lambda w: F.rtrim(w, F.lit(".,;:!?")))
    return F.filter(bare, lambda w: w.rlike("^[a-z]+$"))


FEATURES = (
    "length", "digits", "uppers", "hexes", "digit_to_letter", "letter_to_digit", "lower_to_upper", "vowel_to_consonant",
    "distinct_characters", "longest_digits", "separators", "covered", "path_rate", "keyword_before", "assigned", "quoted", "keyword_after",
)


def features(found: DataFrame, docs: DataFrame, text_col: str = "text", path_col: str = "source") -> DataFrame:
    """Candidates with one double column per entry of ``FEATURES``; what they say of the corpus is counted in ``docs``."""
    rates = docs.groupBy(F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path")).agg(F.count(F.lit(1)).alias("docs")).join(
        found.filter("label is null").groupBy("path").agg(F.count(F.lit(1)).alias("n")), "path", "left"
    ).select("path", (F.coalesce("n", F.lit(0)) / F.col("docs")).alias("path_rate"))
    rates = cut(rates)
    rates = F.broadcast(rates) if rates.count() <= MAX_MAP_PATHS else rates.hint("merge")
    value, size = F.col("value"), F.greatest(F.lit(1), F.length("value"))
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)) / size
    names = "(?i)" + "|".join(KEYWORDS)
    df = found.join(cut(coverage(found, docs, text_col)).hint("merge"), "value").join(rates, "path", "left").withColumn(
        "path_rate", F.coalesce("path_rate", F.lit(0.0))
    )
    columns = {
        "length": F.length("value"),
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "hexes": share("[0-9a-fA-F]"),
        "digit_to_letter": share("[0-9](?=[A-Za-z])"),
        "letter_to_digit": share("[A-Za-z](?=[0-9])"),
        "lower_to_upper": share("[a-z](?=[A-Z])"),
        "vowel_to_consonant": share("[aeiouAEIOU](?=[b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z])"),
        "distinct_characters": F.size(F.array_distinct(F.split(value, ""))) / size,
        "longest_digits": F.array_max(F.transform(F.split(value, "[^0-9]+"), lambda x: F.length(x))) / size,
        "separators": share("[_+/=.-]"),
        "keyword_before": F.col("head").rlike(names) | F.col("before").rlike(names) | F.col("before2").rlike(names),
        "assigned": F.col("head").rlike("[=:][\"'`]?$") | (F.col("before").rlike("[=:][\"'`]?$") & ~F.col("head").rlike("[A-Za-z0-9]")),
        "quoted": F.col("head").rlike("[\"'`]$"),
        "keyword_after": F.col("after").rlike(names),
    }
    return df.withColumns({k: v.cast("double") for k, v in columns.items()}).withColumn("features", _vector())


def _vector() -> Column:
    from pyspark.ml.functions import array_to_vector

    return array_to_vector(F.array(*[F.col(c).cast("double") for c in FEATURES]))


def fit(labelled: DataFrame):
    """A forest fitted on ``MAX_TRAIN`` labelled findings at most (features, label); None if a class is missing."""
    order = F.xxhash64("value", "label")
    chosen = cut(labelled.filter("label is not null").select("features", F.col("label").cast("double"), order.alias("o")).orderBy("o").limit(MAX_TRAIN))
    if chosen.select("label").distinct().count() < 2:
        return None
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="features", labelCol="label").fit(
        chosen.repartitionByRange(8, "o").sortWithinPartitions("o")
    )


def scan(
    docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", threshold: float = THRESHOLD
) -> DataFrame:
    """One row per candidate: id, place, length and SHA-256 of the value, score, and whether it is a secret.

    ``labelled`` has the known findings: (snippet, path, label), where label 1 says that
    the candidates of the snippet are secrets, 0 that none is; a null label or snippet
    tells nothing. If one class is missing, no forest can be fitted and the score is the
    known class, or zero without labels. Null texts hold no candidate, null paths are one
    path; repeated documents are scanned each. Extra columns are not read.
    """
    known = labelled.select(F.col("label").cast("int").alias("_id"), F.col("snippet").alias("text"), F.col("path").alias("source")).filter("_id is not null")
    found = cut(
        candidates(docs, id_col, text_col, path_col).withColumn("label", F.lit(None).cast("int")).unionByName(
            candidates(known, "_id", "text", "source").withColumns({"label": F.col("_id"), "_id": F.lit(None).cast(docs.schema[id_col].dataType)})
        )
    )
    table = cut(features(found, docs, text_col, path_col))
    model, rows = fit(table), table.filter("label is null")
    if model is None:
        only = table.agg(F.max("label")).first()[0] or 0
        scored = rows.withColumn("score", F.lit(float(only)))
    else:
        scored = model.transform(rows).withColumn("score", vector_to_array("probability")[1])
    return scored.select(
        F.col("_id").alias(id_col), "place", F.length("value").alias("length"), F.sha2("value", 256).alias("value_sha256"),
        F.round("score", 6).alias("score"), (F.col("score") >= threshold).alias("is_secret"),
    )


#: What stands before a planted secret, and before a planted value that is none. {} is the value.
TRUE_CONTEXTS = (
    'token = "{}"', "password={}", "secret: {}", '{"api_key":"{}"}', "Authorization: Bearer {}", "export AWS_SECRET_ACCESS_KEY='{}'",
    "postgres://app:{}@db.internal/main", "client_secret, {},", "auth_key = {}", "Passwd : '{}'", 'TOKEN = "{}"', "PWD={};",
)
FALSE_CONTEXTS = (
    "commit {}", "sha256:{}", 'etag="{}"', "request id: {}", "see {} for more", '<img src="img/{}.png">', "primary key: {}", "invoice number = {}",
    "mail user@{} now", "version {} of", "token count: {}", "{}", "at {} we", 'checksum = "{}"',
)
#: The same for values that only their context makes candidates: passwords, and words that merely follow a keyword.
TRUE_ASSIGNMENTS = (
    "password = {}", "pwd: {}", "secret={}", 'passwd="{}"', "db_password: {}", "postgres://app:{}@db.internal/main", "auth_token={};", "my password: {}",
)
FALSE_ASSIGNMENTS = (
    "password: {}", "the key: {}", "secret = {}", "token: {}", "keyword={}", "http://{}:8080/a@{}", 'author: "{}"', "keys: {}",
)


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", most: int = MAX_TRAIN) -> DataFrame:
    """Labelled findings (snippet, path, label, fold, template) for corpora without any: values made from hashes, planted between words of ``most`` documents.

    Secrets are hexadecimal, Base64, Base32 and prefixed keys and token triples; others
    are digests, UUIDs, numbers, times, addresses, versions and names of several words.
    Forty hexadecimal digits are a secret in one context and a commit in another, so
    neither shape nor context alone tells the classes apart. The documents are those of
    least hash; ``fold`` is 0 to 4 by hash, to hold findings out, ``template`` the number
    of the context within its kind, to hold whole contexts out. A quarter are short: joined
    words and words with digits as passwords, single words of the text where none is meant.
    """
    words = F.slice(F.filter(words_of(whole_text(text_col)), lambda w: (F.length(w) < 12) & ~w.rlike("[=:]")), 1, 6)
    h = F.xxhash64(F.col(id_col).cast("string"), whole_text(text_col))
    # Little more than ``most`` rows, and few words of each, are left to be put in order.
    share = 1.2 * most / max(docs.count(), 1)
    chosen = docs.select(F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), h.alias("h"), words.alias("w"))
    if share < 1:
        chosen = chosen.filter(F.shiftrightunsigned("h", 32) < int(share * 2**32))
    chosen = chosen.orderBy("h").limit(most)
    part = lambda k, n: F.pmod(F.xxhash64("h", F.lit(k)), F.lit(n)).cast("int")
    hexes, packed = F.sha2(F.col("h").cast("string"), 256), F.base64(F.unhex(F.sha2(F.concat(F.lit("b"), F.col("h").cast("string")), 256)))
    plain = F.regexp_replace(packed, "[+/=]", "x")
    digits = F.lpad(F.abs("h").cast("string"), 18, "7")
    word = lambda k: F.coalesce(F.get("w", part(k, 5)), F.lit("name"))
    joined = F.concat(word(8), F.lit("_"), word(9), F.initcap(word(10)), part(11, 100).cast("string"))
    mixed = F.when(part(3, 2) == 0, F.upper(hexes)).otherwise(hexes)
    true_kinds = (
        F.left(mixed, F.lit(40)), F.left(mixed, F.lit(32)), mixed, F.left(packed, part(4, 24) + 14), F.left(plain, part(4, 20) + 14),
        F.concat(F.lit("AKIA"), F.left(F.upper(plain), F.lit(16))), F.concat(F.lit("ghp_"), F.left(plain, F.lit(36))),
        F.concat_ws(".", F.concat(F.lit("eyJ"), F.left(plain, F.lit(17))), F.left(plain, F.lit(30)), F.right(plain, F.lit(27))),
    )
    false_kinds = (
        F.left(hexes, F.lit(40)), hexes, F.left(mixed, F.lit(32)),
        F.concat_ws("-", F.substring(hexes, 1, 8), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4), F.substring(hexes, 17, 4), F.substring(hexes, 21, 12)),
        F.left(digits, part(4, 7) + 12), F.concat_ws(".", *[(part(k, 156) + 100).cast("string") for k in (12, 13, 14, 15)]),
        F.date_format(F.timestamp_seconds(part(5, 2_000_000_000)), "yyyy-MM-dd'T'HH:mm:ss"), F.concat(F.lit("mail"), part(5, 99).cast("string"), F.lit(".example.com")),
        joined, F.concat_ws(".", part(5, 30).cast("string"), part(6, 30).cast("string"), F.lit("0-build"), part(7, 9000).cast("string")),
    )
    one_of = lambda values, k: F.element_at(F.array(*values), part(k, len(values)) + 1)
    letters = lambda k: F.regexp_replace(F.lower(word(k)), "[^a-z]+", "")
    upper = F.left(F.upper(F.regexp_replace(packed, "[^A-Za-z]", "")), part(18, 10) + 16)
    passwords = (
        F.concat(letters(8), letters(9), letters(10), letters(19), F.left(F.lower(plain), F.lit(2))),
        F.concat(F.translate(letters(8), "aeios", "43105"), part(11, 1000).cast("string"), F.lit("!")),
        F.concat(F.initcap(letters(9)), F.lit("-"), letters(10), F.lit("$"), part(11, 100).cast("string")), upper,
    )
    meant, label = part(20, 4) == 0, part(1, 2)
    value = F.when(meant, F.when(label == 1, one_of(passwords, 2)).otherwise(F.concat(letters(8), F.when(letters(8) == "", "name").otherwise(""))))
    value = value.when(label == 1, one_of(true_kinds, 2)).otherwise(one_of(false_kinds, 2))
    kinds = ((meant & (label == 1), TRUE_ASSIGNMENTS), (meant, FALSE_ASSIGNMENTS), (label == 1, TRUE_CONTEXTS), (F.lit(True), FALSE_CONTEXTS))
    frame = F.coalesce(*[F.when(when, one_of([F.lit(c) for c in contexts], 16)) for when, contexts in kinds])
    template = F.coalesce(*[F.when(when, part(16, len(contexts))) for when, contexts in kinds])
    inside = F.replace(frame, F.lit("{}"), value)
    near = lambda a: F.array_join(F.slice("w", a, 3), " ")
    return chosen.select(F.concat_ws(" ", near(1), inside, near(4)).alias("snippet"), "path", label.alias("label"), part(17, 5).alias("fold"), template.alias("template"))
