"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger row holds the measurements and one
bit per rule that the document fails. Policies are versioned sets of rules, so a policy
is applied, and its ablations are computed, with bit operations on the ledger alone.

Nulls: a null text counts as the empty text. Empty texts have no words and fail
``too_short``. Repeated rows are judged one by one. Columns of the input whose names
clash with measurements are not read and do not reach the ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, whole_text, words_of

WINDOW = 5


def _share(part: str, whole: str, over: float) -> Column:
    return F.col(part) > F.col(whole) * F.lit(over)


#: Rule name -> condition under which a document fails; a rule's place is its bit.
RULES = {
    "too_short": lambda: F.col("n_words") < 10,
    "repeated_words": lambda: 100 * F.col("n_repeat_words") > 20 * F.col("n_words"),
    "symbols": lambda: _share("n_symbols", "n_words", 0.25),
    "duplicate_lines": lambda: _share("n_dup_lines", "n_lines", 0.5),
    "word_length": lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words")),
    "shouting": lambda: _share("n_upper", "word_chars", 0.4),
    "exclamations": lambda: _share("n_exclamations", "n_words", 0.5),
}
BITS = {name: 1 << k for k, name in enumerate(RULES)}

#: Version -> rules that reject a document.
POLICIES = {
    1: ("too_short", "repeated_words"),
    2: ("too_short", "repeated_words", "symbols", "shouting", "exclamations"),
    3: tuple(RULES),
}
BASE_POLICY, DEFAULT_POLICY = 1, 3


def policy_mask(version: int) -> int:
    return sum(BITS[name] for name in POLICIES[version])


def _length_without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col`` and every measurement. ``id_col`` may be a struct that carries a whole row.

    Windows of five words are told apart by 64-bit hashes, within one text only. Each
    array is a column of its own, read by the folds and not built again.
    """
    words, windows, placed, lines = (F.col(c) for c in ("_words", "_windows", "_placed", "_lines"))
    df = docs.select(F.col(id_col), whole_text(text_col).alias("_text"))
    df = df.select("*", words_of(F.col("_text")).alias("_words"))
    df = df.select(
        "*",
        F.when(
            F.size(words) >= WINDOW,
            F.transform(
                F.sequence(F.lit(0), F.size(words) - WINDOW),
                lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]),
            ),
        ).alias("_windows"),
        F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    df = df.select(
        "*",
        F.when(
            F.size(F.array_distinct(windows)) < F.size(windows),
            F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("_placed"),
    )
    df = df.select(
        "*",
        F.sort_array(
            F.transform(
                F.filter(
                    F.transform(
                        placed,
                        lambda x, k: F.struct(
                            x["i"].alias("i"),
                            (
                                F.coalesce(F.get(placed, k - 1)["h"] == x["h"], F.lit(False))
                                | F.coalesce(F.get(placed, k + 1)["h"] == x["h"], F.lit(False))
                            ).alias("again"),
                        ),
                    ),
                    lambda x: x["again"],
                ),
                lambda x: x["i"],
            )
        ).alias("_starts"),
    )
    return df.select(
        id_col,
        F.size(words).cast("long").alias("n_words"),
        _length_without(F.col("_text"), SPACE).alias("word_chars"),
        _length_without(F.col("_text"), r"[^#*$%&|<>]+").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.coalesce(
            F.aggregate(
                F.col("_starts"),
                F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at")),
                lambda a, s: F.struct((a["n"] + F.least(F.lit(WINDOW), s - a["at"])).alias("n"), s.alias("at")),
                lambda a: a["n"],
            ),
            F.lit(0),
        ).cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        _length_without(F.col("_text"), "[^A-Z]+").alias("n_upper"),
        _length_without(F.col("_text"), "[^!]+").alias("n_exclamations"),
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements and ``fail_mask``, one bit per failed rule; no rule is evaluated again after this."""
    mask = F.lit(0).cast("long")
    for name, fails in RULES.items():
        mask = mask.bitwiseOR(F.when(fails(), F.lit(BITS[name])).otherwise(0).cast("long"))
    return measure(docs, id_col, text_col).select("*", mask.alias("fail_mask"))


def apply_policy(rows: DataFrame, version: int = DEFAULT_POLICY) -> DataFrame:
    """Ledger rows with ``base_failed`` and ``kept`` under a policy version."""
    fails = lambda v: F.col("fail_mask").bitwiseAND(F.lit(policy_mask(v))) != 0
    return rows.select("*", fails(BASE_POLICY).alias("base_failed"), (~fails(BASE_POLICY) & ~fails(version)).alias("kept"))


def ablations(rows: DataFrame, version: int = DEFAULT_POLICY) -> DataFrame:
    """For each rule of a policy: documents that fail it, that only it rejects, and that the policy without it keeps.

    One aggregation counts documents per distinct mask (at most 2 ** rules rows); the
    rest reads those counts.
    """
    whole = policy_mask(version)
    masks = rows.groupBy(F.col("fail_mask").bitwiseAND(F.lit(whole)).alias("mask")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(BITS[n]).cast("long").alias("bit")) for n in POLICIES[version]])
    each = masks.select("mask", "n", F.inline(rules))
    count = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    return each.groupBy("rule").agg(
        count(F.col("mask").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        count(F.col("mask") == F.col("bit")).alias("n_only_this"),
        count(F.col("mask").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("n_kept_without"),
    )


def filter_documents(docs: DataFrame, version: int = DEFAULT_POLICY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that a policy keeps, with their own columns only."""
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text_col).alias("_own"))
    judged = apply_policy(ledger(packed, "_row", "_own"), version)
    # Stored before it is filtered: a filter would be pushed down to the scan with every measurement
    # written out in it, again for each use.
    return cut(judged.select("_row", "kept")).filter("kept").select("_row.*")
