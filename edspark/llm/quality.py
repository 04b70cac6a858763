"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  Its outcome is one bit of
``failed_bits`` and its measurement stays beside it, so a policy - a versioned
set of rules - is one ``AND`` over the stored bits: changing, comparing or
ablating policies never touches the texts again.

Everything is a DataFrame expression; there is no shuffle, as each document's
rules depend on its own text only.

Defined cases: a null text counts as empty (it has no word and fails the rules
``few_words`` and ``no_letter``); a null id is kept as null; repeated rows are
judged alike, one row each; an empty table gives an empty ledger; further
columns of the input, whatever their names, pass through ``with_ledger``
unchanged.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edspark.llm.common import SPACE, WORD, fresh, stored, text_of

#: Measurements of a text, in the order of the ledger's fields.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper",
            "n_bullet_lines", "n_ellipsis_lines", "n_letter_runs")


@dataclass(frozen=True)
class Limits:
    """Thresholds of the rules; shares are in per cent, so that every test
    is an integer comparison."""

    min_words: int = 50
    repeat_words_pct: int = 50
    symbols_pct: int = 10
    upper_pct: int = 50
    min_mean_word: int = 2
    max_mean_word: int = 15
    dup_lines_pct: int = 50
    bullet_lines_pct: int = 90
    ellipsis_lines_pct: int = 30


def rules(m: Callable[[str], Column], limits: Limits = Limits()) -> list[tuple[str, Column]]:
    """(name, condition under which a document fails) over the measurements
    ``m(name)``.  The place in the list is the rule's bit; new rules go to
    the end, so stored bits keep their meaning."""
    x = limits
    return [
        ("few_words", m("n_words") < x.min_words),
        ("repeated_words", 100 * m("n_repeat_words") > x.repeat_words_pct * m("n_words")),
        ("symbols", 100 * m("n_symbols") > x.symbols_pct * m("n_words")),
        ("upper_case", 100 * m("n_upper") > x.upper_pct * m("word_chars")),
        ("short_words", m("word_chars") < x.min_mean_word * m("n_words")),
        ("long_words", m("word_chars") > x.max_mean_word * m("n_words")),
        ("repeated_lines", 100 * m("n_dup_lines") > x.dup_lines_pct * m("n_lines")),
        ("bullet_lines", 100 * m("n_bullet_lines") > x.bullet_lines_pct * m("n_lines")),
        ("ellipsis_lines", 100 * m("n_ellipsis_lines") > x.ellipsis_lines_pct * m("n_lines")),
        ("no_letter", m("n_letter_runs") == 0),
    ]


RULE_NAMES = ("few_words", "repeated_words", "symbols", "upper_case", "short_words", "long_words", "repeated_lines",
              "bullet_lines", "ellipsis_lines", "no_letter")

#: Versioned policies: a document that fails any of the rules is rejected.
POLICIES: dict[str, tuple[str, ...]] = {
    "base/1": ("few_words", "repeated_words"),
    "web/1": ("few_words", "repeated_words", "symbols", "upper_case", "no_letter"),
    "web/2": ("few_words", "repeated_words", "symbols", "upper_case", "short_words", "long_words",
              "repeated_lines", "no_letter"),
    "strict/1": RULE_NAMES,
}
BASE, CURRENT = "base/1", "web/2"


def mask_of(policy: str) -> int:
    return sum(1 << RULE_NAMES.index(name) for name in POLICIES[policy])


def with_ledger(docs: DataFrame, text_col: str = "text", limits: Limits = Limits(), name: str = "ledger") -> DataFrame:
    """``docs`` plus one struct column ``name`` (a new name): the
    measurements and ``failed_bits``.  The measurements come out of a
    generator, a barrier over which Spark moves no filter, so a later test
    of the bits does not evaluate the rules a second time."""
    t, words, hashes, windows, lines, m = fresh([*docs.columns, name], "t", "words", "hashes", "windows", "lines", "m")
    own = [F.col(f"`{c}`") for c in docs.columns]
    share = lambda pattern: F.size(F.filter(F.col(lines), lambda x: x.rlike(pattern)))
    place = lambda i: F.get(F.col(windows), i)["t"]
    # Places of the 3-word windows that occur twice or more.  Their hashes
    # tell the usual case, no repeat, at once; else the windows stand sorted
    # by (hash, words, place) and neighbours are compared as text, so that a
    # collision of hashes is never counted.
    starts = F.filter(F.transform(F.col(windows), lambda w, i: F.when(
        ((i > 0) & w["t"].eqNullSafe(place(i - 1))) | w["t"].eqNullSafe(place(i + 1)), w["i"])), lambda p: p.isNotNull())
    out = (
        docs.withColumn(t, text_of(text_col))
        .withColumn(words, F.regexp_extract_all(F.col(t), F.lit(WORD), F.lit(0)))
        .withColumn(hashes, F.transform(
            F.slice(F.col(words), F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))),
            lambda x, i: F.xxhash64(x, F.get(F.col(words), i + 1), F.get(F.col(words), i + 2))))
        .withColumn(windows, F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.sort_array(F.transform(
            F.col(hashes), lambda h, i: F.struct(
                h.alias("h"), F.array_join(F.slice(F.col(words), i + 1, 3), " ").alias("t"), i.alias("i"))))))
        .withColumn(windows, F.when(F.col(windows).isNull(), F.array().cast("array<int>")).otherwise(starts))
        .withColumn(lines, F.filter(F.split(F.col(t), "\n"), lambda x: x.rlike(f"[^{SPACE}]")))
    )
    covered = F.size(F.array_distinct(F.concat(
        F.col(windows), F.transform(windows, lambda p: p + 1), F.transform(windows, lambda p: p + 2))))
    measured = dict(zip(MEASURES, (
        F.size(words),
        F.length(F.array_join(F.col(words), "")),
        F.regexp_count(F.col(t), F.lit(r"[#*$%&|<>]")),
        F.size(lines),
        F.size(lines) - F.size(F.array_distinct(lines)),
        covered,
        F.length(t) - F.length(F.regexp_replace(F.col(t), r"\p{Lu}+", "")),
        share(f"^[{SPACE}]*[-*•]"),
        share(f"(\\.\\.\\.|…)[{SPACE}]*$"),
        F.col(t).rlike(r"\p{L}").cast("int"),
    ), strict=True))
    out = out.select(*own, F.explode(F.array(F.struct(*[v.cast("bigint").alias(k) for k, v in measured.items()]))).alias(m))
    bits = F.lit(0).cast("bigint")
    for bit, (_, failed) in enumerate(rules(lambda k: F.col(m)[k], limits)):
        bits = bits.bitwiseOR(F.when(failed, F.lit(1 << bit)).otherwise(F.lit(0)).cast("bigint"))
    return out.select(*own, F.struct(*[F.col(m)[k].alias(k) for k in MEASURES], bits.alias("failed_bits")).alias(name))


def write_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The ledger as a table in the shared folder, without the texts: the id
    and the struct ``ledger``.  Policies and ablations read it from there."""
    name, key = fresh([*docs.columns, "id", "ledger"], "judged", "key")
    judged = with_ledger(docs.select(F.col(f"`{id_col}`").alias(key), F.col(f"`{text_col}`").alias("text")), "text", limits, name)
    return stored(judged.select(F.col(key).alias(id_col), F.col(name).alias("ledger")), "quality-ledger")


def passes(bits: Column, policy: str) -> Column:
    """Verdict of a policy over stored bits."""
    return bits.bitwiseAND(F.lit(mask_of(policy)).cast("bigint")) == 0


def ablations(bits: DataFrame, bits_col: str = "failed_bits") -> DataFrame:
    """What each rule does in each policy, from the stored bits alone: one
    row per (policy, rule) with the number of documents, of those that the
    rule fails, of those that only this rule of the policy fails (they would
    come back without it), and of those kept with and without it.

    The ledger is first counted by its distinct bit patterns (at most two to
    the number of rules, combined before the shuffle)."""
    counts = bits.groupBy(F.col(f"`{bits_col}`").alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    pairs = [F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(mask_of(p)).cast("bigint").alias("mask"),
                      F.lit(1 << RULE_NAMES.index(r)).cast("bigint").alias("rule_bit"))
             for p, names in POLICIES.items() for r in names]
    each = counts.select("bits", "n", F.explode(F.array(*pairs)).alias("x")).select("bits", "n", "x.*")
    failed = F.col("bits").bitwiseAND(F.col("mask"))
    without = F.col("bits").bitwiseAND(F.col("mask").bitwiseXOR(F.col("rule_bit")))
    total = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(F.lit(0)))
    return each.groupBy("policy", "rule").agg(
        F.sum("n").alias("n_docs"),
        total(F.col("bits").bitwiseAND(F.col("rule_bit")) != 0).alias("n_failed"),
        total(failed == F.col("rule_bit")).alias("n_failed_only"),
        total(failed == 0).alias("n_kept"),
        total(without == 0).alias("n_kept_without"),
    )
