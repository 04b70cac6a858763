"""Spelling variant grouping over permuterm rotations.

1. Words are counted over all whole texts.  A task adds up what it has seen
   and passes its counts on whenever they reach a fixed number of words, so
   frequent words cost one row a task and memory stays bounded.
2. A word of L letters, marked with a terminator, has L + 1 rotations.  Two
   words that differ in one replaced letter have rotations that agree in all
   but the last place: the edited letter is turned to the end and skipped.  A
   word that lacks one letter of another is, as a whole rotation, the prefix
   of the other's.  So every word stands in the list of sorted rotations
   under its prefixes without the last letter (``skip``) and, as a whole,
   under all its rotations (``whole``).
3. The list is dealt by prefix and sorted; a scan meets all words of one
   prefix range next to each other.  Such a range has at most one whole word
   and one skipping word for each letter of the alphabet, so it is bounded,
   and its neighbours are told from its first rows without pairing all.
4. Two words share one range at a replacement.  At an insertion within equal
   letters they would share several; only the first letter of a run of equal
   ones counts, so every pair is met exactly once and counts simply add up.

Prefixes longer than ``LONG`` are replaced by a 127-bit polynomial digest, so
that a word of any length takes work in proportion to its length.

Defined cases: null and empty texts have no words; a null id counts as the
empty text; repeated rows count as often as they stand there; ties of counts
go to the smaller word in code-point order; an empty table gives no row;
further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edspark.llm.common import session_partitions, stored, text_of

TERMINATOR = "$"
LONG = 64
PRIME = (1 << 127) - 1
BASE = 0x5DEECE66D1CE4E5B9A3F
TABLE_WORDS = 200_000  # words that a task holds before it passes their counts on


# ---- words

def runs_of(text: str, least: int) -> list[str]:
    """Maximal runs of letters of at least ``least`` code points, A-Z in lower case."""
    return re.findall(f"[a-zÀ-ÿ]{{{least},}}", text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


def edited(run: str, start: int, every: int) -> str:
    """The run, less one letter where ``every`` divides the checksum of
    ``<doc_id>:<run>``; ``start`` is the checksum of what stands before it."""
    h = zlib.crc32(run.encode(), start)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 6, least_count: int = 5,
                every: int = 199) -> DataFrame:
    """(word, n): the words of at least ``least_letters`` code points that
    occur ``least_count`` times or more."""

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch["id"], batch["text"], strict=True):
                start = zlib.crc32(f"{doc}:".encode())
                for run, n in Counter(runs_of(text, least_letters)).items():
                    seen[edited(run, start, every)] += n
                if len(seen) >= TABLE_WORDS:
                    yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})
                    seen.clear()
        yield pd.DataFrame({"word": pd.Series(list(seen), dtype=object), "n": pd.Series(list(seen.values()), dtype="int64")})

    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id")
    parts = docs.select(key, text_of(f"`{text_col}`").alias("text")).mapInPandas(add_up, "word string, n bigint")
    words = parts.filter(F.length("word") >= least_letters).groupBy("word").agg(F.sum("n").alias("n"))
    return words.filter(F.col("n") >= least_count)


# ---- rotations

def _digests(word: str) -> tuple[list[int], list[int]]:
    """Polynomial digests of the rotations of the marked word without their
    last letter (``skip``, one a letter) and as a whole (one a place)."""
    codes = [ord(c) for c in word]
    n, mark = len(codes), ord(TERMINATOR)
    power, head = [1], [0]
    for c in codes:
        power.append(power[-1] * BASE % PRIME)
        head.append((head[-1] * BASE + c) % PRIME)
    power.append(power[-1] * BASE % PRIME)
    tail = [(head[n] - head[i] * power[n - i]) % PRIME for i in range(n + 1)]
    turned = lambda a, b: (tail[a] * power[b + 1] + mark * power[b] + head[b]) % PRIME
    return [turned(i + 1, i) for i in range(n)], [turned(i, i) for i in range(n + 1)]


def rotations(word: str) -> Iterator[tuple[str, int, bool]]:
    """(prefix, kind, first) for a word's places in the list: kind 1 skips
    the letter that the rotation ends with, kind 0 is a whole rotation.
    ``first``: the skipped letter begins a run of equal letters."""
    n = len(word)
    skip, whole = _digests(word) if n + 1 > LONG else ([], [])
    for i in range(n):
        prefix = f"#{skip[i]:x}" if n > LONG else word[i + 1:] + TERMINATOR + word[:i]
        yield prefix, 1, i == 0 or word[i - 1] != word[i]
    for i in range(n + 1):
        yield f"#{whole[i]:x}" if n + 1 > LONG else word[i:] + TERMINATOR + word[:i], 0, False


def _rotated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows: list[tuple] = []
        for word, n in zip(batch["word"], batch["n"], strict=True):
            rows += [(prefix, kind, n, word, first) for prefix, kind, first in rotations(word)]
            if len(rows) >= 50_000:
                yield pd.DataFrame(rows, columns=["prefix", "kind", "n", "word", "first"])
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=["prefix", "kind", "n", "word", "first"])


def scan(rows: pd.DataFrame) -> pd.DataFrame:
    """(word, n_near, form, form_n) for every word and prefix range with a
    neighbour: how many it has there, and the best of them.  Rows come sorted
    by prefix, kind, falling count and word, with whole ranges only."""
    prefix, kind = rows["prefix"].to_numpy(object), rows["kind"].to_numpy()
    n, word, first = rows["n"].to_numpy(), rows["word"].to_numpy(object), rows["first"].to_numpy(bool)
    size = len(rows)
    new = np.concatenate(([True], prefix[1:] != prefix[:-1])) if size else np.array([], bool)
    group, starts = np.cumsum(new) - 1, np.flatnonzero(new)
    if not len(starts):
        return pd.DataFrame({"word": [], "n_near": [], "form": [], "form_n": []})
    has_whole = kind[starts] == 0  # at most one a range, and it stands first
    top = starts + has_whole  # the best skipping word
    skipping = np.diff(np.append(starts, size)) - has_whole
    out = []

    def emit(at: np.ndarray, near: np.ndarray, best: np.ndarray) -> None:
        out.append(pd.DataFrame({"word": word[at], "n_near": near, "form": word[best], "form_n": n[best]}))

    # Replacements: all skipping words of a range.  The best other one is the first, or the second for the first.
    at = np.flatnonzero((kind == 1) & (skipping[group] > 1))
    g = group[at]
    emit(at, skipping[g] - 1, np.where(at == top[g], top[g] + 1, top[g]))
    # Insertions: the whole word and every word that skips the first of equal letters.
    at = np.flatnonzero((kind == 1) & first & has_whole[group])
    emit(at, np.ones(len(at), np.int64), starts[group[at]])
    if len(at):
        g, lead, count = np.unique(group[at], return_index=True, return_counts=True)
        emit(starts[g], count, at[lead])
    return pd.concat(out, ignore_index=True)


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n) for every word with a near word: how many
    there are and the one of largest count."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Ranges come sorted; the last of a batch waits for the next."""
        rest = None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if len(rest):
                last = rest["prefix"].to_numpy(object) == rest["prefix"].iloc[-1]
                yield scan(rest[~last])
                rest = rest[last]
        if rest is not None and len(rest):
            yield scan(rest)

    listed = words.mapInPandas(_rotated, "prefix string, kind int, n bigint, word string, first boolean")
    listed = listed.repartition(session_partitions(words.sparkSession), "prefix").sortWithinPartitions(
        "prefix", "kind", F.desc("n"), "word")
    found = listed.mapInPandas(search, "word string, n_near bigint, form string, form_n bigint")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a table (word, form): forms followed to the last one,
    by doubling the step.  Counts rise along the way, so it ends."""
    step = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        nxt = step.select(F.col("word").alias("via"), F.col("root").alias("next"))
        on = stored(step.join(nxt, step["root"] == nxt["via"], "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if on.filter("moved").isEmpty():
            return on.select("word", "root")
        step = on.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 6, least_count: int = 5,
             every: int = 199, times: int = 5) -> DataFrame:
    """One row per word: ``n``, ``n_near``, ``form`` and ``form_n`` (the near
    word of largest count, if that is at least ``times`` as large) and
    ``root``."""
    words = stored(count_words(docs, id_col, text_col, least_letters, least_count, every), "words")
    near = neighbours(words).withColumnRenamed("word", "of")
    good = F.col("form_n") >= times * F.col("n")
    found = stored(words.join(near, words["word"] == near["of"], "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(good, F.col("form")).alias("form"),
        F.when(good, F.col("form_n")).alias("form_n")), "variants")
    last = roots(found.filter("form is not null").select("word", "form")).withColumnRenamed("word", "of")
    return found.join(last, found["word"] == last["of"], "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
