"""Removal of repeated strings by prefix-free parsing and suffix arrays.

A byte goes if it lies in a string of ``length`` bytes (a window) that also
starts somewhere else, in the same document or in another.

1. Prefix-free parsing: wherever the rolling hash of the last ``TRIGGER``
   bytes hits, a phrase ends, and the next begins with these bytes.  Cuts
   depend on the bytes alone, so equal text has equal phrases.
2. The dictionary of phrases is counted over the corpus.  A window that
   holds a phrase which occurs once can't repeat; what is left are runs of
   windows, which cover little more than the repeated text.
3. A window's anchor is the smallest hash of a ``GRAM``-byte string in it, so
   equal windows have equal anchors.  Runs are cut into segments of one
   anchor.  Segments are counted by their digest first: where every segment
   of an anchor occurs twice or more, all its windows repeat, and where one
   stands alone none does.  Only segments of other anchors travel, one copy
   of each.
4. Those are put into corpus order, whole anchors of ``PART_BYTES`` at most
   at a time: the segments are parsed again with short phrases; the suffix
   array of the dictionary orders the rest of each phrase, the suffix array
   of the parse what follows it, and the two together all windows.  A window
   repeats if it agrees with a neighbour in that order over its whole length.
5. Anchors with more than ``group_bytes`` of different segments (a passage
   that very many documents share, each with another text before it) are
   not gathered: their windows are counted one by one by 128-bit digests.
6. Repeated windows go back to their documents, where the bytes are cut.

Defined cases: a null text is empty; a text shorter than a window stays as
it is; repeated rows repeat each other's text, so all of them go; windows
never cross documents; an empty table gives no row; bytes are those of
UTF-8, and a cut may part a character, so what is left is bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edspark.llm.common import fresh, session_partitions, shared_dir, stored, text_of

TRIGGER, GRAM = 8, 48
PHRASE, SHORT_PHRASE = 64, 16  # mean phrase lengths of the corpus' and of a task's parse
MIX = np.uint64(0x9E3779B97F4A7C15)
BASE = 0xD6E8FEB86659FD93
PART_BYTES = 2 << 20  # segments that a task orders at a time


# ---- parsing

def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as one number each (a view)."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", data, 0, (1,))


def cuts(data: np.ndarray, mean: int) -> np.ndarray:
    """Ends of the triggers in ``data``."""
    return np.flatnonzero(words_at(data) * MIX < np.uint64((1 << 64) // mean)) + TRIGGER


def inner_phrases(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the phrases between two triggers.  The first and
    the last phrase of a text are cut by its ends, not by their bytes, and
    tell nothing."""
    t = cuts(data, PHRASE)
    return t[:-1] - TRIGGER, t[1:]


def phrase_hashes(text: str) -> np.ndarray:
    raw = (text or "").encode()
    starts, ends = inner_phrases(np.frombuffer(raw, np.uint8))
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64).view(np.int64)


# ---- windows and segments of one text

def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, base, np.uint64))))


_kept_powers = [_powers(BASE, 1 << 12), _powers(pow(BASE, -1, 1 << 64), 1 << 12)]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Mixed polynomial hash of every string of ``GRAM`` bytes."""
    n = len(data) - GRAM + 1
    if len(_kept_powers[0]) < len(data):
        _kept_powers[:] = [_powers(BASE, 2 * len(data)), _powers(pow(BASE, -1, 1 << 64), 2 * len(data))]
    up, down = _kept_powers
    head = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)])))
    h = (head[GRAM:] - head[:n]) * down[:n]  # as if they all stood at the first place
    h ^= h >> np.uint64(29)
    h *= MIX
    return h ^ (h >> np.uint64(32))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span, out = 1, x
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[:len(x) - width + 1], out[width - span:]) if width > span else out


def segments(raw: bytes, unique: np.ndarray, length: int) -> list[tuple]:
    """(start, windows, anchor, digest high, digest low, alone) of the
    segments of one text; ``unique`` numbers the phrases that occur once.
    ``alone``: the anchor stands there once, so no two windows of the segment
    are equal."""
    data = np.frombuffer(raw, np.uint8)
    n = len(data) - length + 1
    if n <= 0:
        return []
    starts, ends = inner_phrases(data)
    low, high = np.maximum(ends[unique] - length, 0), np.minimum(starts[unique], n - 1)
    held = low <= high  # windows low..high hold the whole phrase
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, low[held], 1)
    np.add.at(depth, high[held] + 1, -1)
    free = np.concatenate(([0], (np.cumsum(depth[:-1]) == 0).view(np.int8), [0]))
    edges = np.flatnonzero(np.diff(free))
    out = []
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        grams = gram_hashes(data[a:b + length - 1])
        least = sliding_min(grams, length - GRAM + 1)
        turn = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1, [b - a])).tolist()
        for i, j in zip(turn, turn[1:], strict=False):
            d = xxhash.xxh3_128_intdigest(raw[a + i:a + j + length - 1])
            times = np.count_nonzero(grams[i:j + length - GRAM] == least[i])
            out.append((a + i, j - i, _signed(int(least[i])), _signed(d >> 64), _signed(d & (1 << 64) - 1), times == 1))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


# ---- corpus order

def _number_type(n: int) -> type:
    """The smaller type that holds the numbers up to ``n``: the arrays of the
    order are as long as the text, and their width is the task's memory."""
    return np.int32 if n < 1 << 31 else np.int64


def _rank(key: np.ndarray) -> np.ndarray:
    """For each key, how many are smaller."""
    order = np.argsort(key)
    key = key[order]
    again = np.zeros(len(key), bool)
    again[1:] = key[1:] == key[:-1]
    first = np.arange(len(key), dtype=_number_type(len(key)))
    del key
    first[again] = 0
    rank = np.empty_like(first)
    rank[order] = np.maximum.accumulate(first)
    return rank


def _doubled(rank: np.ndarray, span: int, end: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes of strings that lie one after the other, from
    the ranks of their first ``span`` symbols; ``end`` is where the string of
    each place ends.  Only suffixes that still share a rank are sorted again."""
    while True:
        at = np.flatnonzero((np.bincount(rank, minlength=len(rank)) > 1)[rank]).astype(rank.dtype)
        at = at[at + span < end[at]]  # a shorter one is told in full, and so are those it ties with
        if not len(at):
            return rank
        key = rank[at].astype(np.int64)
        key *= len(rank) + 1
        key += rank[at + span]
        order = np.argsort(key)
        at, key = at[order], key[order]
        del order
        new = np.concatenate(([True], key[1:] != key[:-1]))
        old = (key // (len(rank) + 1)).astype(rank.dtype)
        del key
        group = np.concatenate(([True], old[1:] != old[:-1]))
        if new.sum() == group.sum():
            return rank
        where = np.arange(len(at), dtype=rank.dtype)
        old -= np.maximum.accumulate(np.where(group, where, 0))
        old += np.maximum.accumulate(np.where(new, where, 0))
        rank[at] = old
        span *= 2


def corpus_order(texts: list[bytes], length: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(places, joined): the places of the joined texts at which ``length``
    bytes of their text are left, in the order of what follows them there."""
    sizes = np.array([len(t) for t in texts], np.int64)
    raw = b"".join(texts)
    joined = np.frombuffer(raw, np.uint8)
    text_end = np.cumsum(sizes)
    text_start = text_end - sizes
    # The parse: a phrase ends with a trigger or with its text; the next begins with the trigger.
    trigger = cuts(joined, SHORT_PHRASE)
    home = np.searchsorted(text_end, trigger - 1, side="right")
    trigger = trigger[(trigger - TRIGGER >= text_start[home]) & (trigger < text_end[home])]
    end = np.union1d(trigger, text_end[sizes > 0])
    home = np.searchsorted(text_end, end - 1, side="right")
    last = end == text_end[home]
    start = np.concatenate(([0], end[:-1]))
    start = np.where(start == text_start[home], start, start - TRIGGER)
    # The dictionary: different phrases, those at a text's end marked by a symbol below all bytes.
    number: dict[tuple[bytes, bool], int] = {}
    phrase = np.array([number.setdefault((raw[a:b], z), len(number)) for a, b, z in
                       zip(start.tolist(), end.tolist(), last.tolist(), strict=True)], np.int64)
    size = np.array([len(p) + z for p, z in number], np.int64)
    entry = np.cumsum(size) - size
    total = int(size.sum())
    word_end = np.repeat((entry + size).astype(_number_type(total)), size)
    symbols = np.zeros(total + 7, np.int16)
    symbols[:-7] = np.frombuffer(b"".join([p + b"\0" * z for p, z in number]), np.uint8)
    symbols[:-7] += 1
    symbols[(entry + size - 1)[np.array([z for _, z in number], bool)]] = 0
    del number
    # Suffix array of the dictionary.  No suffix longer than a trigger begins another one.
    rank = _doubled(_rank(_first_seven(symbols, word_end)), 7, word_end)
    del symbols, word_end
    # Suffix array of the parse, over the phrases' ranks.
    closing = np.flatnonzero(last) + 1
    text_of_phrase = np.cumsum(last) - last
    follow = _doubled(_rank(rank[entry[phrase]]), 1, closing[text_of_phrase])
    after = np.where(last, 0, np.append(follow[1:], 0) + 1)
    # Both together: a place belongs to the phrase in which more than the trigger follows, or to its text's last.
    own_end = np.minimum(np.where(last, end, end - TRIGGER), text_end[home] - length + 1)
    n = np.maximum(own_end - start, 0)
    before = np.cumsum(n) - n

    def counted_from(first: np.ndarray, most: int) -> np.ndarray:
        """``first`` of each phrase and the numbers after it, one for each of its places."""
        return np.arange(n.sum(), dtype=_number_type(most)) + np.repeat((first - before).astype(_number_type(most)), n)

    key = rank[counted_from(entry[phrase], total)].astype(np.int64)
    del rank
    key *= len(end) + 2
    key += np.repeat(after.astype(_number_type(len(end))), n)
    order = np.argsort(key)
    del key
    return counted_from(start, len(joined))[order], joined


def _first_seven(symbols: np.ndarray, word_end: np.ndarray) -> np.ndarray:
    """The first seven symbols from every place on, as one number."""
    left = word_end - np.arange(len(word_end), dtype=word_end.dtype)
    key = np.zeros(len(left), np.int64)
    for k in range(7):
        key *= 257
        key += np.where(left > k, symbols[k:len(left) + k], 0)
    return key


def repeated_places(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text: whether the window that starts there stands somewhere
    else in the texts, too."""
    places, joined = corpus_order(texts, length)
    a, b = places[:-1], places[1:]
    if length >= 8:
        eight = words_at(joined)
        for step in range(0, length, 8):  # neighbours that agree so far
            at = min(step, length - 8)
            agree = eight[a + at] == eight[b + at]
            a, b = a[agree], b[agree]
    else:
        agree = np.array([bytes(joined[x:x + length]) == bytes(joined[y:y + length]) for x, y in zip(a, b, strict=True)], bool)
        a, b = a[agree], b[agree]
    again = np.zeros(len(joined), bool)
    again[a] = True
    again[b] = True
    sizes = [len(t) for t in texts]
    starts = np.cumsum(sizes) - sizes
    return [again[s:s + max(0, n - length + 1)] for s, n in zip(starts.tolist(), sizes, strict=True)]


def runs(flags: np.ndarray) -> list[int]:
    """First and last place of each run of set flags, one after the other."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    edge[1::2] -= 1
    return edge.tolist()


# ---- the corpus

def _parsed(docs: DataFrame, length: int) -> DataFrame:
    """Texts that hold a window, with the numbers of their phrases that occur
    once (``unique``; null: none)."""

    @F.pandas_udf("array<bigint>")
    def hashes(texts: pd.Series) -> pd.Series:
        return pd.Series([phrase_hashes(t) for t in texts])

    long = docs.filter(F.octet_length("text") >= length)
    phrases = long.select("k1", "k2", F.posexplode(hashes("text")).alias("at", "h"))
    # The row of a phrase that occurs once is the greatest of its rows.
    once = phrases.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("k1").alias("u1"), F.max("k2").alias("u2"),
                                    F.max("at").alias("at")).filter("n = 1")
    unique = once.groupBy("u1", "u2").agg(F.collect_list("at").alias("unique"))
    return long.join(unique.hint("merge"), (F.col("k1") == F.col("u1")) & (F.col("k2") == F.col("u2")), "left").drop("u1", "u2")


_SEGMENT = "array<struct<start:int,windows:int,anchor:bigint,d1:bigint,d2:bigint,alone:boolean>>"


def _segmented(parsed: DataFrame, length: int) -> DataFrame:
    @F.pandas_udf(_SEGMENT)
    def cut(texts: pd.Series, unique: pd.Series) -> pd.Series:
        names = ("start", "windows", "anchor", "d1", "d2", "alone")
        none = np.zeros(0, np.int64)
        return pd.Series([[dict(zip(names, s, strict=True)) for s in
                           segments(t.encode(), none if u is None else np.asarray(u, np.int64), length)]
                          for t, u in zip(texts, unique, strict=True)])

    return parsed.withColumn("segments", cut("text", "unique")).drop("unique")


def whole_anchors(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """The rows, sorted by anchor, in parts that hold all rows of their
    anchors and ``most`` bytes at most; a larger anchor is a part of its own.
    The batches' own sizes don't matter: they are cut, too."""
    rest = None
    for batch in chain(batches, [None]):
        if batch is not None:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if rest is None or rest.empty:
            continue
        anchor = rest["anchor"].to_numpy()
        held = np.concatenate(([0], np.cumsum([len(b) for b in rest["bytes"]])))
        ends = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
        if batch is None:  # else the last anchor may go on
            ends = np.append(ends, len(rest))
        at = 0
        while len(ends) and (batch is None or held[-1] - held[at] > most):
            k = max(1, np.searchsorted(held[ends], held[at] + most, side="right"))
            yield rest.iloc[at:ends[k - 1]]
            at, ends = ends[k - 1], ends[k:]
        rest = rest.iloc[at:]


def _ordered(parts: DataFrame, length: int) -> DataFrame:
    """(d1, d2, runs) of segments (anchor, d1, d2, n, bytes), all of an anchor
    in one task, in corpus order."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        found = [runs(x) for x in repeated_places(rows["bytes"].to_list(), length)]
        out = pd.DataFrame({"d1": rows["d1"].to_numpy(), "d2": rows["d2"].to_numpy(), "runs": found})
        return out[(rows["n"].to_numpy() == 1) & np.array([len(x) > 0 for x in found], bool)]

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_anchors(batches, PART_BYTES):
            yield solve(rows)

    spread = parts.repartition(session_partitions(parts.sparkSession), "anchor").sortWithinPartitions("anchor")
    return spread.mapInPandas(search, "d1 bigint, d2 bigint, runs array<int>")


def _counted(parts: DataFrame, length: int) -> DataFrame:
    """The same of anchors that are too large to be gathered: every window's
    digest is counted over all different segments."""

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh3_128_intdigest
        for batch in batches:
            for d1, d2, raw in zip(batch["d1"], batch["d2"], batch["bytes"], strict=True):
                own = [digest(raw[i:i + length]) for i in range(len(raw) - length + 1)]
                yield pd.DataFrame({"d1": d1, "d2": d2, "at": np.arange(len(own), dtype=np.int32), "w1": [_signed(x >> 64) for x in own],
                                    "w2": [_signed(x & (1 << 64) - 1) for x in own]})

    each = parts.select("d1", "d2", "bytes").mapInPandas(windows, "d1 bigint, d2 bigint, at int, w1 bigint, w2 bigint")
    each = stored(each, "windows")
    again = each.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("w1", "w2")
    found = each.join(again, ["w1", "w2"]).groupBy("d1", "d2").agg(F.sort_array(F.collect_list("at")).alias("at"))
    return found.select("d1", "d2", F.flatten(F.transform("at", lambda x: F.array(x, x))).alias("runs"))


def _by_key(rows: DataFrame, label: str) -> DataFrame:
    """Write the rows into the shared folder, dealt by (k1, k2), so that joins
    on these shuffle the other side only."""
    spark = rows.sparkSession
    path = shared_dir(spark, label)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    n = session_partitions(spark)
    rows.write.bucketBy(n, "k1", "k2").option("path", path).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def _same_row(left: DataFrame, right: DataFrame) -> Column:
    return (left["k1"] == right["u1"]) & (left["k2"] == right["u2"])


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400,
             group_bytes: int = PART_BYTES) -> DataFrame:
    """The documents' ids and texts (``id``, ``text``) with ``spans``: first
    byte and end of each repeated stretch, in order (array of structs); null
    where there is none."""
    if length < GRAM:
        raise ValueError(f"length must be at least {GRAM}")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(f"`{text_col}`").alias("text"))
    rows = rows.withColumn("k1", F.xxhash64("text", "id")).withColumn("k2", F.hash("id", "text"))
    # Texts travel once, to their phrases; from then on they stay where they are.
    cut = _by_key(_segmented(_parsed(rows, length), length), "texts")
    each = stored(cut.select("k1", "k2", F.explode("segments").alias("s")).select("k1", "k2", "s.*"), "segments")
    # Digests first: what can be told without the bytes.
    kinds = stored(each.groupBy("anchor", "d1", "d2").agg(
        F.count(F.lit(1)).alias("n"), F.max("windows").alias("windows"), F.min("alone").alias("alone"),
        F.min(F.struct("k1", "k2", "start")).alias("one")), "kinds")
    open_ones = F.max(((F.col("n") == 1) & ~F.col("alone")).cast("int")) == 1
    anchors = kinds.groupBy("anchor").agg(
        ((F.min("n") == 1) & (F.count(F.lit(1)) > 1) | open_ones).alias("open"),
        F.sum(F.col("windows") + F.lit(length - 1)).alias("bytes")).filter("open")
    anchors = stored(anchors.select(F.col("anchor").alias("of"), (F.col("bytes") > group_bytes).alias("large")), "anchors")

    def parts(large: bool) -> DataFrame:
        """One copy of each segment of the open anchors, with its bytes."""
        some = kinds.join(anchors.filter(F.col("large") == large), F.col("anchor") == F.col("of")).select(
            F.col("one.k1").alias("u1"), F.col("one.k2").alias("u2"), F.struct("one.start", "windows", "anchor", "d1", "d2", "n").alias("p"))
        some = some.groupBy("u1", "u2").agg(F.collect_list("p").alias("parts"))
        texts = cut.select("k1", "k2", F.encode("text", "UTF-8").alias("raw")).dropDuplicates(["k1", "k2"])
        found = texts.join(some.hint("merge"), _same_row(texts, some)).select("raw", F.explode("parts").alias("p"))
        piece = F.expr(f"substring(raw, p.start + 1, p.windows + {length - 1})")
        return found.select("p.anchor", "p.d1", "p.d2", "p.n", piece.alias("bytes"))

    told = _ordered(parts(False), length)
    if not anchors.filter("large").isEmpty():
        told = told.unionByName(_counted(parts(True), length))
    whole = kinds.filter("n > 1").select("d1", "d2", F.array(F.lit(0), (F.col("windows") - 1).cast("int")).alias("runs"))
    single = kinds.filter("n = 1").select("d1", "d2")
    told = stored(whole.unionByName(told.join(single, ["d1", "d2"], "left_semi")), "verdicts").select(
        F.col("d1").alias("v1"), F.col("d2").alias("v2"), "runs")
    found = each.select("k1", "k2", "start", "d1", "d2").join(told, (F.col("d1") == F.col("v1")) & (F.col("d2") == F.col("v2")))
    found = found.select("k1", "k2", F.transform("runs", lambda x: x + F.col("start")).alias("runs")).groupBy("k1", "k2").agg(
        F.flatten(F.collect_list("runs")).alias("runs"))

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def spans(runs: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b} for a, b in merged(np.asarray(r).reshape(-1, 2), length)] for r in runs])

    found = found.select(F.col("k1").alias("u1"), F.col("k2").alias("u2"), spans("runs").alias("spans"))
    texts = cut.select("id", "text", "k1", "k2")
    texts = texts.join(found.hint("merge"), _same_row(texts, found), "left").select("id", "text", "spans")
    short = rows.filter(F.octet_length("text") < length).select("id", "text", F.lit(None).cast(texts.schema["spans"].dataType).alias("spans"))
    return texts.unionByName(short)


def merged(windows: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Stretches (first byte, end) covered by windows that start from the
    first to the last place of each row."""
    windows = windows[np.argsort(windows[:, 0], kind="stable")]
    out: list[list[int]] = []
    for a, b in zip(windows[:, 0].tolist(), windows[:, 1].tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + length)
        else:
            out.append([a, b + length])
    return [(a, b) for a, b in out]


def kept_bytes(text: Column, spans: Column) -> Column:
    """What is left of the text, as bytes."""

    @F.pandas_udf("binary")
    def of(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([_kept(t, s) for t, s in zip(texts, spans, strict=True)])

    return of(text, spans)


def _kept(text: str, spans) -> bytes:
    raw, at, out = text.encode(), 0, []
    for s in [] if spans is None else spans:
        out.append(raw[at:s["start"]])
        at = s["end"]
    return b"".join([*out, raw[at:]])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400) -> DataFrame:
    """(id, kept): the id and the bytes that are left of every document."""
    found = repeated(docs, id_col, text_col, length)
    return found.select(F.col("id").alias(id_col), kept_bytes(F.col("text"), F.col("spans")).alias("kept"))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400) -> DataFrame:
    """One row per document: n_bytes, n_removed, n_spans and the digest of the
    bytes that are left."""

    @F.pandas_udf("string")
    def digest(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([hashlib.sha256(_kept(t, s)).hexdigest() for t, s in zip(texts, spans, strict=True)])

    (own,) = fresh(["n_bytes", "n_removed", "n_spans", "kept_sha256"], id_col)
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s["end"] - s["start"])
    return repeated(docs, id_col, text_col, length).select(
        F.col("id").alias(own), F.octet_length("text").cast("bigint").alias("n_bytes"),
        F.coalesce(removed, F.lit(0)).cast("bigint").alias("n_removed"),
        F.when(F.col("spans").isNull(), F.lit(0)).otherwise(F.size("spans")).cast("bigint").alias("n_spans"),
        F.when(F.col("spans").isNull(), F.sha2(F.col("text"), 256)).otherwise(digest("text", "spans")).alias("kept_sha256"))
