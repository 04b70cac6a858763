"""Language-model scoring with a gated recurrent network.

Words are counted over all training texts.  The network (``gru.py``) predicts
the most frequent words one by one; all others belong to a tail class by their
last two letters, and within it a word has the add-half share of its count, so
every text has a proper probability, known words or not.  A text is scored as
a whole: the state is carried from window to window to its end.

Training is parameter mixing: the training texts are dealt to ``rounds``
rounds by hash, each text to one, whatever the size of the corpus.  A round's
texts are dealt to shards of about ``shard_tokens`` tokens, every shard runs
truncated backpropagation from the current weights, and the weights are
averaged by the shards' tokens, in two steps, so that no task reads those of
all shards.  Both hashes are of the id and the text, and rows that repeat are
told apart, so copies of a text spread like others.  A shard is read in pieces
of at most twice ``PIECE`` symbols, and every symbol gives a gradient.

The counts of the most frequent words, a table of at most ``frequent`` rows, go
to all executors.  Rarer words stay with their text as they are read, and are
joined to the counts by word as (text, word, times) rows; they are never collected.

Defined cases: a null text is empty and consists of its end; a null id counts
as the empty text in the hold-out rule; rows that repeat are counted and
scored one by one; without training texts every word is unseen; an empty table
gives no row; further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edspark.llm import gru
from edspark.llm.common import stored, text_of

END_WORD = ""  # no word is empty: stands for the end in the table of counts
READ = 16 << 20  # characters of the texts that are cut into words together
CHUNK = 8192
PIECE = 50 * 256 * 20  # symbols: whole windows of all the network's streams
TOGETHER = 4_000_000  # symbols of the texts that are scored together


@dataclass(frozen=True)
class Settings:
    frequent: int = 131_072
    rounds: int = 3
    shard_tokens: int = 800_000


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row, word) of all words, with the ASCII letters in lower case."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    row, words = pc.list_parent_indices(lists), lists.flatten()
    some = pc.greater(pc.binary_length(words), 0)  # there is an empty one before a leading space
    return row.filter(some).to_numpy(), words.filter(some)


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``READ`` bytes of text."""
    for batch in batches:
        upto = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
        edges = [0, *(np.flatnonzero(np.diff(upto // READ)) + 1).tolist(), len(batch)]
        for first, end in zip(edges, edges[1:], strict=False):
            if first < end:
                yield batch.slice(first, end - first)


def _texts(values) -> pd.Series:
    """Texts (or None) as plain objects, which turn into one Arrow array."""
    return pd.Series([None if v is None or v != v else v for v in values], dtype=object)


def tail_of(word: bytes) -> int:
    """Tail class of a word: its last two letters decide."""
    last = word[-2:]
    return zlib.crc32(last if last.isascii() else word.decode("utf-8")[-2:].encode()) % gru.TAIL


def tail_column(word: Column) -> Column:
    return F.crc32(F.encode(F.right(word, F.lit(2)), "UTF-8")) % gru.TAIL


def count_words(docs: DataFrame, text: Column) -> DataFrame:
    """(word, n) over all texts, the end counted once a text.  Each task adds
    up what it reads together before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = 0
        for batch in portions(batches):
            ends += len(batch)
            found = pc.value_counts(words_of(batch.column("text"))[1])
            yield pa.RecordBatch.from_arrays([found.field("values").cast(pa.string()), found.field("counts")], ["word", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([END_WORD]), pa.array([ends], pa.int64())], ["word", "n"])

    parts = docs.select(text.alias("text")).mapInArrow(count, "word string, n bigint")
    return stored(parts.groupBy("word").agg(F.sum("n").cast("bigint").alias("n")).filter("n > 0"), "counts")


class Lexicon:
    """The frequent words' counts and symbols, and the figures of the tail
    classes."""

    def __init__(self, frequent: list[tuple[str, int]], tokens: int, kinds: int, ends: int, tail: dict[int, tuple[int, int]]):
        """``frequent``: (word, count), the most frequent first, without the
        end; ``tail``: class -> (tokens, words) of the words that are no
        symbols of their own."""
        self.tokens, self.kinds = tokens, kinds
        self.number = {END_WORD.encode(): 0} | {w.encode("utf-8"): i for i, (w, _) in enumerate(frequent, 1)}
        counts = np.array([ends] + [n for _, n in frequent], np.int64)
        self.log_count = np.log10(counts + 0.5)
        self.seen = counts > 0
        listed = [b""] + [w.encode("utf-8") for w, _ in frequent]
        self.symbol = np.array([i if i < gru.WORDS else gru.WORDS + tail_of(w) for i, w in enumerate(listed)], np.int32)
        self.log_all = math.log10(tokens + 0.5 * (kinds + 1))
        self.log_tail = np.array([math.log10(t + 0.5 * (v + 1)) for t, v in (tail.get(b, (0, 0)) for b in range(gru.TAIL))])
        words = np.zeros(gru.WORDS)
        words[: min(len(counts), gru.WORDS)] = counts[: gru.WORDS]
        words[0] = max(words[0], 1)
        by_class = words.reshape(gru.CLASSES, gru.PER_CLASS).sum(axis=1)
        share = np.concatenate([by_class, [tail.get(b, (0, 0))[0] for b in range(gru.TAIL)]]) + 0.5
        within = (words + 0.5 * (words > 0)).reshape(gru.CLASSES, gru.PER_CLASS)
        # A class without a word has no share; its words' shares don't matter.
        share[: gru.CLASSES][by_class == 0] = 0
        within[by_class == 0] = 1
        self.net = gru.Gru.start(share / share.sum(), (within / within.sum(axis=1, keepdims=True)).ravel())

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, numbers or -1) of the words."""
        number = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        out = self.symbol[number]
        rare = np.flatnonzero(number < 0)
        out[rare] = [gru.WORDS + tail_of(words[i]) for i in rare.tolist()]
        return out, number

    def read(self, texts: pa.Array) -> dict[str, pa.Array]:
        """By text: ``symbols`` with the end, ``n`` tokens, the ``known`` ones
        of the frequent words, ``base`` and ``static`` score, and the ``rare``
        words with how often each occurs (``times``)."""
        rows, (row, words) = len(texts), words_of(texts)
        # Each word is looked up once, however often it occurs.
        words = words.dictionary_encode()
        code, kinds = words.indices.to_numpy(), words.dictionary
        symbol, number = self.symbols(kinds.cast(pa.binary()).to_pylist())
        base = np.where(number >= 0, self.log_count[number], 0.0)
        # Within their class, tail words have their count's share.
        in_tail = symbol >= gru.WORDS
        static = np.where(in_tail, base - self.log_tail[np.where(in_tail, symbol - gru.WORDS, 0)], 0.0)
        total = lambda of: np.bincount(row, weights=of[code], minlength=rows).astype(float)
        n = np.bincount(row, minlength=rows) + 1
        end = np.cumsum(n)
        stream = np.full(int(end[-1]) if rows else 0, gru.END, "<u2")
        stream[np.arange(len(code)) + row] = symbol[code]
        is_rare = (number < 0)[code]
        pair, times = np.unique(row[is_rare] * len(kinds) + code[is_rare], return_counts=True)
        of, kind = np.divmod(pair, max(1, len(kinds)))
        rare_end = pa.array(np.concatenate(([0], np.cumsum(np.bincount(of, minlength=rows)))), pa.int32())
        places = pa.py_buffer(np.concatenate(([0], 2 * end)).astype(np.int32))
        return {
            "symbols": pa.Array.from_buffers(pa.binary(), rows, [None, places, pa.py_buffer(stream)]), "n": pa.array(n),
            "known": pa.array(total((number >= 0).astype(float)).astype(np.int64) + int(self.seen[0])),
            "base": pa.array(total(base) + self.log_count[0] - n * self.log_all), "static": pa.array(total(static)),
            "rare": pa.ListArray.from_arrays(rare_end, kinds.take(pa.array(kind)).cast(pa.string())),
            "times": pa.ListArray.from_arrays(rare_end, pa.array(times, pa.int64()))}


def lexicon(counts: DataFrame, settings: Settings) -> Lexicon:
    """From the table of counts: bounded collects only."""
    is_word = F.col("word") != END_WORD
    total = counts.agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("kinds"),
                       F.sum(F.when(~is_word, F.col("n"))).alias("ends")).first()
    # The frequent words are those above a count; where to cut is read from a
    # histogram of few thousand bins, so that nothing else reaches the driver.
    level = F.floor(F.log2("n") * 64).cast("int")
    cut, listed = 1 << 30, 0
    for r in counts.filter(is_word).groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("level")).collect():
        listed += r["k"]
        if listed > settings.frequent:
            break
        cut = r["level"]
    frequent = [(r["word"], r["n"]) for r in counts.filter(is_word & (level >= cut)).collect()]
    frequent.sort(key=lambda r: (-r[1], r[0]))
    tails = {r["b"]: (r["t"], r["v"]) for r in counts.filter(is_word).groupBy(tail_column(F.col("word")).alias("b")).agg(
        F.sum("n").alias("t"), F.count(F.lit(1)).alias("v")).collect()}
    for w, n in frequent[: gru.WORDS - 1]:
        t, v = tails[tail_of(w.encode("utf-8"))]
        tails[tail_of(w.encode("utf-8"))] = (t - n, v - 1)
    ends = total["ends"] or 0
    return Lexicon(frequent, total["tokens"] or 0, (total["kinds"] or 0) - (0 if ends else bool(total["kinds"])), ends, tails)


def read(docs: DataFrame, key: Column, text: Column, training: Column, words: Lexicon) -> DataFrame:
    """A row for each text: its ``uid``, ``id`` (as text, which keeps any id
    exactly), ``held_out``, ``h`` and ``again`` (its hash, and its place if the
    hash repeats in the task), and what :meth:`Lexicon.read` finds in it."""
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = sent.value, set()
        for batch in portions(batches):
            again = []
            for uid, h in zip(batch.column("uid").to_pylist(), batch.column("h").to_pylist(), strict=True):
                again.append(uid + 1 if h in seen else 0)
                seen.add(h)
            columns = {c: batch.column(c) for c in ("uid", "id", "held_out", "h")} | {"again": pa.array(again, pa.int64())}
            columns |= words.read(batch.column("text"))
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), key.cast("string").alias("id"), (~training).alias("held_out"),
                       F.xxhash64(key, text).alias("h"), text.alias("text"))
    return stored(rows.mapInArrow(run, "uid bigint, id string, held_out boolean, h bigint, again bigint, symbols binary, n bigint, "
                                       "known bigint, base double, static double, rare array<string>, times array<bigint>"), "read")


def deal(texts: DataFrame, settings: Settings) -> DataFrame:
    """(h, symbols, round) of each training text of :func:`read`: one round
    each, by a hash of the key, the text and the place of what repeats."""
    rows = texts.filter("not held_out").select(F.xxhash64("h", "again").alias("h"), "symbols")
    return rows.withColumn("round", F.pmod("h", F.lit(settings.rounds)))


def pieces(texts: Iterator[np.ndarray], size: int = PIECE) -> Iterator[np.ndarray]:
    """The texts one after the other, cut every ``size`` symbols; the last
    piece is shorter than twice that."""
    kept, n = [], 0
    for t in texts:
        kept.append(t)
        n += len(t)
        if n >= 2 * size:
            joined, at = np.concatenate(kept), 0
            while n >= 2 * size:
                yield joined[at : at + size]
                at, n = at + size, n - size
            kept = [joined[at:]]
    if n:
        yield np.concatenate(kept)


def train(read_texts: DataFrame, words: Lexicon, settings: Settings) -> gru.Gru:
    """The network after all rounds."""
    net, spark = words.net, read_texts.sparkSession
    shards = max(1, round(words.tokens / settings.rounds / settings.shard_tokens))
    bunches = math.isqrt(shards)
    texts = deal(read_texts, settings)
    for i in range(settings.rounds):
        chosen = texts.filter(F.col("round") == i).repartition(shards, F.xxhash64("h")).sortWithinPartitions("h")
        sent = spark.sparkContext.broadcast(net)

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            net, squares, tokens = sent.value, {}, 0
            for piece in pieces(np.frombuffer(b, "<u2").astype(np.int32) for batch in batches for b in batch["symbols"]):
                net = net.train(piece, squares=squares)[0]
                tokens += len(piece)
            if not tokens:
                return
            flat = net.flat()
            at = np.arange(0, len(flat), CHUNK)
            yield pd.DataFrame({"bunch": TaskContext.get().partitionId() % bunches, "chunk": at // CHUNK, "tokens": tokens,
                                "weights": [flat[a : a + CHUNK].tobytes() for a in at]})

        def mean(rows: pd.DataFrame) -> pd.DataFrame:
            weights = np.stack([np.frombuffer(b, np.float32) for b in rows["weights"]]).astype(np.float64)
            out = (weights * (rows["tokens"] / rows["tokens"].sum()).to_numpy()[:, None]).sum(axis=0)
            return pd.DataFrame({"chunk": rows["chunk"].iloc[:1], "tokens": rows["tokens"].sum(), "weights": [out.astype(np.float32).tobytes()]})

        columns = "chunk bigint, tokens bigint, weights binary"
        made = chosen.select("symbols").mapInPandas(run, f"bunch bigint, {columns}")
        made = made.groupBy("chunk", "bunch").applyInPandas(mean, columns).groupBy("chunk").applyInPandas(mean, columns).collect()
        if made:
            net = net.with_flat(np.concatenate([np.frombuffer(r["weights"], np.float32) for r in sorted(made, key=lambda r: r["chunk"])]))
    return net


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row per document: id, held_out (not ``training``), n_tokens,
    n_known, train_tokens, base_score (add-half unigram) and score (the
    network), both log10 probabilities of the whole text."""
    text, spark = text_of(f"`{text_col}`"), docs.sparkSession
    training = F.coalesce(training, F.lit(False))
    counts = count_words(docs.filter(training), text)
    words = lexicon(counts, settings)
    texts = read(docs, F.col(f"`{id_col}`"), text, training, words)
    sent = spark.sparkContext.broadcast(train(texts, words, settings))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net, kept, n = sent.value, [], 0

        def together() -> pd.DataFrame:
            rows = pd.concat(kept, ignore_index=True)
            path = net.score([np.frombuffer(b, "<u2").astype(np.int32) for b in rows.pop("symbols")]) / math.log(10)
            return rows.assign(id=_texts(rows["id"]), score=rows.pop("static") + path)

        for batch in batches:
            kept.append(batch)
            n += int(batch["n"].sum())
            if n >= TOGETHER:
                yield together()
                kept, n = [], 0
        if kept:
            yield together()

    columns = {"uid": "bigint", "id": "string", "held_out": "boolean", "n": "bigint", "known": "bigint", "base": "double"}
    out = texts.select(*columns, "static", "symbols").mapInPandas(
        run, ", ".join(f"{k} {v}" for k, v in columns.items()) + ", score double")
    rare = texts.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("of")).select("uid", F.col("of.rare").alias("word"), "of.times")
    rare = rare.join(counts, "word", "left")
    rare = rare.groupBy("uid").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more"),
        F.sum(F.when(F.coalesce("n", F.lit(0)) > 0, F.col("times"))).alias("also"))
    out, key = out.join(rare, "uid", "left"), docs.schema[id_col].dataType
    more = F.coalesce("more", F.lit(0.0))
    return out.select(F.col("id").cast(key).alias(id_col), "held_out", F.col("n").alias("n_tokens"),
                      (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"),
                      F.lit(words.tokens).cast("bigint").alias("train_tokens"),
                      (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"))
