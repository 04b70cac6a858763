import math
import random
import zlib
from collections import Counter
from dataclasses import fields

import numpy as np
import pytest
from pyspark.sql import functions as F

from edspark.llm import gru
from edspark.llm import language_model as lm
from edspark.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, word string"
SMALL = lm.Settings(frequent=40, shard_tokens=2000)


def network(seed=1, kind=np.float64):
    r = np.random.default_rng(seed)
    net = gru.Gru.start(np.ones(gru.CLASSES + gru.TAIL), r.random(gru.WORDS))
    return gru.Gru(*[getattr(net, f.name).astype(kind) for f in fields(net)])


def test_gradients_by_differences():
    r, net = np.random.default_rng(2), network()
    y = r.integers(0, gru.SYMBOLS, (6, 5))
    x = np.concatenate([np.zeros((1, 5), int), y[:-1]])
    x[3, 2] = gru.END
    h = np.zeros((5, gru.HIDDEN))
    _, _, gradient = net._window(h, x, y)
    words = [int(s) for s in y.ravel() if s < gru.WORDS]
    for name, g in gradient.items():
        a = getattr(net, name)
        for i in range(6):
            row = words[i] if name in ("to_word", "word_offset") else int(x[i, i % 5]) if name == "enter" else int(r.integers(len(a)))
            at = (row, *(int(r.integers(n)) for n in a.shape[1:]))
            old, p = a[at], []
            for step in (1e-5, -1e-5):
                a[at] = old + step
                p.append(net._window(h, x, y)[1])
            a[at] = old
            assert -(p[0] - p[1]) / 2e-5 == pytest.approx(g[at], abs=1e-4)


def test_probabilities_add_up_to_one():
    net, every = network(), np.arange(gru.SYMBOLS)
    h = np.repeat(np.random.default_rng(3).normal(size=(1, gru.HIDDEN)), len(every), axis=0)
    p, _ = net.log_probabilities(h, every)
    assert np.exp(p[: gru.WORDS]).sum() + np.exp(p[gru.WORDS:]).sum() == pytest.approx(1)


@pytest.mark.parametrize("window", [1, 40, 100_000])
def test_score_carries_the_state(window):
    net, r = network(kind=np.float32), np.random.default_rng(4)
    texts = [np.append(r.integers(1, gru.SYMBOLS, n), gru.END).astype(np.int32) for n in (0, 5, 90, 1, 5, 33)]
    want = []
    for t in texts:
        h, total, before = np.zeros((1, gru.HIDDEN), np.float32), 0.0, gru.END
        for s in t.tolist():
            h = net.step(h, np.array([before]))[0]
            total += net.log_probabilities(h, np.array([s]))[0][0]
            before = s
        want.append(total)
    assert net.score(texts, window) == pytest.approx(want, rel=1e-4)


def test_training_learns_a_pattern():
    net = gru.Gru.start(np.ones(gru.CLASSES + gru.TAIL) / 96, np.ones(gru.WORDS) / gru.PER_CLASS)
    stream = np.tile(np.array([5, 70, 2100, gru.END], np.int32), 4000)
    better, _ = net.train(stream)
    one = [np.array([5, 70, 2100, gru.END], np.int32)]
    assert better.score(one)[0] > net.score(one)[0] + 5


def plain_base(docs, holds_out):
    counts = Counter()
    for i, t, *_ in docs:
        if not holds_out(i):
            counts.update((t or "").encode().lower().split() + [b""])
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t, *_ in docs:
        w = (t or "").encode().lower().split() + [b""]
        out.append((i, holds_out(i), len(w), sum(counts[x] > 0 for x in w), n,
                    sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)))
    return out


def corpus():
    r = random.Random(6)
    words = {"en": [f"thing{i}" for i in range(30)], "de": [f"sache{i}ung" for i in range(30)]}
    out = [(i, " ".join(r.choices(words[r.choice(["en", "de"])], k=r.randrange(5, 60))), "x") for i in range(200)]
    return out + [(500, None, "x"), (501, "", "x"), (502, " \n\x0b", "x"), (503, "Unseen ÉCLAIR\tthing1", "x"), (503, "Unseen ÉCLAIR\tthing1", "x"),
                  (None, "THING1 thing2 " * 20_000, "x")]


def test_scores_against_plain_counts(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    got = lm.score(df, ~F.coalesce(F.col("doc_id") >= 400, F.lit(True)) | (F.col("doc_id") == 502), settings=SMALL).collect()
    want = plain_base(docs, lambda i: i is None or (i >= 400 and i != 502))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
        assert tuple(g)[:5] == w[:5] and g["base_score"] == pytest.approx(w[5])
        assert math.isfinite(g["score"]) and g["score"] < 0


def test_whole_model_is_a_probability(spark):
    """Over single words - seen, frequent or not, and one unseen for each
    tail class - the probabilities of the first token add up to one."""
    docs = spark.createDataFrame(corpus(), SCHEMA)
    counts = lm.count_words(docs, lm.text_of())
    words = lm.lexicon(counts, SMALL)
    n = {r["word"].encode(): r["n"] for r in counts.collect()}
    h = words.net.step(np.zeros((1, gru.HIDDEN), np.float32), np.array([gru.END]))[0]
    total = 0.0
    for w, c in n.items():
        s = words.symbols([w])[0][0] if w else gru.END
        p = math.exp(words.net.log_probabilities(h, np.array([s]))[0][0])
        total += p if s < gru.WORDS else p * (c + 0.5) / 10 ** words.log_tail[s - gru.WORDS]
    for b in range(gru.TAIL):
        total += math.exp(words.net.log_probabilities(h, np.array([gru.WORDS + b]))[0][0]) * 0.5 / 10 ** words.log_tail[b]
    assert total == pytest.approx(1, abs=1e-3)


def test_nothing_to_learn_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "x")], SCHEMA)
    got = {r["doc_id"]: r for r in lm.score(df, F.lit(False), settings=SMALL).collect()}
    assert got[1]["train_tokens"] == 0 and got[1]["n_known"] == 0 and got[1]["n_tokens"] == 3 and abs(got[1]["base_score"]) < 1e-9
    assert lm.score(spark.createDataFrame([], SCHEMA), F.lit(True), settings=SMALL).count() == 0


def dealt_of(df, words, settings):
    return lm.deal(lm.read(df, F.col("doc_id"), lm.text_of(), F.lit(True), words), settings)


@pytest.mark.parametrize("copies", [1, 40])
def test_every_text_is_dealt_to_one_round(spark, copies):
    docs = [(i, f"text{i % 300} " * copies) for i in range(600)]
    settings = lm.Settings()
    words = lm.Lexicon([], 0, 0, 0, {})
    rows = dealt_of(spark.createDataFrame(docs, "doc_id long, text string"), words, settings).collect()
    by_round = Counter(r["round"] for r in rows)
    assert len(rows) == 600 and by_round.keys() == set(range(settings.rounds)) and min(by_round.values()) > 100


@pytest.mark.parametrize("ids", [range(600), [7] * 600, [None] * 600])
def test_copies_spread_over_rounds_and_shards(spark, ids):
    words, settings = lm.Lexicon([], 0, 0, 0, {}), lm.Settings()
    df = spark.createDataFrame([(i, "the same text") for i in ids], "doc_id long, text string").repartition(3)
    dealt = dealt_of(df, words, settings)
    rows = dealt.select("round", F.pmod(F.hash(F.xxhash64("h")), F.lit(4)).alias("shard"), F.length("symbols").alias("n")).collect()
    found = Counter((r["round"], r["shard"]) for r in rows)
    assert len(rows) == 600 and {r["n"] for r in rows} == {8} and len(found) == 12 and max(found.values()) < 100


def test_unrepeated_texts_are_dealt_alike_in_any_layout(spark):
    df = spark.createDataFrame([(i, f"text {i % 50}") for i in range(300)], "doc_id long, text string")
    words = lm.Lexicon([], 0, 0, 0, {})
    a, b = (dealt_of(df.repartition(n), words, lm.Settings()).collect() for n in (1, 5))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_pieces_are_bounded():
    r = np.random.default_rng(5)
    texts = [r.integers(0, 9, n).astype(np.int32) for n in (3, 0, 250, 40, 40, 19, 1, 60)]
    got = list(lm.pieces(iter(texts), 20))
    assert np.array_equal(np.concatenate(got), np.concatenate(texts))
    assert {len(x) for x in got[:-1]} == {20} and len(got[-1]) < 40
    assert list(lm.pieces(iter([]), 20)) == []


def test_scales_go_on_from_piece_to_piece():
    stream = np.random.default_rng(6).integers(0, 50, 64 * 40).astype(np.int32)
    squares, net = {}, network(kind=np.float32)
    net.train(stream, squares=squares)
    before = {k: v.sum() for k, v in squares.items()}
    net.train(stream, squares=squares)
    assert all(squares[k].sum() > before[k] for k in before)


@pytest.mark.parametrize("n", [1, 999, 2019, 5003])
def test_every_symbol_gives_a_gradient(monkeypatch, n):
    """Also those that don't fill all parallel streams; each comes after the
    symbol before it."""
    stream, found, window = np.random.default_rng(8).integers(0, 50, n).astype(np.int32), Counter(), gru.Gru._window

    def seen(self, h, x, y):
        found.update(zip(x.ravel().tolist(), y.ravel().tolist()))
        return window(self, h, x, y)

    monkeypatch.setattr(gru.Gru, "_window", seen)
    network(kind=np.float32).train(stream)
    assert found == Counter(zip([gru.END, *stream[:-1].tolist()], stream.tolist()))


def test_query_beats_the_base(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = {r["doc_id"]: r for r in QUERIES["op4_recurrent_lm"](spark, sf).collect()}
    for w in plain_base(docs, lambda i: zlib.crc32(str(i).encode()) % 5 == 1):
        r = rows[w[0]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[1:5] and r["base_score"] == pytest.approx(w[5])
    out = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_texts_are_read_together_as_one_by_one(monkeypatch):
    import pyarrow as pa

    r = random.Random(5)
    letters = ["a", "B", "É", "ß", " ", "\t", "\x0b", "\n", "\x1c", "\xa0", "語"]
    texts = ["", " ", "Ab  ab\x0c", "x" * 70_000, *("".join(r.choices(letters, k=r.randrange(60))) for _ in range(300))]
    words = lm.Lexicon([("a", 9), ("ab", 4), ("é", 2)], 40, 20, 5, {})
    got = words.read(pa.array(texts))
    rare = got["rare"].to_pylist()
    for i, t in enumerate(texts):
        own = t.encode().lower().split()
        symbols = [words.number.get(w, gru.WORDS + zlib.crc32(w.decode()[-2:].encode()) % gru.TAIL) for w in own]
        assert np.frombuffer(got["symbols"][i].as_py(), "<u2").tolist() == [*symbols, gru.END]
        assert Counter(dict(zip(rare[i], got["times"][i].as_py()))) == Counter(w.decode() for w in own if w not in words.number)
        assert (got["n"][i].as_py(), got["known"][i].as_py()) == (len(own) + 1, sum(w in words.number for w in own) + 1)
        base = sum(words.log_count[words.number[w]] for w in [b"", *own] if w in words.number) - (len(own) + 1) * words.log_all
        assert got["base"][i].as_py() == pytest.approx(base)
    monkeypatch.setattr(lm, "READ", 500)
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    parts = list(lm.portions(iter([batch, batch.slice(0, 0)])))
    assert len(parts) > 5 and sum((p.column("text").to_pylist() for p in parts), []) == texts
    assert all(sum(len(t.encode()) for t in p.column("text").to_pylist()[1:]) < 500 for p in parts)


@pytest.mark.parametrize("far", [1.0, 900.0])
def test_large_weights_keep_exact_probabilities(far):
    """The exponentials' shift is left out only where nothing can overflow."""
    net, r = network(kind=np.float32), np.random.default_rng(2)
    net.to_class *= far
    net.to_word *= far
    h = r.uniform(-1, 1, (200, gru.HIDDEN)).astype(np.float32)
    y = r.integers(0, gru.SYMBOLS, 200)
    wide = network()
    wide.to_class, wide.to_word = net.to_class.astype(float), net.to_word.astype(float)
    p = net.log_probabilities(h, y)[0]
    exact = h.astype(float) @ wide.to_class + wide.class_offset
    kind = np.where(y < gru.WORDS, y // gru.PER_CLASS, y - gru.WORDS + gru.CLASSES)
    top = exact.max(axis=1)
    want = exact[np.arange(200), kind] - top - np.log(np.exp(exact - top[:, None]).sum(axis=1))
    tail = y >= gru.WORDS
    assert np.isfinite(p).all() and np.allclose(p[tail], want[tail], rtol=1e-3, atol=1e-3)
