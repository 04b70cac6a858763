"""Repeated strings against brute force over all windows."""

import hashlib
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from edspark.llm import repeats
from edspark.llm.common import ship


def brute(texts, length):
    """(n_bytes, n_removed, n_spans, digest) of each text."""
    raws, seen = [(t or "").encode() for t in texts], {}
    for raw in raws:
        for i in range(len(raw) - length + 1):
            seen[raw[i:i + length]] = seen.get(raw[i:i + length], 0) + 1
    out = []
    for raw in raws:
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            if seen[raw[i:i + length]] > 1:
                gone[i:i + length] = True
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        spans = int(np.count_nonzero(gone[1:] < gone[:-1]))
        out.append((len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def words(seed, n):
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(list("abcdeéfghi"), r.integers(2, 9))) for _ in range(n))


def corpus():
    shared = words(1, 60)
    texts = [words(i, 80) for i in range(10, 16)]
    texts += [words(20, 30) + shared + words(21, 30), words(22, 50) + shared[5:] + words(23, 9), shared]
    copy = words(30, 120)
    texts += [copy, copy, copy[:300] + "X" + copy[301:], copy + " tail"]
    texts += ["ab " * 200, "=" * 500, "x" + "=" * 130 + "y", None, "", "short", "short", words(40, 40) * 2]
    # One passage in many documents, each with another text before and behind it.
    texts += [words(100 + i, 15) + shared[:400] + words(200 + i, 15) for i in range(40)]
    return texts


@pytest.mark.parametrize("group_bytes", [1, 1 << 20])
def test_matches_brute_force(spark, group_bytes):
    """Anchors gathered and ordered, or all counted window by window."""
    ship(spark)
    texts, length = corpus(), 100
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(5)
    found = repeats.repeated(docs, length=length, group_bytes=group_bytes)
    got = {r["id"]: [(s["start"], s["end"]) for s in r["spans"] or []] for r in found.select("id", "spans").collect()}
    for i, (n, removed, spans, _) in enumerate(brute(texts, length)):
        assert (sum(b - a for a, b in got[i]), len(got[i])) == (removed, spans), (i, n)


def test_digests_and_kept_bytes(spark):
    ship(spark)
    texts, length = corpus(), 64
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
           for r in repeats.digests(docs, length=length).collect()}
    want = brute(texts, length)
    assert [got[i] for i in range(len(texts))] == want
    kept = {r["doc_id"]: bytes(r["kept"]) for r in repeats.without_repeats(docs, length=length).collect()}
    assert [hashlib.sha256(kept[i]).hexdigest() for i in range(len(texts))] == [w[3] for w in want]


def test_order_is_that_of_the_suffixes():
    texts = [t.encode() for t in corpus() if t] + [b""]
    places, joined = repeats.corpus_order(texts)
    ends = np.cumsum([len(t) for t in texts])
    raw = joined.tobytes()
    assert len(places) == len(raw) and len(set(places.tolist())) == len(raw)
    suffix = [raw[p:ends[np.searchsorted(ends, p, side="right")]] for p in places.tolist()]
    assert suffix == sorted(suffix)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=120), min_size=1, max_size=6), st.integers(1, 30))
def test_windows_of_short_texts(texts, length):
    raws = [t.encode() for t in texts]
    if not any(raws):
        return
    count = {}
    for r in raws:
        for i in range(len(r) - length + 1):
            count[r[i:i + length]] = count.get(r[i:i + length], 0) + 1
    got = repeats.repeated_places(raws, length)
    assert [x.tolist() for x in got] == [[count[r[i:i + length]] > 1 for i in range(len(r) - length + 1)] for r in raws]


@pytest.mark.parametrize("rows", [1, 7, 400])
def test_parts_are_bounded_by_bytes(rows):
    """Whole anchors, however many rows a batch has; one larger anchor comes alone."""
    r = np.random.default_rng(3)
    anchor = np.sort(np.concatenate((r.integers(0, 60, 300), np.full(100, 30))))
    all_rows = pd.DataFrame({"anchor": anchor, "bytes": [b"x" * int(n) for n in r.integers(400, 900, len(anchor))]})
    batches = [all_rows.iloc[i:i + rows] for i in range(0, len(all_rows), rows)]
    most = 20_000
    parts = list(repeats.whole_anchors(iter([all_rows.iloc[:0], *batches, all_rows.iloc[:0]]), most))
    assert pd.concat(parts, ignore_index=True).equals(all_rows)
    homes = [set(p["anchor"]) for p in parts]
    assert sum(map(len, homes)) == len(set(anchor))
    sizes = [sum(map(len, p["bytes"])) for p in parts]
    assert all(n <= most or h == {30} for n, h in zip(sizes, homes, strict=True)) and {30} in homes
    assert len(parts) < 25
    assert list(repeats.whole_anchors(iter([]), most)) == list(repeats.whole_anchors(iter([all_rows.iloc[:0]]), most)) == []


@pytest.mark.parametrize("shared", [0, 700])
def test_memory_of_the_order(shared):
    """Different texts, and near copies, take no more than 64 bytes a byte."""
    r = np.random.default_rng(4)
    copy = r.integers(97, 123, shared).astype(np.uint8).tobytes()
    texts = [copy[:350] + r.integers(97, 123, 750 - shared).astype(np.uint8).tobytes() + copy[350:] for _ in range(1000)]
    tracemalloc.start()
    try:
        repeats.repeated_places(texts, 400)
        assert tracemalloc.get_traced_memory()[1] < 64 * sum(map(len, texts))
    finally:
        tracemalloc.stop()


def test_anchors_depend_on_the_window_alone():
    text = words(5, 300).encode()
    one = repeats.segments(b"q" * 37 + text, np.zeros(0, np.int64), 400)
    two = repeats.segments(text + b"z" * 1000, np.zeros(0, np.int64), 400)
    assert len({s[2] for s in two} & {s[2] for s in one}) > 3
    assert sum(s[1] for s in one) == len(text) + 37 - 399


def test_defined_cases(spark):
    """Nulls, repeated rows, clashing columns, an empty table."""
    ship(spark)
    long = words(7, 60)
    docs = spark.createDataFrame([(1, long, 1, "x"), (1, long, 1, "x"), (None, None, 2, "y"), (None, words(8, 60), 3, "z")],
                                 "doc_id bigint, text string, k1 int, spans string")
    rows = repeats.digests(docs, length=100).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"], r["n_spans"]) for r in rows) == [
        (0, 0, 0), (0, 0, 0), (1, len(long.encode()), 1), (1, len(long.encode()), 1)]
    empty = repeats.digests(docs.filter(F.lit(False)), length=100)
    assert empty.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] and empty.count() == 0
