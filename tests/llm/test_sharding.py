import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from edspark.llm import sharding


def plain_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("n", [1, 2, 40, 41, 1000])
def test_jump(n):
    keys = np.random.default_rng(1).integers(0, 2**64, 500, dtype=np.uint64)
    assert sharding.jump(keys, n).tolist() == [plain_jump(int(k), n) for k in keys]


def rows():
    return [(i, f"text {i % 7}", "x") for i in range(400)] + [(None, None, "x")] * 3 + [(5, "other", "x"), (5, "text 5", "x")] + [
        (900, "", "x"), (901, "é long " * 40_000, "x"), (902, "x", "x")] + [(903, "hot", "x")] * 150


@pytest.mark.parametrize("blocks", [1, 7, 400])
def test_slots_moves_and_sizes(spark, blocks):
    df = spark.createDataFrame(rows(), "doc_id long, text string, shard string").repartition(3)
    got = [r.asDict() for r in sharding.shard(df, 8, blocks=blocks).collect()]
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, _ in rows())
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["slot"])
    again = [r.asDict() for r in sharding.shard(df.repartition(5), 8, blocks=3).collect()]
    assert sorted(got, key=key) == sorted(again, key=key)


def test_copies_come_back_in_chunks(spark, monkeypatch):
    df = spark.createDataFrame(rows(), "doc_id long, text string, shard string")
    whole = sorted(sharding.shard(df, 8).collect(), key=str)
    monkeypatch.setattr(sharding, "COPIES", 4)
    assert sorted(sharding.shard(df, 8).collect(), key=str) == whole and len(whole) == len(rows())


def test_empty(spark):
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string"), 4).count() == 0
