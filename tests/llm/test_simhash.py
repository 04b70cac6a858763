import random

import numpy as np
import pytest
import xxhash

from edspark.llm import simhash
from edspark.llm.components import connected_components

SCHEMA = "doc_id long, text string"


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, limit=3):
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= limit:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(fps))]


def clustered(n, seed=1):
    """Fingerprints around a few centres, so that links are common."""
    r = random.Random(seed)
    centres = [r.getrandbits(64) for _ in range(8)]
    out = []
    for _ in range(n):
        x = r.choice(centres)
        for _ in range(r.randrange(6)):
            x ^= 1 << r.randrange(64)
        out.append(x)
    return out


@pytest.mark.parametrize("text", [None, "", "  \n", "one", "Two words", "A b c", "a  B\tc d\x0be", "é É ß a b", "x " * 3000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_gray_rank_is_the_inverse_of_the_gray_code():
    n = np.arange(1000, dtype=np.uint64)
    assert (simhash.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


@pytest.mark.parametrize("n", [1, 2, 9, 65, 700])
@pytest.mark.parametrize("limit", [0, 3, 5])
def test_index_finds_exactly_the_near_ones(n, limit):
    fps = np.array(clustered(n, n), np.uint64)
    queries = np.array(clustered(50, 99) + fps[:5].tolist(), np.uint64)
    found = {(int(a), int(b)) for q, m in simhash.GrayIndex(fps).search(queries, limit) for a, b in zip(q, m)}
    assert found == {(i, j) for i, x in enumerate(queries.tolist()) for j, y in enumerate(fps.tolist())
                     if (x ^ y).bit_count() <= limit}


def test_a_halved_frontier_finds_the_same(monkeypatch):
    fps = np.array(clustered(500, 7), np.uint64)
    pairs = lambda: sorted((int(a), int(b)) for q, m in simhash.GrayIndex(fps).search(fps, 3) for a, b in zip(q, m))
    whole = pairs()
    monkeypatch.setattr(simhash, "FRONTIER", 50)
    assert pairs() == whole


def cut_into_ranges(fps, size):
    """Ranges of the Gray order and the index over their shared patterns."""
    fps = fps[np.argsort(simhash.gray_rank(fps))]
    cut = np.arange(0, len(fps), size)
    ones, some = np.bitwise_and.reduceat(fps, cut), np.bitwise_or.reduceat(fps, cut)
    return fps, np.arange(len(fps)) // size, simhash.GrayIndex(ones, ~(ones ^ some))


def test_routing_loses_no_pair():
    fps, own, upper = cut_into_ranges(np.array(sorted(set(clustered(900, 3))), np.uint64), 10)
    q, node = simhash.route(fps, own, upper, 3)
    sent = set(zip(q.tolist(), node.tolist()))
    assert all((i, int(own[i])) in sent for i in range(len(fps)))
    near = [(i, j) for i in range(len(fps)) for j in range(i) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 3]
    assert near and all((j, int(own[i])) in sent for i, j in near)


def test_upper_nodes_prune_and_bound_the_copies():
    """With evenly spread bits the copies follow the number of nodes, not
    that of the fingerprints."""
    r = np.random.default_rng(5)
    copies = []
    for n in (1 << 14, 1 << 16):
        fps, own, upper = cut_into_ranges(r.integers(0, 1 << 64, n, np.uint64), n >> 10)
        q, _ = simhash.route(fps, own, upper, 3)
        copies.append(len(q) / n)
    # A range seldom ends where a pattern does, so that 9 bits are alike in one
    # of 1,024: 130 of 512 patterns are within 3 bits, and half the nodes come
    # before the own one.
    assert all(c < 1.05 * (1 + 9 + 36 + 84) for c in copies)
    assert copies[1] < 1.1 * copies[0]


def test_members_hang_together():
    fps = np.array(list(dict.fromkeys(clustered(300, 11))), np.uint64)
    members = simhash.Members(fps[:200], 3)
    edges = [*members.hang(fps), members.edges()]
    near = {(int(a), int(b)) for x, y in edges for a, b in zip(x, y)}
    assert all(a != b for a, b in near)
    place = {}
    for i, x in enumerate(fps.tolist()):
        place.setdefault(x, i)
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in near:
        label[root(place[a])] = root(place[b])
    for i, x in enumerate(fps.tolist()):
        for y in fps[:200].tolist():
            if (x ^ y).bit_count() <= 3:
                assert root(place[x]) == root(place[y])


@pytest.mark.parametrize("group_rows", [2048, 5])
def test_links_against_all_pairs(spark, group_rows):
    fps = sorted(set(clustered(400)))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3)
    got = {r["fp"]: r["component"] for r in simhash.groups(df, 3, group_rows).collect()}
    want = plain_components(fps)
    by = {}
    for x, w in zip(signed, want):
        by.setdefault(w, set()).add(got[x])
    assert all(len(v) == 1 for v in by.values()) and len(set(got.values())) == len(by)


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)] + [(7, 7)]
    star = [(100, i) for i in range(101, 400)] + [(150, 100)]
    df = spark.createDataFrame(path + star, "a long, b long")
    got = {r["node"]: r["label"] for r in connected_components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 400)}}


def rows():
    r = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(r.choices(words, k=200)) for _ in range(6)]
    out = [(i, base[i % 6]) for i in range(20)]
    out += [(100 + i, b + f" tail{i}") for i, b in enumerate(base)]
    out += [(200, None), (201, ""), (202, " \n"), (203, "word"), (203, "word"), (None, base[0]), (None, "alone here now")]
    return out


def test_documents_against_brute_force(spark):
    data = rows()
    df = spark.createDataFrame([(*x, "extra") for x in data], SCHEMA + ", fp string")
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=str)
    fps = [plain_fingerprint(t) for _, t in data]
    label = plain_components(fps)
    ids = [min((d for (d, _), x in zip(data, label) if x == w and d is not None), default=None) for w in label]
    assert got == sorted(((d, f"{f:016x}", c) for (d, _), f, c in zip(data, fps, ids)), key=str)


def test_one_of_each_keeps_one_row_of_a_group(spark):
    data = rows()
    df = spark.createDataFrame([(*x, "extra") for x in data], SCHEMA + ", fp string")
    got = simhash.one_of_each(df)
    assert got.columns == df.columns
    kept = [(r["doc_id"], r["text"]) for r in got.collect()]
    label = plain_components([plain_fingerprint(t) for _, t in data])
    best = {}
    for (d, t), w in zip(data, label):
        if w not in best or (d is None, d or 0) < (best[w][0] is None, best[w][0] or 0):
            best[w] = (d, t)
    assert sorted(kept, key=str) == sorted(best.values(), key=str)


def test_one_of_each_with_clashing_and_map_columns(spark):
    """Columns named like the operator's own, maps (also inside of other
    types), and rows that repeat as a whole."""
    data = [(1, "a b c d", 5, 6, {"k": 1}, [{"x": 2}]), (1, "a b c d", 5, 6, {"k": 1}, [{"x": 2}]), (1, "a b c d", 5, 7, {"k": 2}, None),
            (2, "a b c d", 5, 6, None, None), (None, "other words stand here now", None, None, {}, []), (3, None, 1, 1, None, None)]
    df = spark.createDataFrame(data, "doc_id long, text string, __id int, __h int, m map<string,int>, of_id array<map<string,int>>")
    got = simhash.one_of_each(df)
    assert got.columns == df.columns and got.schema == df.schema
    kept = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str)
    assert kept == sorted([(1, "a b c d"), (None, "other words stand here now"), (3, None)], key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(df).count() == 0
    assert simhash.one_of_each(df).count() == 0


def test_query_on_the_small_table(spark):
    from edspark.llm.queries import QUERIES
    out = QUERIES["op5_simhash_near_dedup"](spark, "/root/testdata/sf0.001")
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in out.collect()}
    assert got.keys() == docs.keys()
    ids = sorted(docs)
    fps = [plain_fingerprint(docs[i]) for i in ids]
    label = plain_components(fps)
    for n, i in enumerate(ids):
        assert got[i]["fingerprint"] == f"{fps[n]:016x}" and got[i]["component_id"] == ids[label[n]]
