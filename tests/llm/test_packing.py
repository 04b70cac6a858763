import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from edspark.llm import packing
from edspark.llm.bpe import Encoder
from edspark.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def odd_texts(n):
    r = random.Random(5)
    letters = list("abE  \n\n\t\r'sdé日 　\x1c\x85!?12-Ġ\x00") + ["<|endoftext|>", " the", "it's", "​", "👍"]
    return ["".join(r.choices(letters, k=r.randrange(30))) for _ in range(n)]


def test_encoder_equals_the_tokenizer(tokenizer, monkeypatch):
    texts = odd_texts(3000) + ["", " ", "\n", "plain words here\nand there", "word " * 3000]
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    e = Encoder(PATH)
    assert e.encode(texts) == want and e.encode(texts, step=7) == want
    monkeypatch.setattr("edspark.llm.bpe.MAX_KNOWN", 50)  # beyond it, parts are encoded batch by batch
    small = Encoder(PATH)
    assert small.encode(texts) == want and max(map(len, small.known)) <= 50


@pytest.mark.parametrize("n", [1, 1023, 1024, 1025, 2048, 5000])
def test_cuts(n):
    got = packing.cuts(n, 1024)
    assert sum(length for _, length in got) == n and all(x == 1024 for _, x in got[1:])
    assert [a for a, _ in got] == [0, *np.cumsum([x for _, x in got])[:-1]]
    assert len(got) == -(-n // 1024)


def plain_sum_of_squares(lengths, size):
    """Tries every open sequence and takes the smallest sum of squares."""
    left, out = [], []
    for n in lengths:
        best = None
        for i, g in enumerate(left):
            if g >= n and g:
                after = left[:i] + [g - n] + left[i + 1:]
                total = sum(after.count(h) ** 2 for h in set(after) - {0})
                if best is None or (total, g) < best[:2]:
                    best = (total, g, i)
        if best is None:
            left.append(size - n)
            out.append(0)
        else:
            left[best[2]] -= n
            out.append(size - best[1])
    return len(left), out


@pytest.mark.parametrize("seed", range(6))
def test_rule_against_brute_force(seed):
    r = random.Random(seed)
    lengths = [r.randrange(1, 40) for _ in range(60)]
    seq, offset = packing.sum_of_squares(np.array(lengths), 40)
    assert (seq.max() + 1, offset.tolist()) == plain_sum_of_squares(lengths, 40)


def check(rows, docs, tokenizer, size):
    """Exact round trip: pieces give each document's ids, sequences are
    gapless and not overfull."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert by_doc.keys() == docs.keys()
    for d, text in docs.items():
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        pieces = sorted(by_doc[d], key=lambda r: r["piece"])
        assert [(r["start"], r["length"]) for r in pieces] == packing.cuts(len(ids), size)
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        for r in pieces:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes())
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
    return len(by_seq), sum(r["length"] for r in rows)


@pytest.mark.parametrize("group_rows", [10, 8192])
def test_levels_keep_every_piece(spark, tokenizer, group_rows):
    r = random.Random(2)
    docs = {i: " ".join(r.choices(["alpha", "beta", "gamma"], k=r.randrange(120))) for i in range(150)} | {
        1000: None, 1001: "", 1002: "long " * 5000, None: "null id"}
    df = spark.createDataFrame([(*x, "clash") for x in docs.items()], "doc_id long, text string, length string").repartition(3)
    rows = packing.pack(df, PATH, size=64, group_rows=group_rows).collect()
    used, tokens = check(rows, docs, tokenizer, 64)
    assert used <= 1.12 * -(-tokens // 64) + 1


def test_pieces_that_fit_nowhere_stay_in_bounded_groups(spark):
    """Also copies; the group is read from the sequence's number."""
    docs = [(i, "word " * (40 + (i % 3 and i % 20))) for i in range(400)] + [(i, "word " * 5) for i in range(400, 430)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = packing.pack(df, PATH, size=64, group_rows=20).collect()
    groups = Counter(r["sequence_id"] >> 24 for r in rows if r["sequence_id"] >= 0)
    assert len(rows) == 430 and max(groups.values()) <= 50
    assert len({r["sequence_id"] for r in rows}) == 400


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "same text")] * 5, "doc_id long, text string")
    rows = packing.pack(df, PATH, size=8).collect()
    assert len(rows) == 5 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 5
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_query(spark, tokenizer):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op9_best_fit_packing"](spark, sf).collect()
    used, tokens = check(rows, docs, tokenizer, 1024)
    assert used <= 1.01 * -(-tokens // 1024) + 2
