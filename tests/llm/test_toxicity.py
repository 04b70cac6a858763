import math
import random

import numpy as np
import pytest

from edspark.llm import toxicity
from edspark.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, score string"
SMALL = toxicity.Ftrl(l1=0.5, min_texts=2)


def plain_ftrl(rows, labels, r):
    """The published update, a coordinate at a time."""
    seen = {}
    for x in rows:
        for i in x:
            seen[i] = seen.get(i, 0) + 1
    z, n = {}, {}

    def weight(i):
        if i == "bias":
            return -z.get(i, 0) / ((r.beta + math.sqrt(n.get(i, 0))) / r.alpha)
        zi = z.get(i, 0.0)
        if abs(zi) <= r.l1:
            return 0.0
        return -(zi - math.copysign(r.l1, zi)) / ((r.beta + math.sqrt(n.get(i, 0.0))) / r.alpha + r.l2)

    for _ in range(r.epochs):
        for x, y in zip(rows, labels):
            own = ["bias", *[i for i in x if seen[i] >= r.min_texts]]
            w = {i: weight(i) for i in own}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in own:
                sigma = (math.sqrt(n.get(i, 0) + g * g) - math.sqrt(n.get(i, 0))) / r.alpha
                z[i] = z.get(i, 0) + g - sigma * w[i]
                n[i] = n.get(i, 0) + g * g
    return {i: weight(i) for i in z}


def test_fit_against_the_published_update():
    r = random.Random(1)
    rows = [np.array(sorted(r.sample(range(30), 6))) for _ in range(40)]
    labels = np.array([float(3 in x or 7 in x) for x in rows])
    slots, weights, bias = toxicity.fit_ftrl(rows, labels, SMALL)
    want = plain_ftrl([x.tolist() for x in rows], labels.tolist(), SMALL)
    assert bias == pytest.approx(want.pop("bias"))
    assert dict(zip(slots.tolist(), weights.tolist())) == pytest.approx({i: w for i, w in want.items() if w})


def test_features_are_words_stems_pairs_and_skips():
    assert len(toxicity.features("")) == 0
    one = set(toxicity.features("Idiot,"))
    assert one == set(toxicity.features("idiot")) and len(one) == 3
    both, apart = set(toxicity.features("aaa bbb")), set(toxicity.features("aaa")) | set(toxicity.features("bbb"))
    assert apart < both and len(both - apart) == 1
    three = set(toxicity.features("aaa x bbb"))
    assert len(three) == 3 * 3 + 2 + 1
    assert set(toxicity.features("bbb aaa")) != both


def test_texts_do_not_run_into_each_other():
    texts = ["aaa", "bbb", "", "aaa bbb aaa"]
    found = {i: set() for i in range(4)}
    for doc, slot in toxicity.occurrences(texts):
        for d, s in zip(doc.tolist(), slot.tolist()):
            found[d].add(s)
    assert [found[i] for i in range(4)] == [set(toxicity.features(t)) for t in texts]


def corpus(n=240):
    r = random.Random(4)
    words = [f"word{i}" for i in range(200)]
    out, labels = [], []
    for i in range(n):
        w = r.choices(words, k=30)
        bad = i % 3 == 0
        if bad:
            w[r.randrange(30)] = r.choice(["vilea", "vileb"])
        out.append((i, " ".join(w), "x"))
        labels.append((i, 1, int(bad)))
    return out, labels


def test_learns_and_defines_odd_rows(spark):
    docs, labels = corpus()
    labels += [(0, 1, 0), (5, 1, None), (None, 1, 1), (99999, 1, 1)]
    d = spark.createDataFrame(docs, SCHEMA)
    model = toxicity.fit(d.repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rates=SMALL)
    again = toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rates=SMALL)
    assert (model.slots == again.slots).all() and (model.weights == again.weights).all()
    ask = [(1, "a vilea thing", "x"), (2, "a kind word1 thing", "x"), (3, None, "x"), (4, "", "x"), (4, "", "x"), (None, "vileb " * 60_000, "x")]
    df = spark.createDataFrame(ask, SCHEMA)
    got = df.select("doc_id", toxicity.score(df, model, toxicity.text_of()).alias("p")).collect()
    by = {r["doc_id"]: r["p"] for r in got}
    assert len(got) == 6 and by[1] > 0.5 > by[2] and by[3] == by[4] < 0.5 < by[None] and all(0 <= p <= 1 for p in by.values())


def test_no_labels_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a", "x")], SCHEMA)
    model = toxicity.fit(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert df.select(toxicity.score(df, model, toxicity.text_of()).alias("p")).first()["p"] == 0
    none = spark.createDataFrame([], SCHEMA)
    assert none.select(toxicity.score(none, model, toxicity.text_of())).count() == 0


def test_query_on_held_out_english(spark):
    """The small tables' labels follow the words in English only."""
    sf = "/root/testdata/sf0.1"
    rows = QUERIES["op2_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").join(
        spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").filter("held_out and lang = 'en'").collect()
    bad, good = [r["predicted"] for r in rows if r["toxic"]], [r["predicted"] for r in rows if not r["toxic"]]
    assert len(bad) > 30 and np.mean(bad) > 0.85 and np.mean(good) < 0.02
