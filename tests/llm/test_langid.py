import numpy as np
import pytest
from pyspark.sql import functions as F

from edspark.llm import langid
from edspark.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string"


def plain_presence(text, max_n=3):
    folded = []
    for ch in " " + text:
        low = ch.lower() if ch.isalpha() else " "
        low = low if len(low) == 1 else ch
        if low != " " or not folded or folded[-1] != " ":
            folded.append(low)
    return {tuple(folded[i:i + n]) for n in range(1, max_n + 1) for i in range(len(folded) - n + 1)}


@pytest.mark.parametrize("text", ["a", "Ab, cd!", "été ÉTÉ 12 été", "x" * 50, "日本語 テキスト"])
def test_presence_counts_distinct_grams(text):
    row = np.zeros(1 << langid.HASH_BITS, np.uint8)
    assert langid.presence(text, row)
    assert row.sum() == len(plain_presence(text))  # no collision among so few


def test_pieces_do_not_change_a_long_text(monkeypatch):
    text = "Der Hund, das Haus. " * 40 + "été  !! là"
    whole, cut = np.zeros((2, 1 << langid.HASH_BITS), np.uint8)
    langid.presence(text, whole)
    monkeypatch.setattr(langid, "PIECE", 7)
    langid.presence(text, cut)
    assert (whole == cut).all()


def data():
    out = []
    for i in range(60):
        out.append((i, f"the house and the dog of king number {i} walked with thing", "en"))
        out.append((100 + i, f"der hund und das haus von könig nummer {i} ging mit schnee", "de"))
    return out


def test_labels_are_learnt_and_edge_rows_defined(spark):
    df = spark.createDataFrame(data() + [(None, "the thing", None)], SCHEMA)
    model = langid.fit(df, landmarks_per_lang=8)
    assert model.languages == ["de", "en"]
    ask = spark.createDataFrame([(1, "the dog and the house", "x"), (2, "das haus und der hund", "x"), (3, None, "x"), (4, "", "x"),
                                 (5, "12 !? 34", "x"), (5, "12 !? 34", "x"), (None, "the king " * 50_000, "x")],
                                "doc_id long, text string, language string")
    got = {(r["doc_id"], (r["text"] or "")[:5]): r["guess"] for r in langid.identify(ask, model, name="guess").collect()}
    assert [got[k]["lang_pred"] for k in [(1, "the d"), (2, "das h"), (3, ""), (4, ""), (5, "12 !?"), (None, "the k")]] == [
        "en", "de", "und", "und", "und", "en"]
    assert all(0 <= g["score"] <= 1 for g in got.values()) and got[(3, "")]["score"] == 0
    kept = langid.keep_known(ask, model)
    assert kept.columns == ask.columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2]


def test_sample_is_bounded_and_equals_the_normal_equations(spark):
    df = spark.createDataFrame(data() * 2, SCHEMA)
    assert langid._sample(df, "doc_id", "text", "lang", 10).count() == 20
    model = langid.fit(df, landmarks_per_lang=4, sample_per_lang=10)
    rows = langid._sample(df, "doc_id", "text", "lang", 10).orderBy("lang", "place").collect()
    k, _ = model.kernels([r["text"] for r in rows])
    y = np.array([[1 if r["lang"] == lang else -1 for lang in model.languages] for r in rows])
    kmm, _ = model.kernels([r["text"] for r in rows if r["place"] <= 4])
    a = np.linalg.lstsq(k.T @ k + 1e-3 * 20 * kmm + 1e-9 * 20 * np.eye(8), k.T @ y, rcond=None)[0]
    assert np.allclose(k @ a, k @ model.coefficients, atol=1e-2)


def test_no_label_and_no_row(spark):
    df = spark.createDataFrame([(1, "text", None)], SCHEMA)
    model = langid.fit(df)
    assert [r["language"]["lang_pred"] for r in langid.identify(df, model).collect()] == ["und"]
    assert langid.identify(spark.createDataFrame([], SCHEMA), model).count() == 0


def test_query_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op7_language_id"](spark, sf)
    told = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = got.join(told, "doc_id").filter("held_out").collect()
    assert len(rows) > 200 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.99
    assert got.count() == told.count()


def test_sample_is_limited_before_the_shuffle(spark):
    df = spark.createDataFrame(data(), SCHEMA)
    plan = langid._sample(df, "doc_id", "text", "lang", 1000)._jdf.queryExecution().executedPlan().toString()
    first = plan[plan.rindex("Exchange hashpartitioning(lang"):]
    assert "WindowGroupLimit" in first


def test_sample_takes_distinct_ids_and_ranks_few(spark):
    """An id on a third of the rows takes one place among the ids, and most
    ids are left out before they are ranked."""
    rows = [(i, f"text {i}", "en") for i in range(6000)] + [(-1, "copy", "en")] * 3000
    df = spark.createDataFrame(rows, SCHEMA)
    assert langid._sample(df, "doc_id", "text", "lang", 1500).count() == 1500
    small = langid._sample(df.filter("doc_id >= 0"), "doc_id", "text", "lang", 50)
    hashed = spark.range(6000).orderBy(F.xxhash64(F.col("id").cast("string"))).limit(50)
    assert {r["text"] for r in small.collect()} == {f"text {r['id']}" for r in hashed.collect()}
    assert "bar" in langid._sample(df, "doc_id", "text", "lang", 1500)._jdf.queryExecution().optimizedPlan().toString()
    assert langid.fit.__defaults__[5] == 1500
