import re
from collections import Counter

import pytest

from edspark.llm import quality
from edspark.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = list(zip(words, words[1:], words[2:]))
    often = Counter(grams)
    covered = {p for i, g in enumerate(grams) if often[g] > 1 for p in (i, i + 1, i + 2)}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
            "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


TEXTS = [None, "", " \n\t", "one", "a b c", "a b c a b c", "x x x x", "a\x0bb\x0cc\r d", "é ü ß q", "12 34 !!",
         "l1 x\nl2\nl1 x\n\n \nl1 x", "# $ | <b> & %", "UP CASE ONLY HERE", "word " * 20_000, "a b c d e f g a b c z d e f",
         "- x\n* y\n• z", "so...\nwell…\nend"]


def ledger(spark, texts):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    out = quality.with_ledger(df.repartition(2))
    assert out.columns == ["doc_id", "text", "n_words", "ledger"]
    return {r["doc_id"]: r["ledger"].asDict() for r in out.collect()}


def test_measurements_against_plain_python(spark):
    got = ledger(spark, TEXTS)
    for i, t in enumerate(TEXTS):
        want = plain(t)
        assert {k: got[i][k] for k in want} == want, t


def test_bits_and_policies(spark):
    got = ledger(spark, TEXTS)
    name = lambda bits: {n for b, n in enumerate(quality.RULE_NAMES) if bits >> b & 1}
    assert name(got[0]["failed_bits"]) == {"few_words", "no_letter"} == name(got[1]["failed_bits"])
    assert {"few_words", "upper_case"} <= name(got[12]["failed_bits"])
    assert "repeated_words" in name(got[13]["failed_bits"]) and "few_words" not in name(got[13]["failed_bits"])
    assert "bullet_lines" in name(got[15]["failed_bits"]) and "ellipsis_lines" in name(got[16]["failed_bits"])
    assert [n for n, _ in quality.rules(lambda k: __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1))] == list(quality.RULE_NAMES)


def test_ablations_by_counting(spark):
    led = spark.createDataFrame([(x,) for x in [0, 0, 1, 2, 3, 4, 512, 513, 64]], "failed_bits long")
    got = {(r["policy"], r["rule"]): r for r in quality.ablations(led).collect()}
    assert len(got) == sum(map(len, quality.POLICIES.values()))
    r = got["base/1", "few_words"]
    assert (r["n_docs"], r["n_failed"], r["n_failed_only"], r["n_kept"], r["n_kept_without"]) == (9, 3, 2, 5, 7)


def test_plan_has_no_shuffle_and_no_python(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    out = quality.with_ledger(df)
    plan = out.filter(quality.passes(out["ledger.failed_bits"], quality.CURRENT))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Pandas|Arrow", plan)


def test_written_ledger_holds_every_row(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "one", 2)] * 2, "key long, ledger string, judged int")
    led = quality.write_ledger(df, "key", "ledger")
    assert led.columns == ["key", "ledger"] and led.count() == len(TEXTS) + 2
    got = {r["key"]: r["ledger"]["failed_bits"] for r in led.collect()}
    assert got[None] == got[3] and got[0] == got[1]


def test_ablation_query_against_the_plain_rules(spark):
    d = "/root/testdata/sf0.001"
    bits = [r["failed_bits"] for r in QUERIES["op1_quality_rules"](spark, d).collect()]
    got = QUERIES["quality_ablations"](spark, d).collect()
    assert len(got) == sum(map(len, quality.POLICIES.values()))
    for r in got:
        mask, bit = quality.mask_of(r["policy"]), 1 << quality.RULE_NAMES.index(r["rule"])
        assert (r["n_docs"], r["n_failed"], r["n_failed_only"], r["n_kept"], r["n_kept_without"]) == (
            len(bits), sum(b & bit != 0 for b in bits), sum(b & mask == bit for b in bits),
            sum(b & mask == 0 for b in bits), sum(b & (mask ^ bit) == 0 for b in bits))


def test_empty_table(spark):
    assert quality.write_ledger(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert quality.with_ledger(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()}
    rows = QUERIES["op1_quality_rules"](spark, f"/root/testdata/{sf}").collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = plain(docs[r["doc_id"]])
        assert {k: r[k] for k in want if k != "n_lines"} == {k: v for k, v in want.items() if k != "n_lines"}
        assert r["base_failed"] == (want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"])
        assert not (r["base_failed"] and r["kept"])
