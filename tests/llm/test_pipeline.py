"""Every stage against a brute-force version, on its own input."""

import random
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
from test_mixing import plain as plain_mixture
from test_packing import check as check_packing
from test_quality import plain as plain_quality
from test_simhash import plain_components, plain_fingerprint
from tokenizers import Tokenizer

from edspark.llm import langid, mixing
from edspark.llm.common import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ledger string, verdict string"


def documents():
    r = random.Random(8)
    words = {"en": [f"thing{chr(97 + i % 26)}{chr(97 + i // 26)}ing" for i in range(200)],
             "de": [f"schlüssel{chr(97 + i % 26)}{chr(97 + i // 26)}ung" for i in range(200)]}
    out = []
    for i in range(160):
        lang = "de" if i % 4 == 0 else "en"
        out.append((i, " ".join(r.choices(words[lang], k=r.randrange(50, 300))), lang, "big" if i % 3 else f"s{i % 2}"))
    out += [(200 + i, out[i][1] + ("" if i % 2 else " end"), out[i][2], "big") for i in range(40)]  # copies and near copies
    out += [out[5], out[5], (None, out[6][1], "en", None), (300, None, "en", "s0"), (301, "", None, "s0"), (302, "12 34 " * 60, "en", "s1"),
            (303, "SHOUT! " * 5 + "ALL CAPS " * 60, "en", "s1"), (304, "x " * 40_000, "en", "big"), (305, out[7][1] * 30, "en", "big")]
    return [(d, t, lang, s, len(t or ""), "extra", "extra") for d, t, lang, s in out]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(documents(), SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def test_stages(spark, sf_dir, tmp_path):
    docs, name = table(spark, sf_dir, "documents"), dict(corpus_pipeline.STAGES)
    assert list(name) == ["quality_rules", "language_id", "simhash_near_dedup", "mixing", "packing"]
    flow = {}
    for stage, f in corpus_pipeline.STAGES:
        out = f(spark, docs, sf_dir)
        if stage != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{stage}")
        after = spark.read.parquet(f"{tmp_path}/{stage}")
        flow[stage] = ([tuple(r) for r in docs.collect()], [tuple(r) for r in after.collect()], docs, after)
        docs = after

    given, kept, _, _ = flow["quality_rules"]

    def passes(text):
        m = plain_quality(text)
        upper = sum(c.isupper() for c in text or "")
        return not (m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"] or 100 * m["n_symbols"] > 10 * m["n_words"]
                    or 100 * upper > 50 * m["word_chars"] or m["word_chars"] < 2 * m["n_words"] or m["word_chars"] > 15 * m["n_words"]
                    or 100 * m["n_dup_lines"] > 50 * m["n_lines"] or not any(c.isalpha() for c in text or ""))

    assert Counter(kept) == Counter(d for d in given if passes(d[1]))
    assert 150 < len(kept) < len(given)

    given, kept, before, _ = flow["language_id"]
    model = langid.fit(before.filter(corpus_pipeline.remainder("doc_id", 4) != 2))
    names, score = model.predict([d[1] or "" for d in given])
    assert Counter(kept) == Counter(d for d, n, s in zip(given, names, score) if n != "und" and s >= 0.35)
    assert len(kept) == len(given)  # all of these are clean

    given, kept, _, _ = flow["simhash_near_dedup"]
    label = plain_components([plain_fingerprint(d[1]) for d in given])
    best = {}
    for d, w in zip(given, label):
        if w not in best or (d[0] is None, d[0] or 0) < (best[w][0] is None, best[w][0] or 0):
            best[w] = d
    assert Counter(kept) == Counter(best.values()) and len(kept) < len(given)

    given, kept, _, _ = flow["mixing"]
    want, _ = plain_mixture([(d[0], d[1], d[3]) for d in given], mixing.Mixture())
    flat = Counter()
    for (d, _, _, _), n in want.items():
        flat[d] += n
    assert Counter(d[0] for d in kept) == flat

    given, _, before, after = flow["packing"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    # Repeated documents are told apart by counting: one document at a time is checked whole.
    rows = after.collect()
    times = Counter(d[0] for d in given)
    once = {d[0]: d[1] for d in given if times[d[0]] == 1}
    used = Counter()
    for r in rows:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 1024
    for d, text in once.items():
        check_packing([_alone(r) for r in rows if r["doc_id"] == d], {d: text}, tokenizer, 1024)
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == times


def _alone(r):
    """The piece in a sequence of its own (places are checked above)."""
    return {**r.asDict(), "sequence_id": r["piece"], "offset": 0}


def test_run_equals_the_stages_one_by_one(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert set(out.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    assert out.count() > 100


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_all_rejected(spark, tmp_path):
    spark.createDataFrame([(1, None, None, None, 0, "", ""), (2, "few", "en", "s", 3, "", "")], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
