import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest

from edspark.llm import mixing

SCHEMA = "doc_id long, text string, source string, epoch string"


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()


def plain(docs, mix):
    """(id, source, size, epoch) of every occurrence, by sorting everything."""
    rows = [(d, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) + 1, md5(f"{'' if d is None else d}|{t or ''}")) for d, t, s, *_ in docs]
    tokens = Counter()
    for _, s, n, _ in rows:
        tokens[s] += n
    total = sum(tokens.values())

    def weights(a):
        z = sum((t / total) ** a for t in tokens.values())
        return {s: (t / total) ** a / z for s, t in tokens.items()}

    entropy = lambda a: -sum(w * math.log(w) for w in weights(a).values())
    most = lambda a: max(w * total / tokens[s] for s, w in weights(a).items()) * mix.budget

    def bisect(ok):
        low, high = 0.0, 1.0
        for _ in range(30):
            mid = (low + high) / 2
            low, high = (mid, high) if ok(mid) else (low, mid)
        return low

    target = mix.entropy * math.log(len(tokens))
    a = 1.0 if entropy(1.0) >= target else bisect(lambda x: entropy(x) >= target)
    if most(a) > mix.repeats:
        a = 1.0 if most(1.0) > mix.repeats else bisect(lambda x: most(x) > mix.repeats) + 2.0 ** -30
    per_block = max(mix.block_tokens, -(-total // mix.blocks))
    out = []
    for s, w in weights(a).items():
        own = [r for r in rows if r[1] == s]
        full, rest = divmod(math.floor(w * mix.budget * total + 0.5), tokens[s])
        out += [(*r[:3], e) for r in own for e in range(full)]
        blocks = defaultdict(list)
        for r in own:
            blocks[int(r[3][:8], 16) % -(-tokens[s] // per_block)].append(r)
        for b in sorted(blocks, key=lambda b: (md5(f"{mix.seed}|block|{full}|{b}"), b)):
            size = sum(r[2] for r in blocks[b])
            if size <= rest:
                out += [(*r[:3], full) for r in blocks[b]]
                rest -= size
                continue
            by_hash = defaultdict(list)
            for r in blocks[b]:
                by_hash[md5(f"{mix.seed}|{full}|{r[3]}")].append(r)
            for h in sorted(by_hash):
                rest -= sum(r[2] for r in by_hash[h])
                if rest < 0:
                    break
                out += [(*r[:3], full) for r in by_hash[h]]
            break
    return Counter(out), a


def docs():
    out = [(i, "big words here " * (1 + i % 9), "big", "x") for i in range(300)]
    out += [(1000 + i, f"mid {i}", "mid", "x") for i in range(80)] + [(2000 + i, None if i % 2 else "", None, "x") for i in range(20)]
    return out + [(7, "twice", "small", "x")] * 3 + [(None, "no id", "small", "x")]


@pytest.mark.parametrize("mix", [
    mixing.Mixture(block_tokens=200), mixing.Mixture(block_tokens=200, repeats=1.5), mixing.Mixture(entropy=0.0),
    mixing.Mixture(entropy=0.999, repeats=1e9, budget=2.0, block_tokens=50, broadcast_rows=0), mixing.Mixture(repeats=0.5)])
def test_against_brute_force(spark, mix):
    df = spark.createDataFrame(docs(), SCHEMA).repartition(3)
    want, a = plain(docs(), mix)
    rows = mixing.realise(df, mix).collect()
    assert Counter((r["doc_id"], r["source"], r["n_tokens"], r["epoch"]) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r["source"]].append((r["position"], r["epoch"]))
    for p in places.values():
        assert [x for x, _ in sorted(p)] == list(range(len(p))) and [e for _, e in sorted(p)] == sorted(e for _, e in p)
    got = mixing.mixed(df, mix)
    assert got.columns == df.columns
    again = Counter((r["doc_id"], r["text"], r["source"]) for r in got.collect())
    text = {(d, s): t for d, t, s, _ in docs()}
    flat = Counter()
    for (d, s, _, _), n in want.items():
        flat[d, text[d, s], s] += n
    assert again == flat


def test_realised_shares_meet_the_weights(spark):
    df = spark.createDataFrame(docs(), SCHEMA)
    rows = mixing.realise(df, mixing.Mixture(block_tokens=100)).collect()
    total = sum(mixing_size(t) for _, t, _, _ in docs())
    for s in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == s]
        quota = own[0]["weight"] * total
        assert -0.5 <= quota - sum(r["n_tokens"] for r in own) <= 40


def mixing_size(t):
    return len((t or "").split()) + 1


def test_one_source_and_empty_table(spark):
    one = spark.createDataFrame([(1, "a", "s", "x"), (2, "b", "s", "x")], SCHEMA)
    assert mixing.realise(one).count() == 2 == mixing.mixed(one).count()
    none = spark.createDataFrame([], SCHEMA)
    assert mixing.realise(none).count() == 0 == mixing.mixed(none).count()
