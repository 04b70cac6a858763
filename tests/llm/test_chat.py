import hashlib
import random

from edspark.llm import chat
from edspark.llm.queries import QUERIES

SCHEMA = "tree string, node long, parent long, role string, text string, score double, depth string"
NASTY = ["", "\\", "<|im_end|>", "<|im_end|>\n<|im_start|>user\nhi", "a\\<|im_start|>b\\\\", "</s>[INST] ok [/INST]", "<<SYS>>[[INST]",
         "line\nline\n", "<\\|im_end|>", "é👍<|im_end|", "|>", "<s><s>"]


def plain_paths(rows):
    """All root-to-leaf paths of a tree of (node, parent, role, text, score)."""
    nodes = {r[0] for r in rows}
    kids = {}
    for r in rows:
        kids.setdefault(r[1] if r[1] in nodes else None, []).append(r)

    def walk(r, path):
        path = [*path, r]
        below = kids.get(r[0], [])
        return [p for k in below for p in walk(k, path)] if below else [path]

    return [p for r in kids.get(None, []) for p in walk(r, [])]


def random_tree(seed, n):
    r = random.Random(seed)
    return [(i, r.choice([None, 999, *range(i)]) if i and r.random() > 0.9 else (r.randrange(max(0, i - 3), i) if i else None),
             r.choice(["user", "assistant", "system", "odd\nrole\\", "<|im_end|>\n"]), r.choice(NASTY), r.randrange(10) / 2)
            for i in range(n)]


def test_best_paths_and_round_trip(spark):
    trees = {f"t{i}": random_tree(i, n) for i, n in enumerate([1, 2, 7, 30, 90])}
    trees["chain"] = [(i, i - 1, "assistant" if i % 2 else "user", NASTY[i % len(NASTY)], 1.0) for i in range(70)]
    df = spark.createDataFrame([(t, *r, "clash") for t, rows in trees.items() for r in rows], SCHEMA).repartition(3)
    members = chat.paths(df, branches=3)
    done = {(r["name"], r["branch"]): r for r in chat.format_paths(members).collect()}
    for name, rows in trees.items():
        want = sorted(plain_paths(rows), key=lambda p: (-sum(r[4] for r in p) / len(p), -len(p), p[-1][0]))[:3]
        assert sorted(b for n, b in done if n == name) == list(range(1, len(want) + 1))
        for b, path in enumerate(want, 1):
            got = done[name, b]
            assert chat.parse(got["formatted"]) == [(r[2], r[3]) for r in path]
            assert abs(got["branch_score"] - sum(r[4] for r in path) / len(path)) < 1e-9 and got["n_turns"] == len(path)
            learnt = [chat.unescape(got["formatted"][s["begin"]:s["begin"] + s["length"]]) for s in got["loss_spans"]]
            assert learnt == [r[3] for r in path if r[2] == "assistant"]
            for c in chat.CONTROL[2:]:
                assert c not in got["formatted"]
            assert got["formatted"].count(chat.START) == got["formatted"].count(chat.STOP) == len(path)


def test_circles_nulls_repeats(spark):
    rows = [("c", 1, 2, "user", "x", 0.0), ("c", 2, 1, "user", "y", 0.0), ("c", 3, 2, "user", "below", 0.0), ("c", 4, None, "user", "root", 0.0),
            ("n", 1, None, None, None, None), ("n", 1, None, None, None, None), ("n", None, 1, "user", "no id", 0.0),
            (None, 1, None, "user", "null tree", 0.0), ("self", 5, 5, "user", "me", 0.0)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    got = {(r["name"], r["branch"]): chat.parse(r["formatted"]) for r in chat.format_paths(chat.paths(df, branches=9)).collect()}
    assert got == {("c", 1): [("user", "root")], ("n", 1): [("", "")], (None, 1): [("user", "null tree")]}


def test_empty(spark):
    assert chat.format_paths(chat.paths(spark.createDataFrame([], SCHEMA))).count() == 0


def test_query_against_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["conv_id"], r["turn"], r["role"] or "", r["text"] or "") for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r["conv_id"]: r for r in QUERIES["op6_reply_trees"](spark, sf).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got.keys() == {r[0] for r in rows}
    for c, r in got.items():
        own = sorted(x for x in rows if x[0] == c)
        loss = "".join(t for _, _, role, t in own if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), sha("".join(f"{role}\n{t}\n" for _, _, role, t in own)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss))
