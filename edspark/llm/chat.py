"""Chat formatting of reply trees.

Messages point at the message they answer.  Iterated self-joins enumerate the
root-to-leaf paths: in round k a message jumps to its ancestor at distance
2^k, adding up scores and depths on the way, so a path of n messages takes
about log2(n) rounds, and a round handles all trees at once.  The paths of a
tree are ranked by score; for the chosen ones the jumps, walked backwards,
collect the members, each once.  Only what is chosen is ever written out.

A chosen path becomes one conversation in a template that marks every turn;
control strings inside a text or a role are escaped reversibly.  Beside the
formatted text stand the spans (in code points) over which a loss is taken:
the texts of the assistant.

Defined cases: a null text or role is empty; a null score counts 0; a null
tree is a tree of its own; a message without a parent, or whose parent does
not exist, is a root; messages on or below a circle of replies have no root
and are in no path; a (tree, message) pair that repeats is taken once (the
smallest role and text); an empty table gives no conversation; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edspark.llm.common import stored

START, STOP = "<|im_start|>", "<|im_end|>"
#: Control strings of this and other common templates (fixed values).
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LEARNT_ROLE = "assistant"


def escape(text: Column) -> Column:
    """Backslashes are doubled, and one goes behind the first character of
    each control string, so that none is left in one piece."""
    rest = "|".join(re.escape(c[1:]) for c in CONTROL)
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), rf"([<\[])(?=({rest}))", r"$1\\")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def _jumps(links: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``links``: (tree, node, up, score), up null at a root.  Returns (tree,
    node, total, depth) of every message that hangs from a root - total is
    the score from the root to it, depth its place on its path from 1 - and
    the table of jumps (tree, node, up) of each round."""
    state = stored(links.select("tree", "node", "up", F.col("score").alias("total"), F.lit(1).cast("bigint").alias("depth")), "replies")
    most = state.count()
    rounds: list[DataFrame] = []
    while True:
        jump = state.filter("up is not null").select("tree", "node", "up")
        if 1 << len(rounds) > 2 * most or jump.isEmpty():  # what still jumps after that goes round in a circle
            break
        rounds.append(jump)
        ahead = state.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("next"),
                             F.col("total").alias("more"), F.col("depth").alias("further"))
        moved = state.filter("up is not null").join(ahead, (F.col("tree") == F.col("t")) & (F.col("up") == F.col("n")), "left").select(
            "tree", "node", F.col("next").alias("up"), (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total"),
            (F.col("depth") + F.coalesce("further", F.lit(0))).alias("depth"))
        state = stored(state.filter("up is null").unionByName(moved), "replies")
    return state.filter("up is null").drop("up"), rounds


def paths(messages: DataFrame, branches: int = 1, tree: str = "tree", node: str = "node", parent: str = "parent",
          role: str = "role", text: str = "text", score: str = "score") -> DataFrame:
    """The members of the ``branches`` best root-to-leaf paths of each tree:
    (tree, branch from 1, depth from 1, node, role, text, branch_score).  A
    path's score is the mean of its messages'; ties go to the longer path,
    then to the smaller leaf."""
    given = messages.select(
        F.when(F.col(f"`{tree}`").isNull(), "").otherwise(F.concat(F.lit("="), F.col(f"`{tree}`").cast("string"))).alias("tree"),
        F.col(f"`{tree}`").alias("name"), F.col(f"`{node}`").cast("bigint").alias("node"),
        F.col(f"`{parent}`").cast("bigint").alias("parent"), F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col(f"`{score}`").cast("double"), F.lit(0.0)).alias("score"))
    given = given.filter("node is not null").groupBy("tree", "name", "node").agg(
        F.min(F.struct("role", "text", "parent", "score")).alias("m")).select("tree", "name", "node", "m.*")
    given = stored(given, "messages")
    there = given.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    links = given.select("tree", "node", "parent", "score").join(
        there, (F.col("tree") == F.col("t")) & (F.col("parent") == F.col("n")), "left").select(
        "tree", "node", F.col("n").alias("up"), "score")
    reached, rounds = _jumps(links)
    answered = given.filter("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
    leaves = reached.join(answered, ["tree", "node"], "left_anti").withColumn("branch_score", F.col("total") / F.col("depth"))
    best = Window.partitionBy("tree").orderBy(F.desc("branch_score"), F.desc("depth"), "node")
    chosen = leaves.withColumn("branch", F.row_number().over(best)).filter(F.col("branch") <= branches)
    members = stored(chosen.select("tree", "branch", "branch_score", "node"), "members")
    for i, jump in enumerate(reversed(rounds)):
        up = members.join(jump, ["tree", "node"]).select("tree", "branch", "branch_score", F.col("up").alias("node"))
        members = members.unionByName(up)
        if i % 3 == 2 or i == len(rounds) - 1:
            members = stored(members, "members")
    placed = members.join(reached.select("tree", "node", "depth"), ["tree", "node"])
    return placed.join(given.select("tree", "node", "name", "role", "text"), ["tree", "node"]).select(
        "tree", F.col("name"), "branch", "branch_score", "depth", "node", "role", "text")


def format_paths(members: DataFrame) -> DataFrame:
    """One conversation for each path: (name, branch, branch_score, n_turns,
    formatted, loss_spans).  A path is one output row, so its turns do meet
    in one task; no more than that does."""
    header = F.concat(F.lit(START), F.regexp_replace(escape(F.col("role")), "\n", "\\\\\n"), F.lit("\n"))
    body = escape(F.col("text"))
    turns = members.select(
        "tree", "name", "branch", "branch_score", "depth", (F.col("role") == LEARNT_ROLE).alias("learnt"),
        F.char_length(header).cast("bigint").alias("ahead"), F.char_length(body).cast("bigint").alias("long"),
        F.concat(header, body, F.lit(f"{STOP}\n")).alias("piece"))
    upto = Window.partitionBy("tree", "branch").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    size = F.char_length("piece").cast("bigint")
    turns = turns.withColumn("begin", F.sum(size).over(upto) - size + F.col("ahead"))
    listed = turns.groupBy("tree", "branch").agg(
        F.first("name").alias("name"), F.first("branch_score").alias("branch_score"),
        F.sort_array(F.collect_list(F.struct("depth", "piece", "learnt", "begin", "long"))).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["learnt"]), lambda t: F.struct(t["begin"].alias("begin"), t["long"].alias("length")))
    return listed.select("name", "branch", "branch_score", F.size("turns").cast("bigint").alias("n_turns"),
                         F.array_join("turns.piece", "").alias("formatted"), spans.alias("loss_spans"))


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation."""
    turns = []
    for part in formatted.split(f"{STOP}\n")[:-1]:
        head = re.match(r"((?:[^\\\n]|\\.)*)\n", part[len(START):], flags=re.DOTALL)
        turns.append((unescape(head[1]), unescape(part[len(START) + head.end():])))
    return turns


def digests(formatted: Column, spans: Column) -> Column:
    """What a reader finds in a formatted conversation: struct(n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars)."""

    @F.pandas_udf("n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
    def read(texts: pd.Series, marks: pd.Series) -> pd.DataFrame:
        out = []
        for t, spans in zip(texts, marks, strict=True):
            turns = parse(t)
            learnt = "".join(unescape(t[s["begin"]:s["begin"] + s["length"]]) for s in spans)
            whole = "".join(f"{role}\n{text}\n" for role, text in turns)
            out.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learnt),
                        hashlib.sha256(learnt.encode()).hexdigest(), len(t)))
        return pd.DataFrame(out, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return read(formatted, spans)


def linear_messages(conversations: DataFrame) -> DataFrame:
    """A table (conv_id, turn, role, text) of plain conversations as reply
    trees: each row answers the one before it.  Equal turns are ordered by
    role and text."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("bigint")
    return conversations.select("conv_id", "turn", "role", "text").withColumn("node", place).select(
        F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text",
        F.lit(0.0).alias("score"))
