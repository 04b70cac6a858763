"""SimHash near-duplicate detection with a Gray-order hierarchical index.

1. A document's fingerprint has one bit per position of its shingles' 64-bit
   hashes: the majority of that bit over all shingles, repeats included.
2. Equal fingerprints are grouped first, so copies cost one row.
3. The distinct fingerprints are sorted by Gray rank over the whole corpus, in
   which neighbours share long bit patterns, and cut into ranges.  A range's
   shared masked pattern - the bits on which all its members agree - is an
   upper node of the index; there are at most ``max_ranges`` of them, and they
   are the only part that every task holds.
4. Every node holds the bits on which its members agree and its parent's
   members don't, so the differences of a fingerprint to a node add up on the
   way down, and a whole group goes as soon as the sum exceeds the limit.  The
   descent through the upper nodes decides to which ranges a fingerprint is
   sent; there it goes on down the range's own tree.
5. A fingerprint meets its own range and later ones, so that each pair meets
   once.  Links become a spanning forest inside the task - never all pairs of
   a group -, and the components are joined up by
   :mod:`edspark.llm.components`.

What a task holds is a range (the larger of ``group_rows`` and the number of
fingerprints over ``max_ranges``) and a batch of what is sent to it; what
comes to one range from each ``ORIGINS`` ranges is a group of its own, so a
range with a wide pattern, which attracts very many, is shared by many tasks.
How often a fingerprint is sent depends on the number of upper nodes alone:
with evenly spread bits and 1,024 nodes, which agree on 9 bits, to 130 of them
(measured at 2^14, 2^16 and 2^18 fingerprints: 123, 128, 130).

Defined cases: a null text is empty; texts without a word have fingerprint
zero and are linked like any other; texts of fewer words than a shingle hash
their whole word sequence; repeated rows fall into one component; a null id
never names a component unless all its ids are null; an empty table gives no
row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edspark.llm.common import fresh, session_partitions, stored, text_of
from edspark.llm.components import connected_components

SEED = 42
LEAF, FAN_OUT = 8, 8
#: Ranges whose fingerprints come to another range in one group.
ORIGINS = 64
#: Nodes that a search looks at together.
FRONTIER = 1 << 20


# ---- fingerprints

def fingerprint(text: str, shingle: int = 3) -> int:
    """Fingerprint of one text: ASCII letters lower-cased, words split at
    ASCII white space, shingles joined by one space."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(whole, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1]
    ends = ends[shingle - 1 :] - 1
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(whole[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], ">u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        ones += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprint_column(text: Column, shingle: int = 3) -> Column:
    """Signed 64-bit form of :func:`fingerprint` (Arrow batches)."""

    @F.pandas_udf("bigint")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return of(text)


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# ---- the index

def gray_rank(fps: np.ndarray) -> np.ndarray:
    """Place of a bit pattern in the reflected Gray sequence."""
    x = fps.astype(np.uint64).copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


def gray_rank_column(fp: Column) -> Column:
    """The same as a column; its first bit is turned, so that the order of
    signed numbers is that of the ranks."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(1 << 63)).cast("bigint"))


class GrayIndex:
    """Tree over fingerprints in Gray order; see the module's text.  Level 0
    are the fingerprints themselves, each further level groups up to
    ``FAN_OUT`` (the first ``LEAF``) nodes of the one below.  With ``masks``,
    level 0 are nodes that stand in Gray order already: patterns that hold
    where the mask has a bit."""

    def __init__(self, fps: np.ndarray, masks: np.ndarray | None = None):
        self.order = np.argsort(gray_rank(fps), kind="stable") if masks is None else np.arange(len(fps))
        values, masks = [fps[self.order]], [np.full(len(fps), ~np.uint64(0)) if masks is None else masks]
        self.fan = [0]
        while len(values[-1]) > 1:
            n = LEAF if len(values) == 1 else FAN_OUT
            cut = np.arange(0, len(values[-1]), n)
            agree = np.bitwise_and.reduceat(masks[-1], cut)
            ones = np.bitwise_or.reduceat(values[-1], cut)
            alike = np.bitwise_and.reduceat(values[-1] | ~masks[-1], cut)
            mask = agree & ~(ones & ~alike)  # bits with one value in all members
            values.append(values[-1][cut] & mask)
            masks.append(mask)
            self.fan.append(n)
        # What a node holds by itself: its pattern without the parent's bits.
        self.own = []
        for level, mask in enumerate(masks):
            above = masks[level + 1][np.arange(len(mask)) // self.fan[level + 1]] if level + 1 < len(masks) else np.uint64(0)
            self.own.append(mask & ~above)
        self.values = values

    def search(self, queries: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query number, member number) of all pairs within ``limit`` bits.
        A frontier that grows beyond ``FRONTIER`` is halved, so dense groups
        take more steps, not more memory."""
        top = len(self.values) - 1
        todo = []
        if len(self.values[0]):
            for at in range(0, len(queries), 4096):
                q = np.arange(at, min(at + 4096, len(queries)))
                todo.append((top, q, np.zeros(len(q), np.int64), np.zeros(len(q), np.uint8)))
        while todo:
            level, q, node, far = todo.pop()
            if len(q) > FRONTIER:
                half = len(q) // 2
                todo += [(level, q[half:], node[half:], far[half:]), (level, q[:half], node[:half], far[:half])]
                continue
            far = far + np.bitwise_count((queries[q] ^ self.values[level][node]) & self.own[level][node])
            near = np.flatnonzero(far <= limit)
            q, node, far = q[near], node[near], far[near]
            if not len(q):
                continue
            if level == 0:
                yield q, self.order[node]
                continue
            n = self.fan[level]
            node = (node[:, None] * n + np.arange(n)).ravel()
            q, far = np.repeat(q, n), np.repeat(far, n)
            if node.max() >= len(self.values[level - 1]):
                real = node < len(self.values[level - 1])
                q, node, far = q[real], node[real], far[real]
            todo.append((level - 1, q, node, far))


def _join_up(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the links a-b: hook the larger label to the smaller and
    shorten paths until nothing changes."""
    while True:
        la, lb = label[a], label[b]
        if (la == lb).all():
            return label
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while (label != (short := label[label])).any():
            label = short


class Members:
    """The fingerprints of one range: what is sent here hangs on one member
    it is near to, and members near to the same one hang together."""

    def __init__(self, fps: np.ndarray, limit: int):
        self.fps, self.limit, self.index, self.label = fps, limit, GrayIndex(fps), np.arange(len(fps))

    def hang(self, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """An edge of each query that is near to a member."""
        for q, member in self.index.search(queries, self.limit):
            _, first, number = np.unique(q, return_index=True, return_inverse=True)
            one = member[first][number]
            apart = np.flatnonzero(self.label[member] != self.label[one])
            if len(apart):
                self.label = _join_up(self.label, member[apart], one[apart])
            a, b = queries[q[first]], self.fps[member[first]]
            yield a[a != b], b[a != b]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """The edges among the members themselves."""
        hung = np.flatnonzero(self.label != np.arange(len(self.label)))
        return self.fps[hung], self.fps[self.label[hung]]


# ---- links of all fingerprints

def _runs(*keys: np.ndarray) -> Iterator[slice]:
    """The runs of equal keys in sorted arrays."""
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    edges = [0, *np.flatnonzero(new).tolist(), len(new)]
    return (slice(a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a)


def route(fps: np.ndarray, own: np.ndarray, upper: GrayIndex, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(number in ``fps``, upper node) of the ranges where a fingerprint may
    have a near one: the nodes from its own one (``own``) on that the
    descent does not prune."""
    found = [(q[node >= own[q]], node[node >= own[q]]) for q, node in upper.search(fps, limit)]
    if not found:
        return np.array([], np.int64), np.array([], np.int64)
    return np.concatenate([q for q, _ in found]), np.concatenate([node for _, node in found])


def links(fps: DataFrame, max_bits: int = 3, group_rows: int = 2048, max_ranges: int = 4096) -> DataFrame:
    """Edges (a, b) over distinct fingerprints (column ``fp``) whose
    components are those of "at most ``max_bits`` bits apart"."""
    n = max(1, min(max_ranges, -(-fps.count() // group_rows)))
    ranged = stored(fps.select("fp").repartitionByRange(n, gray_rank_column(F.col("fp"))).withColumn(
        "range", F.spark_partition_id()), "ranges")
    # The upper nodes: a row a range, as many as the partitions above.
    nodes = ranged.groupBy("range").agg(F.bit_and("fp").alias("ones"), F.bit_or("fp").alias("any")).sort("range").collect()
    number = np.array([x["range"] for x in nodes], np.int64)
    ones, some = (np.array([x[k] for x in nodes], np.int64).view(np.uint64) for k in ("ones", "any"))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for all that goes from a batch to a range: side 0 are its
        members, once for each group of origins, side 1 what meets them."""
        upper = GrayIndex(ones, ~(ones ^ some))
        for batch in batches:
            x = batch["fp"].to_numpy(np.int64).view(np.uint64)
            own = np.searchsorted(number, batch["range"].to_numpy(np.int64))
            rows = []
            order = np.argsort(own, kind="stable")
            for at in _runs(own[order]):
                node = int(own[order[at.start]])
                rows += [(node, part, 0, x[order[at]].tobytes()) for part in range(node // ORIGINS + 1)]
            q, node = route(x, own, upper, max_bits)
            part = own[q] // ORIGINS
            order = np.lexsort((part, node))
            q, node, part = q[order], node[order], part[order]
            rows += [(int(node[at.start]), int(part[at.start]), 1, x[q[at]].tobytes()) for at in _runs(node, part)]
            yield pd.DataFrame(rows, columns=["node", "part", "side", "fps"])

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted: the members of a group, then what meets them."""
        key, held, members, edges = None, [], None, []
        for batch in batches:
            for node, part, side, raw in zip(*(batch[k] for k in ("node", "part", "side", "fps")), strict=True):
                if key != (node, part):
                    if members is not None:
                        edges.append(members.edges())
                    key, held, members = (node, part), [], None
                x = np.frombuffer(raw, np.uint64)
                if side == 0:
                    held.append(x)
                    continue
                if members is None:
                    members = Members(np.concatenate(held), max_bits)
                edges += members.hang(x)
            yield _edge_rows(edges)
            edges = []
        if members is not None:
            yield _edge_rows([members.edges()])

    keys = ["node", "part", "side"]
    sent = ranged.mapInPandas(send, "node int, part int, side int, fps binary")
    spread = sent.repartition(session_partitions(fps.sparkSession), "node", "part").sortWithinPartitions(*keys)
    return spread.mapInPandas(meet, "a bigint, b bigint")


def _edge_rows(edges: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    a, b = (np.concatenate([np.array([], np.uint64), *[e[i] for e in edges]]).view(np.int64) for i in (0, 1))
    return pd.DataFrame({"a": a, "b": b})


# ---- documents

def groups(fingerprinted: DataFrame, max_bits: int = 3, group_rows: int = 2048) -> DataFrame:
    """(fp, component) of every distinct value of column ``fp``; component
    is one fingerprint of the group of linked fingerprints."""
    distinct = stored(fingerprinted.select("fp").distinct(), "fingerprints")
    label = connected_components(links(distinct, max_bits, group_rows))
    return distinct.join(label, distinct["fp"] == label["node"], "left").select(
        "fp", F.coalesce("label", "fp").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3,
                    group_rows: int = 2048) -> DataFrame:
    """One row per document: its id, ``fingerprint`` (16 hexadecimal digits)
    and ``component_id``, the smallest id reachable over links."""
    rows = stored(docs.select(F.col(f"`{id_col}`").alias("id"), fingerprint_column(text_of(f"`{text_col}`"), shingle).alias("fp")),
                  "documents")
    found = stored(rows.groupBy("fp").agg(F.min("id").alias("first")).join(groups(rows, max_bits, group_rows), "fp"), "groups")
    named = stored(found.groupBy("component").agg(F.min("first").alias("component_id")), "names")
    named = found.join(named, "component").select("fp", "component_id")
    return rows.join(named, "fp").select(F.col("id").alias(id_col), hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3,
                group_rows: int = 2048) -> DataFrame:
    """The documents without near-duplicates: of each component the row with
    the smallest id stays (nulls last, then by a checksum of the row), with
    all its columns."""
    row_hash, verdict, of_id, of_hash = fresh(docs.columns, "row_hash", "verdict", "of_id", "of_hash")
    digest = F.xxhash64(*[_hashable(f.name, f.dataType) for f in docs.schema])
    rows = stored(docs.select(F.col(f"`{id_col}`").alias("id"), digest.alias("h"),
                              fingerprint_column(text_of(f"`{text_col}`"), shingle).alias("fp")), "documents")
    rows = stored(rows.join(groups(rows, max_bits, group_rows), "fp").groupBy("component", "id", "h").agg(
        F.count(F.lit(1)).alias("n")), "members")
    best = stored(rows.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("best")), "best")
    same = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("h") == F.col("best.h"))
    marked = rows.join(best, "component").select("id", "h", F.when(~same, "drop").when(F.col("n") > 1, "one").alias("verdict"))
    marked = stored(marked.filter("verdict is not null"), "verdicts").select(
        F.col("id").alias(of_id), F.col("h").alias(of_hash), F.col("verdict").alias(verdict))
    given = docs.withColumn(row_hash, digest)
    # One plan at every size: the verdicts grow with the corpus, so they are
    # shuffled and never broadcast.
    same_row = (F.col(row_hash) == F.col(of_hash)) & F.col(f"`{id_col}`").eqNullSafe(F.col(of_id))
    kept = given.join(marked.hint("merge"), same_row, "left")
    own = [F.col(f"`{c}`") for c in docs.columns]
    out = kept.filter(F.col(verdict).isNull()).select(*own)
    if not marked.filter(F.col(verdict) == "one").isEmpty():  # rows that repeat as a whole
        one = kept.filter(F.col(verdict) == "one").dropDuplicates([row_hash, of_id])
        out = out.unionByName(one.select(*own))
    return out


def _hashable(name: str, kind: T.DataType) -> Column:
    """The column as something Spark hashes: maps, also inside of other
    types, as their JSON text."""
    column = F.col(f"`{name}`")
    return F.to_json(F.struct(column.alias("v"))) if "map<" in kind.simpleString() else column
