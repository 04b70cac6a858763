"""Hard negatives by an STR-packed R-tree.

Components are integers (``floor(scale * x)``), so inner products are exact.

1. Rows of one label and equal codes are one point with its smallest ids:
   none of the others can be among the first few, as ties go to smaller ids.
2. Sort-tile-recursive packing: points are numbered by their first code and
   cut into slabs, each slab is numbered by the second code and cut into
   tiles of bounded size, and inside a tile the recursion goes on over the
   further codes, those of largest spread first, down to leaves.  Every node
   holds its box: the least and largest code of each component.
3. Anchors meet tiles in cells: a chunk of anchors and a run of a few tiles.
   For a box, each component gives an interval of products; their sums are
   bounds of all inner products in it.  A best-first queue takes the box of
   highest bound next and prunes boxes strictly below the last place held so
   far (a tie may still win by its smaller id) or, for negatives, outside all
   score windows of the anchor.
4. What the cells leave, a few points per anchor and run, is merged: first
   for the positives, whose scores give the windows, then for the negatives.

Defined cases: rows with a null id, a null label, a null vector, or any null
or non-finite component take no part; an id that repeats counts once, with
its smallest label, then vector; vectors meet those of their own length only
(empty ones have product 0); codes and scores outside the range of a long are
held at its ends; an anchor without a positive, or a positive without a
negative in its window, has no row; an empty table gives no row; further
columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edspark.llm.common import session_partitions, stored
from edspark.operators.sequence import ordered_sequence

LEAF, FAN_OUT = 256, 8
LONG_MAX = (1 << 63) - 1


# ---- the tree of one tile

def _str_order(codes: np.ndarray, members: np.ndarray, dims: list[int]) -> Iterator[np.ndarray]:
    """Leaves of sort-tile-recursive packing: sort by the first of ``dims``,
    cut into slabs, and go on in each with the rest."""
    leaves = -(-len(members) // LEAF)
    if leaves <= 1 or not dims:
        for at in range(0, len(members), LEAF):
            yield members[at:at + LEAF]
        return
    slabs = max(2, round(leaves ** (1 / len(dims))))
    rows = -(-leaves // slabs) * LEAF
    members = members[np.argsort(codes[members, dims[0]], kind="stable")]
    for at in range(0, len(members), rows):
        yield from _str_order(codes, members[at:at + rows], dims[1:])


class RTree:
    """Boxes over the rows of ``codes`` (integers).  Node numbers run from the
    leaves up; ``children`` of a leaf are rows, of others are nodes."""

    def __init__(self, codes: np.ndarray, labels: np.ndarray, points: np.ndarray):
        self.codes, self.labels, self.points = codes, labels, points
        spread = np.argsort(-(codes.max(axis=0).astype(float) - codes.min(axis=0).astype(float)), kind="stable") if len(codes) else []
        # As many components as the packing can halve.
        depth = max(1, int(np.ceil(np.log2(max(2, -(-len(codes) // LEAF))))))
        self.children = list(_str_order(codes, np.arange(len(codes)), [int(d) for d in spread[:depth]]))
        low = [codes[m].min(axis=0) for m in self.children]
        high = [codes[m].max(axis=0) for m in self.children]
        self.leaves = len(self.children)
        level = range(self.leaves)
        while len(level) > 1:
            above = []
            for at in range(0, len(level), FAN_OUT):
                nodes = np.array(level[at:at + FAN_OUT])
                above.append(len(self.children))
                self.children.append(nodes)
                low.append(np.min([low[i] for i in nodes], axis=0))
                high.append(np.max([high[i] for i in nodes], axis=0))
            level = above
        self.root = len(self.children) - 1
        self.low, self.high = np.array(low), np.array(high)

    def bounds(self, query: tuple, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest inner product that the nodes' boxes allow."""
        up, down = query[1], query[2]  # positive and negative part
        low, high = self.low[nodes], self.high[nodes]
        return _as_long(low @ up + high @ down), _as_long(high @ up + low @ down)

    def scores(self, query: tuple, rows: np.ndarray) -> np.ndarray:
        return _as_long(self.codes[rows] @ query[0])


def _as_long(x: np.ndarray) -> np.ndarray:
    return np.clip(x, -LONG_MAX - 1, LONG_MAX) if x.dtype == object else x


def _number_type(*codes: np.ndarray) -> type:
    """Doubles if all sums of products stay below 2 ** 53, where they are
    exact, else Python integers."""
    top = max((float(np.abs(c.astype(float)).max()) for c in codes if c.size), default=0.0)
    return float if top * top * max(1, codes[0].shape[1]) < 1 << 52 else object


def _query(vector: np.ndarray) -> tuple:
    return vector, np.maximum(vector, 0), np.minimum(vector, 0)


class _Best:
    """The first ``keep`` (score, point) by falling score, then point."""

    def __init__(self, keep: int):
        self.keep, self.rows = keep, []

    def last(self):
        return self.rows[-1][0] if len(self.rows) == self.keep else None

    def add(self, scores: np.ndarray, points: np.ndarray) -> None:
        more = [(s, p) for s, p in zip(scores.tolist(), points.tolist(), strict=True)]
        self.rows = heapq.nsmallest(self.keep, self.rows + more, key=lambda x: (-x[0], x[1]))


def positives(trees: list[RTree], vector: np.ndarray, label: int, keep: int) -> list[tuple]:
    """The first ``keep`` points of the same label, best first."""
    query, best, queue = _query(vector), _Best(keep), []
    for t, tree in enumerate(trees):
        heapq.heappush(queue, (-tree.bounds(query, np.array([tree.root]))[1][0], t, tree.root))
    while queue:
        bound, t, node = heapq.heappop(queue)
        if best.last() is not None and -bound < best.last():
            break  # strictly below the last place, as are all others in the queue
        tree, members = trees[t], trees[t].children[node]
        if node >= tree.leaves:
            for high, child in zip(tree.bounds(query, members)[1].tolist(), members.tolist(), strict=True):
                if best.last() is None or high >= best.last():
                    heapq.heappush(queue, (-high, t, child))
            continue
        rows = members[tree.labels[members] == label]
        if len(rows):
            s = tree.scores(query, rows)
            keep_at = np.ones(len(rows), bool) if best.last() is None else (s >= best.last()).astype(bool)
            best.add(s[keep_at], tree.points[rows[keep_at]])
    return best.rows


def negatives(trees: list[RTree], vector: np.ndarray, label: int, tops: list[int], share: int, keep: int) -> dict[int, list[tuple]]:
    """For each positive score in ``tops``: the first ``keep`` points of
    another label with share % of it <= score <= it."""
    query, best, queue = _query(vector), {top: _Best(keep) for top in tops}, []

    def wanted(low: float, high: float) -> bool:
        for top, b in best.items():
            if low <= top and 100 * high >= share * top and (b.last() is None or high >= b.last()):
                return True
        return False

    ceiling = max(tops, default=0)
    for t, tree in enumerate(trees):
        low, high = (x[0] for x in tree.bounds(query, np.array([tree.root])))
        if wanted(low, high):
            heapq.heappush(queue, (-min(high, ceiling), t, tree.root, low, high))
    while queue:
        _, t, node, low, high = heapq.heappop(queue)
        if not wanted(low, high):
            continue
        tree, members = trees[t], trees[t].children[node]
        if node >= tree.leaves:
            lows, highs = tree.bounds(query, members)
            for low, high, child in zip(lows.tolist(), highs.tolist(), members.tolist(), strict=True):
                if wanted(low, high):
                    heapq.heappush(queue, (-min(high, ceiling), t, child, low, high))
            continue
        rows = members[tree.labels[members] != label]
        s = tree.scores(query, rows)
        for top, b in best.items():
            at = (s <= top) & (100 * s >= share * top)
            if b.last() is not None:
                at &= s >= b.last()
            at = at.astype(bool)
            if at.any():
                b.add(s[at], tree.points[rows[at]])
    return {top: b.rows for top, b in best.items()}


# ---- points, tiles and cells

def points_of(vectors: DataFrame, is_anchor: Column, keep: int, scale: int, id_col: str, label_col: str,
              vector_col: str) -> tuple[DataFrame, DataFrame]:
    """(point, dim, label, codes, ids) and the anchors (id, point); a point is
    named by its smallest id and keeps its ``keep`` smallest."""
    v = F.col("vector")
    rows = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{label_col}`").cast("bigint").alias("label"),
                          F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & finite)
    rows = rows.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("r"))
    rows = stored(rows.select("id", "r.label", F.transform("r.vector", lambda x: F.floor(x * scale)).alias("codes")), "vectors")
    place = F.row_number().over(Window.partitionBy("codes", "label").orderBy("id"))
    points = rows.withColumn("place", place).filter(F.col("place") <= keep).groupBy("codes", "label").agg(
        F.sort_array(F.collect_list("id")).alias("ids"))
    points = stored(points.select(F.col("ids")[0].alias("point"), F.size("codes").alias("dim"), "label", "codes", "ids"), "points")
    anchors = rows.filter(is_anchor).join(points.select("codes", "label", "point"), ["codes", "label"]).select("id", "point")
    return points, stored(anchors, "anchors")


def tiles_of(points: DataFrame, tile_rows: int) -> DataFrame:
    """The points with ``tile``: cut by the first code into slabs, and each
    slab by the second into tiles of ``tile_rows``."""
    sizes = points.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    slab_rows = F.ceil(F.sqrt(F.col("n") / tile_rows)).cast("bigint") * tile_rows
    sizes = sizes.select(F.col("dim").alias("of"), slab_rows.alias("slab_rows"))
    keyed = points.select("point", "dim", F.get("codes", F.lit(0)).alias("x"), F.get("codes", F.lit(1)).alias("y"))
    keyed = ordered_sequence(keyed, [F.col("x").asc_nulls_first(), "point"], ["dim"], "place")
    keyed = keyed.join(sizes, keyed["dim"] == sizes["of"]).withColumn("slab", F.floor((F.col("place") - 1) / F.col("slab_rows")))
    y = F.row_number().over(Window.partitionBy("dim", "slab").orderBy("y", "point"))
    per_slab = (F.col("slab_rows") / tile_rows).cast("bigint")
    tile = F.col("slab") * per_slab + F.floor((y - 1) / tile_rows)
    placed = keyed.select(F.col("point").alias("named"), tile.cast("bigint").alias("tile"))
    return points.join(placed, F.col("point") == F.col("named")).drop("named")


def _numbers(queries: pd.DataFrame, tiles: pd.DataFrame) -> tuple[list[np.ndarray], list[RTree]]:
    """A cell's anchors and the trees of its tiles, in numbers whose products
    are exact."""
    if not len(queries) or not len(tiles):
        return [], []
    asked, held = np.stack(queries["codes"].to_list()), np.stack(tiles["codes"].to_list())
    kind = _number_type(asked, held)
    asked, held = asked.astype(np.int64).astype(kind), held.astype(np.int64).astype(kind)
    tile, label, point = (tiles[c].to_numpy(np.int64) for c in ("tile", "label", "point"))
    return list(asked), [RTree(held[tile == t], label[tile == t], point[tile == t]) for t in np.unique(tile)]


def _cells(asked: DataFrame, tiled: DataFrame, search, schema: str, chunk_rows: int, run_tiles: int, partitions: int) -> DataFrame:
    """``search`` for every chunk of anchors and run of tiles of their
    length.  Either side is copied once per chunk or run of the other, and a
    cell holds a bounded number of rows."""
    runs = tiled.groupBy("dim").agg((F.floor(F.max("tile") / run_tiles) + 1).alias("runs"))
    chunks = asked.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / chunk_rows).cast("bigint").alias("chunks"))
    grid = stored(runs.join(chunks, "dim"), "grid")
    count = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    left = asked.join(grid, "dim").withColumn("chunk", F.pmod(F.xxhash64("point"), F.col("chunks"))).withColumn("run", count("runs"))
    right = tiled.join(grid, "dim").withColumn("run", F.floor(F.col("tile") / run_tiles)).withColumn("chunk", count("chunks"))
    keys = ["dim", "chunk", "run"]
    left, right = left.drop("runs", "chunks"), right.select(*keys, "tile", "point", "label", "codes")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, schema)


def mine(vectors: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 5, share: int = 80, scale: int = 256,
         id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", tile_rows: int = 2048,
         chunk_rows: int = 4096, run_tiles: int = 4) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score) for every row for which ``is_anchor`` (over a column
    ``id``) holds."""
    n = session_partitions(vectors.sparkSession)
    few = max(n_positives, n_negatives) + 1
    points, anchors = points_of(vectors, is_anchor, few, scale, id_col, label_col, vector_col)
    tiled = stored(tiles_of(points, tile_rows).drop("ids"), "tiles")
    asked = stored(points.join(anchors.select("point").distinct(), "point").select("dim", "point", "label", "codes"), "asked")
    ids = points.select(F.col("point").alias("found"), "ids")

    def near(queries: pd.DataFrame, tiles: pd.DataFrame) -> pd.DataFrame:
        (vectors, trees), out = _numbers(queries, tiles), []
        for point, label, vector in zip(queries["point"], queries["label"], vectors):  # noqa: B905 - no vectors without tiles
            out += [(point, p, int(s)) for s, p in positives(trees, vector, label, few)]
        return pd.DataFrame(out, columns=["query", "found", "score"])

    found = _cells(asked, tiled, near, "query bigint, found bigint, score bigint", chunk_rows, run_tiles, n)
    first = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    rows = found.join(ids, "found").select("query", "score", F.explode("ids").alias("id")).withColumn("r", F.row_number().over(first))
    rows = rows.filter(F.col("r") <= n_positives + 1).groupBy("query").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("score").cast("decimal(20,0)")).alias("less"), "id", "score"))).alias("best"))
    rows = stored(rows, "positives")
    # Each anchor is left out of its own list; the scores that are left are its windows.
    own = anchors.join(rows, F.col("point") == F.col("query")).select(
        "id", "point", F.slice(F.filter("best", lambda x: x["id"] != F.col("id")), 1, n_positives).alias("best"))
    own = stored(own.select(F.col("id").alias("anchor_id"), "point", F.explode("best").alias("p")).select(
        "anchor_id", "point", F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score")), "pairs")
    tops = own.groupBy("point").agg(F.sort_array(F.collect_set("positive_score")).alias("tops"))
    windows = stored(asked.join(tops, "point"), "windows")

    def hard(queries: pd.DataFrame, tiles: pd.DataFrame) -> pd.DataFrame:
        (vectors, trees), out = _numbers(queries, tiles), []
        for point, label, tops, vector in zip(queries["point"], queries["label"], queries["tops"], vectors):  # noqa: B905
            for top, best in negatives(trees, vector, label, [int(t) for t in tops], share, n_negatives).items():
                out += [(point, top, p, int(s)) for s, p in best]
        return pd.DataFrame(out, columns=["query", "top", "found", "score"])

    found = _cells(windows, tiled, hard, "query bigint, top bigint, found bigint, score bigint", chunk_rows, run_tiles, n)
    first = Window.partitionBy("query", "top").orderBy(F.desc("score"), "id")
    rows = found.join(ids, "found").select("query", "top", "score", F.explode("ids").alias("id")).withColumn("rank", F.row_number().over(first))
    rows = stored(rows.filter(F.col("rank") <= n_negatives), "negatives")
    return own.join(rows, (F.col("point") == F.col("query")) & (F.col("positive_score") == F.col("top"))).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
