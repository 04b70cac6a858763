"""Exact nearest neighbours by a block matrix join with int8 tiles.

Nearness is the inner product in double precision.  Every vector x is held as
``scale * codes + rest`` with codes of one byte; the norms of ``rest`` and of x
bound how far the product of codes can be off.

1. Equal vectors count as one, with their smallest ``k + 1`` ids; none of the
   others can be among k nearest that are ordered by id on ties.
2. Queries and candidates are gathered into blocks of bounded size, and each
   query block meets each candidate block: a tile.  Only codes, scales and
   norms travel.  In a tile, a candidate survives for a query if its upper
   bound reaches the (k + 1)-th best lower bound.
3. Over all tiles the (k + 1)-th best lower bound of a query is found again,
   which leaves little more than the k nearest; only these pairs are joined to
   the original vectors, multiplied in double precision and merged by a heap.

No candidate is dropped unless the bounds prove that it can't be among the k.

Defined cases: vectors that are null, zero or hold null or non-finite
components take no part, nor do rows with a null id; an id that repeats counts
once, with its smallest vector; vectors meet only those of their own length; a
query with fewer than k candidates gets all; an empty table gives no row;
further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edspark.llm.common import session_partitions, stored

EXACT_DIMS = 1024  # 127 * 127 * 1024 stays below 2 ** 24: sums of products are exact in float32
SLACK = 1e-9  # for the rounding of the bounds themselves


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scale, norm, norm of what the codes leave) by row."""
    x = x.astype(np.float64)
    scale = np.maximum(np.abs(x).max(axis=1) / 127, np.finfo(np.float64).tiny)
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    rest = x - codes * scale[:, None]
    return codes, scale, np.sqrt((x * x).sum(axis=1)), np.sqrt((rest * rest).sum(axis=1))


def tile_bounds(q: tuple, c: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of all inner products of two quantised blocks."""
    (qc, qs, qn, qr), (cc, cs, cn, cr) = q, c
    dot = np.zeros((len(qc), len(cc)))
    for at in range(0, qc.shape[1], EXACT_DIMS):
        dot += qc[:, at:at + EXACT_DIMS].astype(np.float32) @ cc[:, at:at + EXACT_DIMS].astype(np.float32).T
    dot *= qs[:, None] * cs[None, :]
    # x.y - (x - rx).(y - ry) = (x - rx).ry + rx.y
    off = (qn + qr)[:, None] * cr[None, :] + qr[:, None] * cn[None, :] + SLACK * qn[:, None] * cn[None, :]
    return dot - off, dot + off


def _blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """(dim, block, ids, codes, figures): bounded groups of vectors, dealt by
    the id's hash, as bytes."""
    sizes = vectors.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / F.lit(rows)).alias("blocks"))
    dealt = vectors.join(sizes, "dim").withColumn("block", F.pmod(F.xxhash64("first"), F.col("blocks")))

    def gather(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        codes, scale, norm, rest = quantise(np.stack(part["vector"].to_list()))
        return pd.DataFrame({"dim": [key[0]], "block": [key[1]], "ids": [part["first"].to_numpy(np.int64).tobytes()],
                             "codes": [codes.tobytes()], "figures": [np.stack([scale, norm, rest]).tobytes()]})

    return dealt.select("dim", "block", "first", "vector").groupBy("dim", "block").applyInPandas(
        gather, "dim int, block long, ids binary, codes binary, figures binary")


def _unpack(dim: int, ids: bytes, codes: bytes, figures: bytes) -> tuple[np.ndarray, tuple]:
    i = np.frombuffer(ids, np.int64)
    return i, (np.frombuffer(codes, np.int8).reshape(len(i), dim), *np.frombuffer(figures, np.float64).reshape(3, len(i)))


class _Cell:
    """One query block on its way along a run of candidate blocks: the
    ``keep`` best lower bounds of each query so far, and the pairs whose upper
    bounds reach the last of them."""

    def __init__(self, ids: np.ndarray, block: tuple, keep: int):
        self.ids, self.block, self.keep = ids, block, keep
        self.top = np.full((len(ids), keep), -np.inf)
        self.pairs = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]

    def meet(self, ids: np.ndarray, block: tuple) -> None:
        found = [[x] for x in self.pairs]
        for at in range(0, len(self.ids), 256):
            low, high = tile_bounds(tuple(x[at:at + 256] for x in self.block), block)
            m = min(self.keep, low.shape[1])
            both = np.concatenate([self.top[at:at + 256], np.partition(low, -m, axis=1)[:, -m:]], axis=1)
            self.top[at:at + 256] = np.partition(both, -self.keep, axis=1)[:, -self.keep:]
            row, col = np.nonzero(high >= self.top[at:at + 256].min(axis=1)[:, None])
            for out, x in zip(found, (at + row, ids[col], low[row, col], high[row, col]), strict=True):
                out.append(x)
        query, candidate, low, high = (np.concatenate(x) for x in found)
        still = high >= self.top.min(axis=1)[query]
        self.pairs = [x[still] for x in (query, candidate, low, high)]

    def rows(self) -> pd.DataFrame:
        query, candidate, low, high = self.pairs
        return pd.DataFrame({"query": self.ids[query], "candidate": candidate, "low": low, "high": high})


def _survivors(tiles: DataFrame, keep: int) -> DataFrame:
    """(query, candidate, low, high) of the pairs that a run of tiles can't
    rule out.  Tiles come sorted by (dim, q_block, run); only the bounds that
    still count are carried from tile to tile."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, at = None, None
        for batch in batches:
            for t in batch.itertuples():
                if (t.dim, t.q_block, t.run) != at:
                    if cell:
                        yield cell.rows()
                    at, cell = (t.dim, t.q_block, t.run), _Cell(*_unpack(t.dim, t.q_ids, t.q_codes, t.q_figures), keep)
                cell.meet(*_unpack(t.dim, t.ids, t.codes, t.figures))
        if cell:
            yield cell.rows()

    return tiles.mapInPandas(search, "query long, candidate long, low double, high double")


def _merge(pairs: DataFrame, keep: int, partitions: int) -> DataFrame:
    """Of (query, candidate_ids, a, b): the ``keep`` nearest ids of each
    query vector."""
    pairs = pairs.repartition(partitions, "query").sortWithinPartitions("query")

    def best(rows: pd.DataFrame) -> pd.DataFrame:
        products = np.stack(rows["a"].to_list()).astype(np.float64) * np.stack(rows["b"].to_list()).astype(np.float64)
        score = np.cumsum(products, axis=1)[:, -1]  # added up from the first component to the last
        near = heapq.nsmallest(keep, ((-s, i) for s, ids in zip(score.tolist(), rows["candidate_ids"], strict=True) for i in ids))
        return pd.DataFrame({"query": rows["query"].iloc[0], "vec_id": [i for _, i in near], "score": [-s for s, _ in near]})

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Queries come sorted; the last of a batch waits for the next."""
        rest = None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if len(rest):
                last = rest["query"].to_numpy() == rest["query"].iloc[-1]
                for _, rows in rest[~last].groupby("query"):
                    yield best(rows)
                rest = rest[last]
        if rest is not None and len(rest):
            yield best(rest)

    return pairs.mapInPandas(merge, "query long, vec_id long, score double")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
            query_rows: int = 1024, candidate_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest of every row for
    which ``is_query`` (over a column ``id``) holds, among all rows but its
    own."""
    spark = vectors.sparkSession
    v = F.col("vector")
    given = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{vector_col}`").alias("vector"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    given = given.filter(F.col("id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    given = stored(given.groupBy("id").agg(F.min("vector").alias("vector")), "vectors")
    place = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    few = given.withColumn("place", place).filter(F.col("place") <= k + 1).groupBy("vector").agg(
        F.sort_array(F.collect_list("id")).alias("ids"))
    few = stored(few.select(F.col("ids")[0].alias("first"), F.size("vector").alias("dim"), "vector", "ids"), "candidates")
    # Queries of one vector are answered together.
    queries = stored(given.filter(is_query).join(few.select("vector", "first"), "vector").select("id", "first"), "queries")
    asked = stored(few.join(queries.select("first").distinct(), "first").select("first", "dim", "vector"), "asked")
    q, c = _blocks(asked, query_rows), stored(_blocks(few.drop("ids"), candidate_rows), "blocks")
    q = stored(q.select("dim", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("codes").alias("q_codes"),
                        F.col("figures").alias("q_figures")), "query-blocks")
    # Each query block meets each candidate block of its length, in runs: as
    # many as give every task some, so that what a query leaves behind does
    # not grow with the number of candidate blocks.
    n = session_partitions(spark)
    cells = q.select("dim", "q_block").join(c.select("dim", "block"), "dim")
    runs = max(1, -(-2 * n // max(1, q.count())))
    cells = cells.withColumn("run", F.pmod(F.col("block"), F.lit(runs)))
    tiles = cells.join(q, ["dim", "q_block"]).join(c, ["dim", "block"])
    tiles = tiles.repartition(n, "dim", "q_block", "run").sortWithinPartitions("dim", "q_block", "run")
    near = stored(_survivors(tiles, k + 1), "survivors")
    top = near.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("low")))).filter(F.col("r") == k + 1)
    near = near.join(top.select("query", F.col("low").alias("bar")), "query", "left").filter(
        F.col("bar").isNull() | (F.col("high") >= F.col("bar"))).select("query", "candidate")
    pairs = near.join(asked.select(F.col("first").alias("query"), F.col("vector").alias("a")), "query").join(
        few.select(F.col("first").alias("candidate"), F.col("ids").alias("candidate_ids"), F.col("vector").alias("b")), "candidate")
    found = _merge(pairs, k + 1, session_partitions(spark))
    own = queries.join(found, F.col("first") == F.col("query")).filter(F.col("id") != F.col("vec_id"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "vec_id"))
    return own.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("id").alias("query_id"), "rank", "vec_id", "score")
