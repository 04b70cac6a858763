"""Packing token sequences by the sum-of-squares rule.

A document's tokens are its ids and one end id.  Only documents longer than a
sequence are cut, and only their first piece is shorter than a sequence, so
full pieces are sequences already.  The others are packed by the
sum-of-squares rule (J. Csirik et al., "On the Sum-of-Squares Algorithm for
Bin Packing", 2006): with N(g) open sequences that have g tokens left, a piece
goes where the sum of N(g) squared becomes smallest.  That keeps the gaps
diverse, so that a piece that fills one exactly is likely to come.

Pieces are dealt at random into groups of about ``group_rows``, each packed in
a task of its own, the longest pieces first.  Sequences that a group leaves
with more than ``slack`` tokens open are unpacked, and their pieces packed
again with those of the other groups, level by level, until one group holds
all that is left or a level saves less than ``least_saved`` of the sequences
that it unpacked: pieces that fit nowhere stay in groups of that size.

Texts are tokenized once and never leave the scan: what is shuffled is a
piece's place, length and checksum.

Defined cases: a null text is empty and takes its end token only; rows that
repeat are packed one by one; a null id stays null; an empty table gives no
piece; further columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edspark.llm.bpe import encoder
from edspark.llm.common import stored, text_of

SEQUENCE, END = 1024, 2


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens."""
    first = n % size or min(n, size)
    return [(0, first)] + [(at, size) for at in range(first, n, size)]


def piece_column(text: Column, path: str, size: int = SEQUENCE, end: int = END) -> Column:
    """array of struct(start, length, ids_crc32), one for each piece."""
    end_bytes = np.array([end], "<u4").tobytes()

    @F.pandas_udf("array<struct<start:bigint,length:bigint,ids_crc32:bigint>>")
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for ids in encoder(path).encode(list(texts)):
                ids += end_bytes
                out.append([{"start": a, "length": n, "ids_crc32": zlib.crc32(ids[4 * a : 4 * (a + n)])}
                            for a, n in cuts(len(ids) // 4, size)])
            yield pd.Series(out)

    return pieces(text)


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence number, offset) of each piece, taken in the given order.
    Ties go to the smallest gap that is left, and there to the sequence that
    was touched last."""
    count = np.zeros(size + 1, np.int64)  # open sequences by gap
    open_: list[list[int]] = [[] for _ in range(size + 1)]
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made = 0
    for i, n in enumerate(lengths.tolist()):
        # Change of the sum, halved and less one: N(g - n) - N(g) for a gap g;
        # a sequence that becomes full leaves the sum (-N(g) - 1/2).
        change = np.where(count[n:] > 0, count[: size - n + 1] - count[n:], np.inf)
        if count[n]:
            change[0] = -count[n] - 0.5
        best = int(change.argmin())
        if change[best] < np.inf:
            gap = best + n
            at = open_[gap].pop()
            count[gap] -= 1
        else:
            gap, at = size, made
            made += 1
        sequence[i], offset[i] = at, size - gap
        if gap - n:
            open_[gap - n].append(at)
            count[gap - n] += 1
    return sequence, offset


def _packer(columns: list[str], level: int, last: bool, size: int, slack: int):
    """Function that packs one group of pieces; ``done`` marks the pieces of
    sequences that are not opened again."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "ids_crc32", "piece"], ascending=[False, True, True], kind="stable")
        rows = rows[columns].reset_index(drop=True)
        lengths = rows["length"].to_numpy()
        seq, offset = sum_of_squares(lengths, size)
        used = np.bincount(seq, weights=lengths, minlength=1)
        closed = np.full(len(rows), True) if last else used[seq] >= size - slack
        return rows.assign(sequence_id=(np.int64(level) << 56) + (np.int64(key[0]) << 24) + seq, offset=offset, done=closed)

    return one


_PACKED = "sequence_id bigint, offset bigint, done boolean"


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE, end: int = END,
         group_rows: int = 8192, slack: int = 4, least_saved: float = 0.01) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id and
    offset."""
    text = text_of(f"`{text_col}`")
    pieces = docs.select(F.col(f"`{id_col}`").alias("id"), F.posexplode(piece_column(text, path, size, end)).alias("piece", "p"))
    pieces = stored(pieces.select("id", "piece", "p.start", "p.length", "p.ids_crc32"), "pieces")
    full = pieces.filter(F.col("length") == size).withColumn(
        "sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("bigint"))
    done = [full]
    left = pieces.filter(F.col("length") < size)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", " + _PACKED
    columns = pieces.columns
    level, opened = 0, None
    while True:
        groups = -(-left.count() // group_rows)
        last = groups <= 1

        # The row's number in the written table deals equal rows apart.
        dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id(), "length", "ids_crc32"), F.lit(max(1, groups))).cast("bigint")
        packed = left.withColumn("group", dealt).groupBy("group").applyInPandas(_packer(columns, level, last, size, slack), schema)
        packed = stored(packed, "packed")
        # A sequence has one piece at its start.
        starts = packed.filter("offset = 0").agg(F.count(F.lit(1)).alias("made"), F.count(F.when(~F.col("done"), 1)).alias("open")).first()
        if last or opened is not None and starts["made"] > (1 - least_saved) * opened:
            done.append(packed.drop("done"))
            break
        done.append(packed.filter("done").drop("done"))
        left = packed.filter("not done").select(*columns)
        level, opened = level + 1, starts["open"]
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumnRenamed("id", id_col)
