"""Mixing sources by temperature.

The weight of a source is its share of all tokens to the power of an exponent
between 0 (all sources alike) and 1 (shares as they are), normalised.  The
exponent is bisected: the largest one whose weights have the target entropy,
or, where that would repeat some source more often than the limit, the
smallest one that keeps to the limit.  Five steps of the bisection cost one
small aggregate: all dyadic midpoints they may visit are evaluated together.

The weights are realised under a token budget as block permutations.  A
document's hash puts it in a block of its source.  An epoch of a source is its
blocks in a hashed order, and each block's documents in a hashed order; a
source's quota is whole epochs and a last one that ends where the quota does.
Which documents the last epoch reaches is settled by the blocks' token sums
and, in the one block it ends in, by the documents' hashes, so only that block
is ever sorted, however large a source is.

The block table has at most ``blocks`` rows and one more a source; it is
broadcast only if it is no larger than ``broadcast_rows`` (it is counted).

Defined cases: a null source is a source of its own; a document's size is its
words and one end token, so empty and null texts have size 1; rows that repeat
share a hash and are taken or left together; an empty table gives no row;
further columns pass through :func:`mixed` unchanged.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edspark.llm.common import WORD, stored

LEVELS, ROUNDS = 5, 6  # 30 steps of the bisection


@dataclass(frozen=True)
class Mixture:
    """``entropy``: target, as a share of the largest possible entropy;
    ``repeats``: most epochs of any source; ``budget``: tokens to realise, as
    a multiple of the input's."""

    entropy: float = 0.95
    repeats: float = 4.0
    budget: float = 1.0
    seed: str = "mix-1"
    blocks: int = 10_000
    block_tokens: int = 100_000
    broadcast_rows: int = 200_000


def _evaluate(shares: DataFrame, exponents: list[float]) -> dict[float, tuple[float, float]]:
    """exponent -> (entropy of the weights, largest weight over share)."""
    a, p = F.col("a"), F.col("p")
    rows = shares.select("p", F.explode(F.array(*[F.lit(float(x)) for x in exponents])).alias("a")).groupBy("a").agg(
        F.sum(F.pow(p, a)).alias("z"), F.sum(F.pow(p, a) * a * F.log(p)).alias("zl"),
        F.max(F.pow(p, a - 1)).alias("top")).collect()
    return {r["a"]: (math.log(r["z"]) - r["zl"] / r["z"], r["top"] / r["z"]) for r in rows}


def _bisect(shares: DataFrame, low_ok) -> float:
    """The point in [0, 1] where ``low_ok(entropy, repeats)`` turns from true
    to false as the exponent grows (its lower end)."""
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        step = (high - low) / (1 << LEVELS)
        found = _evaluate(shares, [low + step * i for i in range(1, 1 << LEVELS)])
        for _ in range(LEVELS):
            mid = (low + high) / 2
            low, high = (mid, high) if low_ok(*found[mid]) else (low, mid)
    return low


def exponent(totals: DataFrame, mix: Mixture) -> float:
    """The exponent for a table of sources with their ``tokens``."""
    total, n = totals.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    if not n:
        return 1.0
    shares = totals.select((F.col("tokens") / F.lit(total)).alias("p"))
    target = mix.entropy * math.log(n)
    ends = _evaluate(shares, [0.0, 1.0])
    found = 1.0 if ends[1.0][0] >= target else _bisect(shares, lambda h, _: h >= target)
    # Repeats fall as the exponent grows.
    if _evaluate(shares, [found])[found][1] * mix.budget > mix.repeats:
        found = 1.0 if ends[1.0][1] * mix.budget > mix.repeats else _bisect(
            shares, lambda _, top: top * mix.budget > mix.repeats) + 2.0 ** -(LEVELS * ROUNDS)
    return found


def _number(digest: Column) -> Column:
    """First 8 hexadecimal digits as a number."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc, source, size, key): the row as one struct beside its figures, so
    that no name of its columns can clash."""
    part = lambda c: F.col(f"doc.`{c}`")
    text = F.coalesce(part(text_col).cast("string"), F.lit(""))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")).select(
        "doc", part(id_col).alias("id"), part(source_col).cast("string").alias("source"),
        (F.regexp_count(text, F.lit(WORD)) + 1).cast("bigint").alias("size"),
        F.md5(F.concat(F.coalesce(part(id_col).cast("string"), F.lit("")), F.lit("|"), text).cast("binary")).alias("key"))


def epoch_hash(key: Column, epoch: Column, seed: str) -> Column:
    """Place of a document inside its block in an epoch."""
    return F.md5(F.concat(F.lit(f"{seed}|"), epoch.cast("string"), F.lit("|"), key).cast("binary"))


def plan(rows: DataFrame, mix: Mixture) -> tuple[DataFrame, DataFrame]:
    """Of a table (source, size, key), written once: the sources (source,
    docs, tokens, weight, quota, full epochs, n_blocks) and the blocks
    (source, block, tokens, full, cutoff).  A document is in the last epoch
    if its hash there is at most its block's cutoff (null: none of them)."""
    totals = stored(rows.groupBy("source").agg(F.sum("size").alias("tokens"), F.count(F.lit(1)).alias("docs")), "sources")
    a = exponent(totals, mix)
    total = totals.agg(F.sum("tokens")).first()[0] or 0
    z = totals.agg(F.sum(F.pow(F.col("tokens") / F.lit(max(total, 1)), F.lit(a)))).first()[0] or 1.0
    per_block = max(mix.block_tokens, -(-total // mix.blocks))
    sources = totals.withColumn("weight", F.pow(F.col("tokens") / F.lit(max(total, 1)), F.lit(a)) / F.lit(z))
    sources = sources.withColumn("quota", F.round(F.col("weight") * F.lit(mix.budget * total)).cast("bigint"))
    sources = sources.withColumn("full", F.floor(F.col("quota") / F.col("tokens")).cast("int")).withColumn(
        "n_blocks", F.ceil(F.col("tokens") / F.lit(per_block)).cast("bigint"))
    sources = stored(sources, "weights")
    placed = in_blocks(rows, sources, mix)
    blocks = placed.groupBy("source", "block").agg(F.sum("size").alias("tokens"), F.first("full").alias("full"),
                                                   (F.first("quota") - F.first("full") * F.first("source_tokens")).alias("rest"))
    order = F.md5(F.concat(F.lit(f"{mix.seed}|block|"), F.col("full").cast("string"), F.lit("|"),
                           F.col("block").cast("string")).cast("binary"))
    upto = Window.partitionBy("source").orderBy(order, "block").rowsBetween(Window.unboundedPreceding, 0)
    blocks = stored(blocks.withColumn("before", F.sum("tokens").over(upto) - F.col("tokens")), "blocks")
    # The block in which a source's last epoch ends is settled by hashes.
    ends = blocks.filter("before < rest and before + tokens > rest").select("source", "block", (F.col("rest") - F.col("before")).alias("room"))
    inside = _known(placed, ends, ["source", "block"], mix).withColumn("h", epoch_hash(F.col("key"), F.col("full"), mix.seed))
    upto = Window.partitionBy("source", "block").orderBy("h").rangeBetween(Window.unboundedPreceding, 0)
    cut = inside.withColumn("sum", F.sum("size").over(upto)).filter("sum <= room").groupBy("source", "block").agg(
        F.max("h").alias("cut"))
    b, c = blocks.alias("b"), cut.alias("c")
    blocks = b.join(c, F.col("b.source").eqNullSafe(F.col("c.source")) & (F.col("b.block") == F.col("c.block")), "left").select(
        "b.source", "b.block", "b.full", F.when(F.col("before") + F.col("tokens") <= F.col("rest"), F.lit("~")).otherwise(
            F.col("cut")).alias("cutoff"))
    return sources, stored(blocks, "decisions")


def _known(rows: DataFrame, table: DataFrame, keys: list[str], mix: Mixture) -> DataFrame:
    """Inner join on null-safe keys with a table that is broadcast if its
    counted size allows."""
    renamed = table.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in table.columns if c not in keys])
    if table.count() <= mix.broadcast_rows:
        renamed = F.broadcast(renamed)
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return rows.join(renamed, on).drop(*[f"__{k}" for k in keys])


def in_blocks(rows: DataFrame, sources: DataFrame, mix: Mixture) -> DataFrame:
    """Rows with their source's figures and their block."""
    figures = sources.select("source", "weight", "quota", "full", "n_blocks", F.col("tokens").alias("source_tokens"))
    return _known(rows, figures, ["source"], mix).withColumn("block", _number(F.col("key")) % F.col("n_blocks"))


def realise(docs: DataFrame, mix: Mixture = Mixture(), id_col: str = "doc_id", text_col: str = "text",
            source_col: str = "source") -> DataFrame:
    """One row for each occurrence of a document in the mixture: id, source,
    n_tokens, weight (of its source), epoch, block, and position: the place in
    its source's stream, gapless from 0."""
    rows = stored(_keyed(docs, id_col, text_col, source_col).drop("doc"), "sized")
    sources, blocks = plan(rows, mix)
    out = _occurrences(_known(in_blocks(rows, sources, mix), blocks.drop("full"), ["source", "block"], mix), mix)
    out = stored(out.select("id", "source", "size", "weight", "epoch", "block", "h"), "occurrences")
    counts = out.groupBy("source", "epoch", "block").agg(F.count(F.lit(1)).alias("n"))
    order = F.md5(F.concat(F.lit(f"{mix.seed}|block|"), F.col("epoch").cast("string"), F.lit("|"),
                           F.col("block").cast("string")).cast("binary"))
    upto = Window.partitionBy("source").orderBy("epoch", order, "block").rowsBetween(Window.unboundedPreceding, 0)
    first = counts.withColumn("first", F.sum("n").over(upto) - F.col("n")).drop("n")
    first = first.select(F.col("source").alias("s"), F.col("epoch").alias("e"), F.col("block").alias("k"), "first")
    rank = F.row_number().over(Window.partitionBy("source", "epoch", "block").orderBy("h", "id"))
    out = out.withColumn("rank", rank).join(
        first, F.col("source").eqNullSafe(F.col("s")) & (F.col("epoch") == F.col("e")) & (F.col("block") == F.col("k")))
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), F.col("size").alias("n_tokens"), "weight",
                      "epoch", "block", (F.col("first") + F.col("rank") - 1).cast("bigint").alias("position"))


def _occurrences(rows: DataFrame, mix: Mixture) -> DataFrame:
    """A row for each epoch that takes the document."""
    last = epoch_hash(F.col("key"), F.col("full"), mix.seed) <= F.col("cutoff")
    times = F.col("full") + F.when(last, F.lit(1)).otherwise(F.lit(0))
    epochs = F.when(times > 0, F.sequence(F.lit(0), times - 1)).otherwise(F.array().cast("array<int>"))
    return rows.withColumn("epoch", F.explode(epochs)).withColumn("h", epoch_hash(F.col("key"), F.col("epoch"), mix.seed))


def mixed(docs: DataFrame, mix: Mixture = Mixture(), id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source") -> DataFrame:
    """The documents of the mixture: each as often as its source's quota takes
    it, with all its columns.  Texts are not shuffled as long as the block
    table is small enough to broadcast."""
    given = _keyed(docs, id_col, text_col, source_col)
    sources, blocks = plan(stored(given.drop("doc"), "sized"), mix)
    out = _known(in_blocks(given.drop("id", "size"), sources, mix), blocks.drop("full"), ["source", "block"], mix)
    return _occurrences(out, mix).select("doc.*")
