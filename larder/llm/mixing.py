"""Mixing sources to target weights with exact budgets.

Each document gets a hash-random key.  Sources are range-sorted by key: a leading part
of the key deals a source into blocks, block totals give each block's offset, and a
running sum inside the block completes the distributed prefix sum.  A source's budget
is met by whole epochs and one cut: documents before the cut are taken once more, the
one on it in part, so that a source's taken words are its rounded target exactly.

Defined results: a null text has no words and takes nothing; a null source is a source
of its own, last in order; equal keys and ids are ordered by size, and equal rows beyond
that are interchangeable; sources of no words have target 0; an empty table gives no rows.
Everything but the small table of sources is distributed; that table's rows are
numbered in one task, as there are few sources.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
BLOCK_DIGITS = 3  # at least: 4096 blocks of each source
BLOCK_ROWS = 100_000


def hash_key(id_col: Column, seed: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(id_col.cast("string"), F.lit("null"))))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row for each source: rank, weight, size and target.

    Targets are weight times a common level where that stays under ``max_epochs`` times
    the source's size, and that bound elsewhere.  Sorted by bound over weight, the sources
    that stop are a prefix, and the level follows from prefix sums: no iteration.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = totals.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("bound", F.lit(float(max_epochs)) * F.col("source_size"))
    fill = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    stops = F.col("bound") <= F.col("weight") * F.col("level")
    leveled = ranked.withColumn("level", level).withColumn("stops", stops)
    common = F.min(F.when(~F.col("stops"), F.struct((F.col("bound") / F.col("weight")).alias("at"), F.col("level")))).over(whole)["level"]
    target = F.when(F.col("stops"), F.col("bound")).otherwise(F.col("weight") * common)
    return leveled.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = "mix",
    weights: tuple = WEIGHTS,
    share: float = SHARE,
    max_epochs: int = MAX_EPOCHS,
    block_digits: int | None = None,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row for each document: id, source, size, source_size, target and taken words, and the columns ``carry``.

    ``block_digits`` hex digits of the key deal a source into blocks (16 to that power); by default so many
    that a block has about ``BLOCK_ROWS`` rows at most, were all rows of one source.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        hash_key(F.col(id_col), seed).alias("key"),
        F.struct(*carry, F.lit(0)).alias("carried"),
    )
    sizes = cut(rows.drop("carried"))
    if block_digits is None:
        block_digits = max(BLOCK_DIGITS, math.ceil(math.log(max(1, sizes.count() / BLOCK_ROWS), 16)))
    targets = source_targets(sizes, weights, share, max_epochs)
    block = F.substring("key", 1, block_digits)
    blocks = sizes.groupBy("source", block.alias("block")).agg(F.sum("size").alias("block_size"))
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        blocks.withColumn("offset", F.coalesce(F.sum("block_size").over(earlier), F.lit(0)))
        .join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .select(F.col("source").alias("s"), F.col("block").alias("b"), "offset", "source_size", "target")
    )
    every = rows if carry else sizes  # what is carried is shuffled once and never written
    dealt = every.withColumn("block", block).join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    inside = Window.partitionBy("source", "block").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    budget = F.round("target").cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("bigint")
    rest = budget - epochs * F.col("source_size")
    part = F.least(F.greatest(rest - start, F.lit(0)), F.col("size"))
    return dealt.withColumn("taken", (epochs * F.col("size") + part).cast("bigint")).select("doc_id", "source", "size", "source_size", "target", "taken", *(f"carried.{c}" for c in carry))
