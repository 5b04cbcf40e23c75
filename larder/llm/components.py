"""Connected components by alternating large-star and small-star steps.

Each step sends a node's neighbours to the smallest node near it.  A step is a grouped
minimum, combined before the shuffle, and a join back, which adaptive execution can
split where one node has very many neighbours.  Nothing is gathered on the driver but
a count and a checksum of the links, by which the end is seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(links: DataFrame) -> DataFrame:
    """From links (a, b) of orderable ids: one row (node, root) for each linked node that isn't its own root.

    ``root`` is the smallest node of the component.  Loops and repeated links are
    harmless; no links give no rows.
    """
    links = cut(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(links)
    while state[0]:
        links = cut(_small_star(_large_star(links)))
        if (now := _state(links)) == state:
            break
        state = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))


HOT = 1024
FEW = 1_000_000


def join_back(rows: DataFrame, few: DataFrame, keys: str | list[str], count: str, keep: bool = False) -> DataFrame:
    """``rows`` joined with ``few``, of which each key has one row; its column ``count`` says how many of the rows have the key.

    ``FEW`` keys at most are broadcast.  Of more, those that more than one in ``HOT`` of the rows have, so ``HOT`` keys at most, are
    broadcast, and their rows stay where they are; only the others are dealt out by key.  ``few`` is read several times and
    should be cut.  ``keep`` leaves the count in.
    """
    keys = [keys] if isinstance(keys, str) else keys
    n, total = few.agg(F.count("*"), F.sum(count)).first()
    drop = [] if keep else [count]
    if n <= FEW:
        return rows.join(F.broadcast(few.drop(*drop)), keys)
    often = F.col(count) * HOT > total
    hot = F.broadcast(few.where(often).drop(*drop))
    return rows.join(hot, keys).unionByName(rows.join(F.broadcast(few.where(often).select(*keys)), keys, "left_anti").join(few.where(~often).drop(*drop), keys))
