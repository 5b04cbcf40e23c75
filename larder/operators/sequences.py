"""Sequence operators of tokens and parts as relational plans: context, runs, repeats, stop words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.literals import array_of


def with_context(tokens: DataFrame, by: str, place: str, value: str, reach: int = 3) -> DataFrame:
    """Adds prev_1 … and next_1 … up to ``reach`` places away within each ``by``."""
    w = Window.partitionBy(by).orderBy(place)
    more = {f"prev_{k}": F.lag(value, k).over(w) for k in range(1, reach + 1)} | {f"next_{k}": F.lead(value, k).over(w) for k in range(1, reach + 1)}
    return tokens.withColumns(more)


BLOCK = 1 << 16


def consecutive_runs(df: DataFrame, by: str, value: str, block: int = BLOCK) -> DataFrame:
    """(by, first, last, n): runs of neighbouring whole numbers; repeated ones count once.

    Numbers are dealt out by ``by`` and blocks of ``block`` numbers, so that few values of ``by`` don't make few tasks; only runs
    that touch a block's edge, two for each block at most, meet again by ``by`` and are joined.
    """
    cell = F.floor(F.col(value) / block).cast("bigint")
    numbers = df.select(by, F.col(value).cast("bigint").alias(value)).distinct().withColumn("cell", cell)
    island = F.col(value) - F.row_number().over(Window.partitionBy(by, "cell").orderBy(value))
    runs = numbers.withColumn("island", island).groupBy(by, "cell", "island").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count("*").alias("n"))
    at_edge = (F.col("first") == F.col("cell") * block) | (F.col("last") == F.col("cell") * block + block - 1)
    order = Window.partitionBy(by).orderBy("first")
    fresh = F.coalesce(F.col("first") != F.lag("last").over(order) + 1, F.lit(True))
    joined = runs.where(at_edge).withColumn("fresh", fresh).withColumn("run", F.sum(F.col("fresh").cast("int")).over(order))
    joined = joined.groupBy(by, "run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    return runs.where(~at_edge).select(by, "first", "last", "n").unionByName(joined.drop("run"))


def last_of_repeats(parts: Column) -> Column:
    """The parts that differ from the one behind them; an empty last part goes."""
    return F.filter(parts, lambda x, i: x != F.coalesce(F.get(parts, i + 1), F.lit("")))


def fix_punctuation(text: Column) -> Column:
    text = F.replace(F.replace(F.replace(text, F.lit("( "), F.lit("(")), F.lit(" )"), F.lit(")")), F.lit(" / "), F.lit("/"))
    return F.trim(F.regexp_replace(text, r" ([,:;.!?*])", "$1"))


def is_stop_word(token: Column) -> Column:
    return F.array_contains(array_of(sorted(L.STOP_WORDS)), F.lower(token))


def match_labels(labels: Column, pattern: list[str], ignore_others: bool = True) -> Column:
    """Places (from 0) of stretches of labels that equal the pattern: each label is one character for the JVM's regex engine."""
    letters = {label: chr(0x41 + i) for i, label in enumerate(dict.fromkeys(pattern))}
    code = F.create_map(*[F.lit(x) for kv in letters.items() for x in kv])
    coded = F.transform(labels, lambda x, i: F.struct(F.coalesce(F.try_element_at(code, x), F.lit("_")).alias("c"), i.alias("i")))
    used = F.filter(coded, lambda x: x["c"] != "_") if ignore_others else coded
    text = F.array_join(F.transform(used, lambda x: x["c"]), "")
    wanted = "".join(letters[p] for p in pattern)
    before = F.split(text, wanted, -1)
    starts = F.transform(
        F.sequence(F.lit(1), F.size(before) - 1),
        lambda k: F.aggregate(F.slice(before, 1, k), F.lit(0), lambda s, x: s + F.length(x)) + (k - 1) * len(pattern),
    )
    return F.when(F.size(before) > 1, F.transform(starts, lambda s: F.transform(F.slice(used, s + 1, len(pattern)), lambda x: x["i"]))).otherwise(F.array().cast("array<array<int>>"))
