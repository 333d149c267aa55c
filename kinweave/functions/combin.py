"""Combinations in colexicographic order: ranks, unranking, iteration."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def binomial(n: int, k: int) -> int:
    return math.comb(n, k) if 0 <= k <= n else 0


def rank_combination(c: tuple[int, ...] | list[int]) -> int:
    return sum(binomial(x, i + 1) for i, x in enumerate(sorted(c)))


def unrank_combination(position: int, k: int) -> tuple[int, ...]:
    """The k numbers with sum of binomials equal to position, the largest first found by bisection."""
    out = []
    for i in range(k, 0, -1):
        low, high = i - 1, i
        while binomial(high, i) <= position:
            low, high = high, 2 * high
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if binomial(mid, i) <= position else (low, mid)
        out.append(low)
        position -= binomial(low, i)
    return tuple(reversed(out))


def next_combination(c: tuple[int, ...]) -> tuple[int, ...]:
    """The successor: the first element that can move up by one does, those before it start over."""
    for i, x in enumerate(c):
        if i + 1 == len(c) or x + 1 < c[i + 1]:
            return (*range(i), x + 1, *c[i + 1 :])
    return ()


def combinations_from(position: int, k: int, step: int = 1) -> Iterator[tuple[int, ...]]:
    """Every step-th combination, as one of ``step`` workers takes them."""
    c = unrank_combination(position, k)
    while True:
        yield c
        if step == 1:
            c = next_combination(c)
        else:
            position += step
            c = unrank_combination(position, k)


def rank_pair(low: Column, high: Column) -> Column:
    """Position of low < high."""
    low, high = low.cast("long"), high.cast("long")
    return F.shiftright(high * (high - 1), 1) + low


def unrank_pair(position: Column) -> tuple[Column, Column]:
    """(low, high) of a position; the root's rounding is put right in whole numbers."""
    position = position.cast("long")
    guess = F.floor((F.sqrt(position.cast("double") * 8 + 1) + 1) / 2).cast("long")
    below = lambda x: F.shiftright(x * (x - 1), 1)
    high = F.when(below(guess) > position, guess - 1).when(below(guess + 1) <= position, guess + 1).otherwise(guess)
    return position - below(high), high


def all_pairs(spark: SparkSession, n: int, limit: int | None = None) -> DataFrame:
    """pos, id1, id2 for the first ``limit`` pairs of 0..n-1: numbers, spread over the cluster, unranked where they are used."""
    total = binomial(n, 2)
    low, high = unrank_pair(F.col("id"))
    return spark.range(total if limit is None else min(limit, total)).select(F.col("id").alias("pos"), low.alias("id1"), high.alias("id2"))


def pair_owner(low: Column, high: Column, workers: int) -> Column:
    return F.pmod(rank_pair(low, high), F.lit(workers))
