"""k-mers as numbers over an alphabet, filters on k-mers, left characters."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Letters, then the sentinels for begin and end.
ALPHABET = LETTERS + ":;"
BEGIN, END = ":", ";"
_LONG_MAX = (1 << 63) - 1


def powz(base: int, exponent: int) -> int:
    """An integer power that must fit a signed 64-bit number."""
    value = base**exponent
    if value > _LONG_MAX:
        raise OverflowError(f"{base}^{exponent} doesn't fit 64 bits")
    return value


def bucket_index(kmer: Column, k: int, alphabet: str = ALPHABET) -> Column:
    """The k-mer as a number, first character most significant; null if it has a character outside the alphabet."""
    powz(len(alphabet), k)
    total = F.lit(0).cast("long")
    for i in range(1, k + 1):
        digit = F.instr(F.lit(alphabet), F.substring(kmer, i, 1)) - 1
        total = total * len(alphabet) + F.when(digit >= 0, digit)
    return F.when(F.length(kmer) == k, total)


def bucket_kmer(bid: Column, k: int, alphabet: str = ALPHABET) -> Column:
    """The inverse of bucket_index."""
    size = len(alphabet)
    rest = bid.cast("long")
    out = []
    for i in reversed(range(k)):
        weight = F.lit(powz(size, i)).cast("long")
        digit = F.pmod((rest - F.pmod(rest, weight)) / weight, F.lit(size)) if k <= 8 else F.pmod(F.floor((rest - F.pmod(rest, weight)).cast("decimal(38,0)") / weight.cast("decimal(38,0)")).cast("long"), F.lit(size))
        out.append(F.substring(F.lit(alphabet), digit.cast("int") + 1, F.lit(1)))
    return F.concat(*out)


def prefix_hash(kmer: Column, k: int) -> Column:
    """bucket_index over the 26 letters alone."""
    return bucket_index(kmer, k, LETTERS)


def enumerate_kmers(spark: SparkSession, k: int, alphabet: str = ALPHABET) -> DataFrame:
    """All k-mers with their numbers."""
    return spark.range(powz(len(alphabet), k)).select(F.col("id").alias("bid"), bucket_kmer(F.col("id"), k, alphabet).alias("kmer"))


_BRACKETS = re.compile(r"\[(\^?)(\]?(?:\[:\w+:\]|[^\]])*)\]")


def _inside(body: str) -> str:
    """The inside of a bracket expression: classes by name, all else but ranges as it is."""
    parts = re.split(r"\[:(\w+):\]", body)
    return "".join(f"\\p{{{x.capitalize()}}}" if i % 2 else re.sub(r"[\\\[\]&^]", r"\\\g<0>", x) for i, x in enumerate(parts))


def java_pattern(basic: str) -> str:
    """A POSIX basic regular expression as a Java one: there, braces and parentheses group only behind a backslash, and + ? | are plain."""
    out, i, start = [], 0, True
    while i < len(basic):
        c = basic[i]
        if c == "\\" and i + 1 < len(basic):
            d = basic[i + 1]
            out.append(d if d in "(){}|+?" else "\\" + d)
            start = d in "(|"
            i += 2
            continue
        if c == "[" and (m := _BRACKETS.match(basic, i)):
            out.append(f"[{m[1]}{_inside(m[2])}]")
            i, start = m.end(), False
            continue
        if c in "(){}|+?" or c == "*" and start:
            out.append("\\" + c)
        else:
            out.append(c)
        start = False
        i += 1
    return "".join(out)


def filter_out(kmer: Column, patterns: list[str]) -> Column:
    """True if any basic regular expression matches anywhere in the k-mer."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | kmer.rlike(java_pattern(p))
    return hit


def left_char(seq: Column, position: Column, sentinel: str = "$") -> Column:
    """The character before a 1-based position; the sentinel at the beginning."""
    return F.when(position <= 1, F.lit(sentinel)).otherwise(F.substring(seq, (position - 1).cast("int"), F.lit(1)))


def normalized(text: Column) -> Column:
    """Letters A-Z only, upper case. Other signs go first, so that no sign's upper case adds letters."""
    return F.upper(F.regexp_replace(text, "[^A-Za-z]", ""))
