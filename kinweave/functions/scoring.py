"""Substitution scores, self scores, the edge predicate and its ratios."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The published BLOSUM62 matrix, in this order of residues.
RESIDUES = "ARNDCQEGHILKMFPSTWYVBZX*"
BLOSUM62 = np.array([
    [4, -1, -2, -2, 0, -1, -1, 0, -2, -1, -1, -1, -1, -2, -1, 1, 0, -3, -2, 0, -2, -1, 0, -4],
    [-1, 5, 0, -2, -3, 1, 0, -2, 0, -3, -2, 2, -1, -3, -2, -1, -1, -3, -2, -3, -1, 0, -1, -4],
    [-2, 0, 6, 1, -3, 0, 0, 0, 1, -3, -3, 0, -2, -3, -2, 1, 0, -4, -2, -3, 3, 0, -1, -4],
    [-2, -2, 1, 6, -3, 0, 2, -1, -1, -3, -4, -1, -3, -3, -1, 0, -1, -4, -3, -3, 4, 1, -1, -4],
    [0, -3, -3, -3, 9, -3, -4, -3, -3, -1, -1, -3, -1, -2, -3, -1, -1, -2, -2, -1, -3, -3, -2, -4],
    [-1, 1, 0, 0, -3, 5, 2, -2, 0, -3, -2, 1, 0, -3, -1, 0, -1, -2, -1, -2, 0, 3, -1, -4],
    [-1, 0, 0, 2, -4, 2, 5, -2, 0, -3, -3, 1, -2, -3, -1, 0, -1, -3, -2, -2, 1, 4, -1, -4],
    [0, -2, 0, -1, -3, -2, -2, 6, -2, -4, -4, -2, -3, -3, -2, 0, -2, -2, -3, -3, -1, -2, -1, -4],
    [-2, 0, 1, -1, -3, 0, 0, -2, 8, -3, -3, -1, -2, -1, -2, -1, -2, -2, 2, -3, 0, 0, -1, -4],
    [-1, -3, -3, -3, -1, -3, -3, -4, -3, 4, 2, -3, 1, 0, -3, -2, -1, -3, -1, 3, -3, -3, -1, -4],
    [-1, -2, -3, -4, -1, -2, -3, -4, -3, 2, 4, -2, 2, 0, -3, -2, -1, -2, -1, 1, -4, -3, -1, -4],
    [-1, 2, 0, -1, -3, 1, 1, -2, -1, -3, -2, 5, -1, -3, -1, 0, -1, -3, -2, -2, 0, 1, -1, -4],
    [-1, -1, -2, -3, -1, 0, -2, -3, -2, 1, 2, -1, 5, 0, -2, -1, -1, -1, -1, 1, -3, -1, -1, -4],
    [-2, -3, -3, -3, -2, -3, -3, -3, -1, 0, 0, -3, 0, 6, -4, -2, -2, 1, 3, -1, -3, -3, -1, -4],
    [-1, -2, -2, -1, -3, -1, -1, -2, -2, -3, -3, -1, -2, -4, 7, -1, -1, -4, -3, -2, -2, -1, -2, -4],
    [1, -1, 1, 0, -1, 0, 0, 0, -1, -2, -2, 0, -1, -2, -1, 4, 1, -3, -2, -2, 0, 0, 0, -4],
    [0, -1, 0, -1, -1, -1, -1, -2, -2, -1, -1, -1, -1, -2, -1, 1, 5, -2, -2, 0, -1, -1, 0, -4],
    [-3, -3, -4, -4, -2, -2, -3, -2, -2, -3, -2, -3, -1, 1, -4, -3, -2, 11, 2, -3, -4, -3, -2, -4],
    [-2, -2, -2, -3, -2, -1, -2, -3, 2, -1, -1, -2, -1, 3, -3, -2, -2, 2, 7, -1, -3, -2, -1, -4],
    [0, -3, -3, -3, -1, -2, -2, -3, -3, 3, 1, -2, 1, -1, -2, -2, 0, -3, -1, 4, -3, -2, -1, -4],
    [-2, -1, 3, 4, -3, 0, 1, -1, 0, -3, -4, 0, -3, -3, -2, 0, -1, -4, -3, -3, 4, 1, -1, -4],
    [-1, 0, 0, 1, -3, 3, 4, -2, 0, -3, -3, 1, -1, -3, -1, 0, -1, -3, -2, -2, 1, 4, -1, -4],
    [0, -1, -1, -1, -2, -1, -1, -1, -1, -1, -1, -1, -1, -1, -2, 0, 0, -2, -1, -1, -1, -1, -1, -4],
    [-4, -4, -4, -4, -4, -4, -4, -4, -4, -4, -4, -4, -4, -4, -4, -4, -4, -4, -4, -4, -4, -4, -4, 1],
])
MATRICES = {"blosum62": BLOSUM62}


def parse_matrix(text: str) -> np.ndarray:
    """A matrix in the usual text form (a line of residues, then a line of scores for each, comments behind #), in the order of RESIDUES.

    A residue that the text lacks scores as its ``*`` does, or as its least score.
    """
    lines = [x.split() for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]
    if not lines or any(len(x) != 1 for x in lines[0]):
        raise ValueError("a matrix begins with a line of residues")
    columns, rows = [c.upper() for c in lines[0]], {}
    for first, *values in lines[1:]:
        if len(values) != len(columns):
            raise ValueError(f"the line of {first} has {len(values)} scores, not {len(columns)}")
        rows[first.upper()] = {c: int(v) for c, v in zip(columns, values, strict=True)}
    if set(rows) != set(columns):
        raise ValueError("a matrix has the same residues in lines and columns")
    least = min(min(r.values()) for r in rows.values())
    stand = {c: c if c in rows else "*" if "*" in rows else None for c in RESIDUES}
    return np.array([[least if stand[a] is None or stand[b] is None else rows[stand[a]][stand[b]] for b in RESIDUES] for a in RESIDUES])


def match_matrix(match: int, mismatch: int) -> np.ndarray:
    """One score for equal residues, another for different ones; ``*`` never matches."""
    out = np.full((len(RESIDUES), len(RESIDUES)), mismatch)
    np.fill_diagonal(out, match)
    out[-1, -1] = mismatch
    return out


def register_matrix(name: str, matrix: np.ndarray) -> None:
    """Makes a matrix known by name."""
    if np.shape(matrix) != BLOSUM62.shape:
        raise ValueError(f"a matrix has {len(RESIDUES)} lines and columns")
    MATRICES[name.lower()] = np.asarray(matrix)


def residue_codes() -> np.ndarray:
    """The row of each byte: either case, U as X, anything else (J and O too) as *."""
    codes = np.full(256, RESIDUES.index("*"), np.int64)
    for i, c in enumerate(RESIDUES):
        codes[[ord(c), ord(c.lower())]] = i
    codes[[ord("U"), ord("u")]] = RESIDUES.index("X")
    return codes


def residue_index(letter: Column) -> Column:
    up = F.translate(F.upper(letter), "U", "X")
    at = F.instr(F.lit(RESIDUES), up)
    return F.when((at > 0) & (F.length(letter) == 1), at - 1).otherwise(RESIDUES.index("*"))


def letter_scores(matrix: np.ndarray = BLOSUM62) -> dict[str, int]:
    """Each letter's score against itself."""
    codes = residue_codes()
    return {c: int(matrix[codes[ord(c)], codes[ord(c)]]) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def self_score(seq: Column, matrix: np.ndarray = BLOSUM62) -> Column:
    """The score of an upper-case sequence of letters against itself: a sum of counts by score, JVM only."""
    by_score: dict[int, str] = {}
    for c, s in letter_scores(matrix).items():
        by_score[s] = by_score.get(s, "") + c
    total = F.lit(0).cast("long")
    for s, letters in sorted(by_score.items()):
        total = total + s * (F.length(seq) - F.length(F.translate(seq, letters, "")))
    return total


def max_length(len1: Column, len2: Column) -> Column:
    return F.greatest(len1, len2).cast("long")


def self_of_longer(len1: Column, len2: Column, self1: Column, self2: Column) -> Column:
    """The self score of the longer sequence, of the second if they are equally long."""
    return F.when(len1 > len2, self1).otherwise(self2)


def is_edge(score: Column, matches: Column, length: Column, longest: Column, self_value: Column, aol: int = 80, sim: int = 40, os: int = 30) -> Column:
    """All in whole numbers."""
    return (score > 0) & (length * 100 >= aol * longest) & (matches * 100 >= sim * length) & (score * 100 >= os * self_value)


def edge_ratios(score: Column, matches: Column, length: Column, longest: Column, self_value: Column) -> tuple[Column, Column, Column]:
    """Coverage, identity, relative score; null where the divisor is 0."""
    d = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    return d(length, longest), d(matches, length), d(score, self_value)


def length_cutoff(aol: int = 80, sim: int = 40) -> int:
    return aol * sim // 100


def length_filter(len1: Column, len2: Column, cutoff: int) -> Column:
    """False if the shorter sequence is too short for any edge; it never removes one."""
    return F.least(len1, len2) * 100 >= cutoff * F.greatest(len1, len2)


def pair_cost(len1: Column, len2: Column) -> Column:
    """Cells of the alignment."""
    return len1.cast("long") * len2.cast("long")
