import itertools
import random

import pytest
from pyspark.sql import functions as F

from kinweave.functions import alphabet, combin, scoring


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_bucket_index_and_inverse(spark):
    kmers = ["AAA", "AAB", "ABA", "ZZZ", "QRS"]
    got = values(spark, [(k,) for k in kmers], "kmer string", alphabet.bucket_index(F.col("kmer"), 3, alphabet.LETTERS))
    assert [g[0] for g in got][:4] == [0, 1, 26, 17575]
    df = spark.createDataFrame([(k,) for k in kmers], "kmer string").withColumn("bid", alphabet.bucket_index(F.col("kmer"), 3))
    assert [r[0] for r in df.select(alphabet.bucket_kmer(F.col("bid"), 3)).collect()] == kmers
    assert values(spark, [("A1A",), ("AA",)], "kmer string", alphabet.bucket_index(F.col("kmer"), 3)) == [(None,), (None,)]


def test_long_bucket_numbers(spark):
    kmers = ["ZZZZZZZZZZZZ", "ABCDEFGHIJKL", ";;;;;;;;;;;;"]
    df = spark.createDataFrame([(k,) for k in kmers], "kmer string").withColumn("bid", alphabet.bucket_index(F.col("kmer"), 12))
    assert [r[0] for r in df.select(alphabet.bucket_kmer(F.col("bid"), 12)).collect()] == kmers
    with pytest.raises(OverflowError):
        alphabet.bucket_index(F.lit("A"), 14)


def test_enumerate_kmers(spark):
    got = alphabet.enumerate_kmers(spark, 2, "ABC").orderBy("bid").collect()
    assert [r["kmer"] for r in got] == ["".join(p) for p in itertools.product("ABC", repeat=2)]


@pytest.mark.parametrize(("basic", "hits", "misses"), [("X\\{2,3\\}", ["AXXB", "XXX"], ["AXB", "X{2,3}"]), ("a+b", ["a+b"], ["aab"]), ("^A.*Z$", ["ABZ"], ["BAZ", "AZB"]), ("*x", ["*x"], ["x"]), ("\\(ab\\)*c", ["c", "ababc"], ["d"]), ("[]x]", ["]", "x"], ["["]), ("[[:digit:]]", ["a1"], ["a"])])
def test_basic_patterns(spark, basic, hits, misses):
    got = values(spark, [(k,) for k in hits + misses], "kmer string", alphabet.filter_out(F.col("kmer"), [basic]))
    assert [g[0] for g in got] == [True] * len(hits) + [False] * len(misses)


def test_normalized_and_left(spark):
    got = values(spark, [("straße é-x1",), (None,)], "t string", alphabet.normalized(F.col("t")))
    assert got == [("STRAEX",), (None,)]
    assert values(spark, [("ABC", 1), ("ABC", 3)], "s string, p int", alphabet.left_char(F.col("s"), F.col("p"))) == [("$",), ("B",)]


def test_combinations():
    for k, step in itertools.product((2, 5), (3, 11, 111)):
        every = sorted(itertools.combinations(range(13), k), key=lambda c: c[::-1])
        for i, c in enumerate(every[:127]):
            assert combin.unrank_combination(i, k) == c and combin.rank_combination(c) == i
            if i:
                assert combin.next_combination(every[i - 1]) == c
        strided = list(itertools.islice(combin.combinations_from(1, k, step), 5))
        assert strided == [combin.unrank_combination(1 + step * i, k) for i in range(5)]
    assert combin.binomial(3, 5) == 0 and combin.binomial(640000, 2) == 204799680000


def test_pair_ranks(spark):
    positions = [0, 1, 2, 3, 204799679999, 2**52 + 12345, *range(100, 12700, 997)]
    df = spark.createDataFrame([(p,) for p in positions], "pos long")
    low, high = combin.unrank_pair(F.col("pos"))
    got = df.select("pos", low.alias("a"), high.alias("b")).withColumn("r", combin.rank_pair(F.col("a"), F.col("b"))).collect()
    assert all(r["r"] == r["pos"] and r["a"] < r["b"] for r in got)
    assert (got[4]["a"], got[4]["b"]) == (639998, 639999)
    assert [(r["a"], r["b"]) for r in got[:4]] == [(0, 1), (0, 2), (1, 2), (0, 3)]
    assert combin.all_pairs(spark, 5, 4).count() == 4


def test_self_scores(spark):
    seqs = ["WTHECK", "BETTERWORK", "SLPSMRADSFTKELMEKISS", "MTNKICIYAISKNEEKFV", "XJOU"]
    got = values(spark, [(s,) for s in seqs], "s string", scoring.self_score(F.col("s")))
    assert [g[0] for g in got] == [43, 51, 95, 93, -1 + 1 + 1 - 1]
    assert (scoring.BLOSUM62 == scoring.BLOSUM62.T).all() and scoring.BLOSUM62.shape == (24, 24)


def test_residues(spark):
    got = values(spark, [(c,) for c in "AaRzUuJO1*"], "c string", scoring.residue_index(F.col("c")))
    assert [g[0] for g in got] == [0, 0, 1, 21, 22, 22, 23, 23, 23, 23]


def test_edge_rules(spark):
    rows = [(30, 8, 16, 20, 100), (29, 8, 16, 20, 100), (30, 6, 16, 20, 100), (30, 8, 15, 20, 100), (0, 9, 20, 20, 1), (5, 0, 0, 0, 0)]
    args = [F.col(c) for c in ("score", "matches", "length", "longest", "own")]
    got = values(spark, rows, "score int, matches int, length int, longest long, own long", scoring.is_edge(*args), *scoring.edge_ratios(*args))
    assert [g[0] for g in got] == [True, False, False, False, False, True]
    assert got[0][1:] == (0.8, 0.5, 0.3) and got[5][1:] == (None, None, None)
    assert scoring.length_cutoff(80, 40) == 32
    assert values(spark, [(32, 100), (31, 100)], "a int, b int", scoring.length_filter(F.col("a"), F.col("b"), 32)) == [(True,), (False,)]
    big = values(spark, [(70000, 70000)], "a int, b int", scoring.pair_cost(F.col("a"), F.col("b")))
    assert big == [(4_900_000_000,)]


def test_length_filter_keeps_edges():
    rng = random.Random(1)
    for _ in range(5000):
        longest = rng.randint(1, 60)
        shortest = rng.randint(1, longest)
        matches = rng.randint(0, shortest)
        length = rng.randint(matches, 2 * longest)
        if length * 100 >= 80 * longest and matches * 100 >= 40 * length and length:
            assert 100 * shortest >= 32 * longest
