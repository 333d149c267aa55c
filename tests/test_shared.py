"""Shared windows and linked pairs: small bounds against brute force, and what is moved for them."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinweave.operators import kmers, pairs, shared
from kinweave.plans import queries
from kinweave.sources import fasta
from test_graph import as_pairs, maximal, table

SF = "/root/testdata/sf0.001"


def moved(plan):
    """Nodes of a plan that make a row for each window, or join rows."""
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    return [w for w in ("Generate", "Join ") if w in text]


@pytest.mark.parametrize("seed", range(20))
def test_bins_in_small_rounds(monkeypatch, seed):
    """Ranges and rounds of a few windows, texts of one character, texts outside ASCII: each window lies in one bin with all its ids."""
    rng = random.Random(seed)
    monkeypatch.setattr(shared, "RANGE", rng.choice([5, 13, 1 << 22]))
    monkeypatch.setattr(shared, "ROUND", rng.choice([3, 8, 1 << 22]))
    alphabet = "ABC"[: rng.randint(1, 3)] + ("é" if seed % 3 == 0 else "")
    seqs = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(9)]
    em, bins, sids = rng.randint(1, 7), rng.choice([1, 3, 7]), np.arange(9) * 3 - 5
    codes, offsets = shared._codes(pa.array([*seqs, None]).slice(0, 9))
    held = {}
    for b, windows, size, value in shared._cut(codes, offsets, [sids, sids + 1], em, bins):
        held.setdefault(b, []).append((windows, size, value))
    got, matches = {}, 0
    for rows in held.values():
        for s in shared._shared([(v, n) for _, n, v in rows], sum(w for w, _, _ in rows), 2, em):
            assert (s.columns[0] == s.ids + 1).all()
            names = shared._strings(s.texts).to_pylist()
            for w, who in zip(*s.members(), strict=True):
                got.setdefault(names[w], set()).add(int(s.ids[who]))
            matches += shared._matches(s)
    occurs = Counter(x[k : k + em] for x in seqs for k in range(len(x) - em + 1))
    assert got == {w: {int(sids[i]) for i, x in enumerate(seqs) if w in x} for w, n in occurs.items() if n > 1}
    assert matches == sum(maximal(seqs, em).values())


def test_unequal_texts_of_equal_hashes(monkeypatch):
    monkeypatch.setattr(shared, "_hashes", lambda values, width, base: np.zeros(max(len(values) - width + 1, 0), np.uint64))
    codes, offsets = shared._codes(pa.array(["ABCD", "BCDA", "ABC"]))
    rows = list(shared._cut(codes, offsets, [np.arange(3)], 3, 1))
    found = {}
    for s in shared._shared([(v, n) for _, _, n, v in rows], sum(r[1] for r in rows), 1, 3):
        names = shared._strings(s.texts).to_pylist()
        for w, who in zip(*s.members(), strict=True):
            found.setdefault(names[w], set()).add(int(s.ids[who]))
    assert {k: v for k, v in found.items() if len(v) > 1} == {"ABC": {0, 2}, "BCD": {0, 1}}


def test_runs_are_small(spark):
    """All windows of 24 letters travel in fewer than 4 bytes a letter; a row each took over 30."""
    rng = random.Random(1)
    df = table(spark, ["".join(rng.choices("ABCDEFGHIKLMNOPRSTUVY", k=4000)) for _ in range(60)])
    runs = shared._binned(df, 24, ["len"], 3)
    windows, size = runs.agg(F.sum("windows"), F.sum(F.length("runs"))).first()
    assert windows == 60 * (4000 - 23) and size < 4 * 60 * 4000


@pytest.mark.parametrize("name", ["exact_match_pairs", "exact_match_length_filtered"])
def test_pairs_without_windows_as_rows(spark, name):
    assert moved(queries.QUERIES[name](spark, SF)) == []


def test_groups_without_windows_as_rows(spark):
    assert moved(queries.match_groups(spark, SF)) == []


def test_occurrences_without_pairs_as_rows(spark):
    assert moved(queries.occurrences_by_pair(spark, SF)) == []


@pytest.mark.parametrize("name", ["pair_costs", "cost_by_owner"])
def test_costs_without_joins_of_pairs(spark, name):
    assert moved(queries.QUERIES[name](spark, SF)) == []


def test_tiles_without_windows_as_rows(spark):
    assert moved(pairs.tiles(pairs.common_substring_pairs(queries.documents(spark, SF), 24), 100)) == []


def test_classes_without_windows_as_rows(spark):
    docs = queries.documents(spark, SF)
    assert "Generate" not in moved(pairs.class_pairs(docs, pairs.sequence_classes(docs), 24))


def test_pairs_of_awkward_rows(spark):
    """Repeated, negative, far and missing ids; one text in all of them; a cutoff."""
    seqs = ["ABCDE" * 3, "XABCDE", "ABCDEY", "", "ABCDE" * 4, "QRSTUV", "ABCDE" * 3]
    sids = [-7, 2**40, 5, 9, 5, 6, None]
    df = spark.createDataFrame([(s, ">", x, len(x)) for s, x in zip(sids, seqs, strict=True)], fasta.SCHEMA)
    linked = sorted({(a, b) for i, a in enumerate(sids) for j, b in enumerate(sids) if None not in (a, b) and a < b and {seqs[i][k : k + 5] for k in range(len(seqs[i]) - 4)} & {seqs[j][k : k + 5] for k in range(len(seqs[j]) - 4)}})
    assert as_pairs(pairs.common_substring_pairs(df, 5)) == linked
    costs = Counter((r["id1"], r["id2"], r["len1"] * r["len2"]) for r in pairs.common_substring_pairs_with(df, 5, ["len"]).collect())
    joined = Counter((a, b, len(seqs[i]) * len(seqs[j])) for a, b in linked for i, x in enumerate(sids) if x == a for j, y in enumerate(sids) if y == b)
    assert costs == joined
    once = df.where("sid <> 5 or len < 10")
    kept = {s: len(x) for s, x in zip(sids, seqs, strict=True) if s != 5 or len(x) < 10}
    cut = [(a, b) for a, b in linked if min(kept[a], kept[b]) * 100 >= 50 * max(kept[a], kept[b])]
    assert as_pairs(pairs.common_substring_pairs(once, 5, 50)) == cut and len(cut) < len(linked)
    assert as_pairs(pairs.common_substring_pairs(df.limit(0), 5)) == []
    assert tuple(shared.match_counts(df.limit(0), 5).first()) == (0, 0)


@pytest.mark.parametrize("k", [1, 3, 5])
def test_counts_of_windows(spark, k):
    """Letters of the alphabet are counted in a table, windows with others by themselves; five letters are too many for the table."""
    rng = random.Random(k)
    seqs = ["".join(rng.choices("ABCZ", k=rng.randint(0, 30))) for _ in range(20)] + ["AB>CAB", "éABCé", "", "\U0001f600ABC", "ZZZZZZ"]
    df = table(spark, seqs).unionByName(spark.createDataFrame([(99, ">", None, 0)], fasta.SCHEMA))
    got = {r["kmer"]: r["size"] for r in kmers.counted(df, k).collect()}
    assert got == Counter(x[i : i + k] for x in seqs for i in range(len(x) - k + 1))
    assert {r["kmer"] for r in kmers.counted(df, k, ["Z\\{2\\}"]).collect()} == {w for w in got if "ZZ" not in w}


@pytest.mark.parametrize("name", ["kmer_buckets", "kmer_skip", "bucket_stats"])
def test_counts_without_windows_as_rows(spark, name):
    assert moved(queries.QUERIES[name](spark, SF)) == []


@pytest.mark.parametrize("sent", [1 << 22, 0])
def test_found_in_a_sent_side_or_a_joined_one(spark, monkeypatch, sent):
    """Missing and repeated ids, shared and repeated windows, texts outside ASCII: whether the right side is sent to all tasks or joined."""
    monkeypatch.setattr(shared, "SENT", sent)
    monkeypatch.setattr(shared, "RANGE", 80)
    rng = random.Random(3)
    left = [(rng.choice([1, 2, 3, 4, None]), "".join(rng.choices("ABé", k=rng.randint(0, 25)))) for _ in range(30)]
    right = [(7, "ABABAB"), (8, "éABAB"), (8, "BBBBB"), (9, ""), (9, "AB"), (10, "ABABAB")]
    one, two = (spark.createDataFrame([(i, ">", x, len(x)) for i, x in rows], fasta.SCHEMA) for rows in (left, right))
    share = lambda x, y: any(x[k : k + 5] in y for k in range(len(x) - 4))
    got = pairs.cross_set_pairs(one, two, 5).collect()
    assert {tuple(r) for r in got} == {(a, b) for a, x in left for b, y in right if share(x, y)} and len(got) == len(set(got))
    assert pairs.cross_set_pairs(one, two.limit(0), 5).count() == 0


def test_contamination_without_windows_as_rows(spark):
    assert moved(queries.contamination(spark, SF)) == []
