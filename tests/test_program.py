"""The whole program, its parameters, matrices, files and plans."""

import json
import os
import random
import resource
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.functions.scoring import BLOSUM62, RESIDUES, match_matrix, parse_matrix, register_matrix
from kinweave.operators import align, pairs, suffix
from kinweave.operators.align import align_lists
from kinweave.plans import pipeline, program
from kinweave.plans.tables import numbered
from kinweave.sources import fasta
from kinweave.sources import pairs as pair_files
from kinweave.sources.params import Params, load_matrix

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SEQS = ["MKTAYIAKQRQISFVKSHFSRQ", "MKTAYIAKQRQISFVKSHFSRQL", "MKTAYIAKQAQISFVKSHFSRQ", "WWWWWWWWWWWWWWWWWWW", "MK", "MKTAYIAKQRQISFVKSHFSRQ"]


def table(spark, seqs, sids=None):
    return spark.createDataFrame([(i, f">{i}", s, len(s)) for i, s in zip(sids or range(len(seqs)), seqs, strict=True)], fasta.SCHEMA)


def as_pairs(df):
    return sorted((r["id1"], r["id2"]) for r in df.collect())


@pytest.mark.parametrize("sids", [[10, 20, 35], [0, 1, 2], [5, 2**40, -7]])
def test_brute_force_of_any_sids(spark, sids):
    df = table(spark, ["MKTAYIAKQRQISFVKSHFSRQ"] * 3, sids)
    a, b, c = sorted(sids)
    assert as_pairs(pipeline.edges(df, Params())) == [(a, b), (a, c), (b, c)]
    assert [r["id2"] for r in pairs.all_sequence_pairs(df, 1).collect()] == [b]
    assert pairs.all_sequence_pairs(df.where("false")).count() == 0
    assert sorted((r["id2"], r["probe"]) for r in pairs.probe_pairs(df, 2).select("id2", "probe").distinct().collect()) == [(a, 0), (b, 1)]


def test_features_of_more_probes_than_sequences(spark):
    rows = pipeline.features(table(spark, ["MKTAYIAKQR", "", "W"], [4, 6, 9]), 5, Params()).collect()
    assert sorted((r["id"], r["class"]) for r in rows) == [(4, "Homologous"), (6, "Not"), (9, "Homologous")]
    assert all(r["3_alen_maxlen"] is None and r["4_score_sscore"] is None for r in rows)
    assert {r["id"]: r["1_ndig_alen"] for r in rows} == {4: None, 6: None, 9: None}


CONFIG = """
ExactMatchLength: 4
SlideWindowSize: 3
UseTree: true
DuplicatesLocal: false
DuplicatesGlobal: true
SuffixArrayBlockSize: 2
MemorySequences: 1m
"""


def test_program(spark, tmp_path):
    (tmp_path / "c.yaml").write_text(CONFIG)
    (tmp_path / "x.fa").write_text("".join(f">s{i}\n{s[:10]}\n{s[10:]}\n" for i, s in enumerate(SEQS)))
    out = str(tmp_path / "out")
    done = program.run(spark, str(tmp_path / "c.yaml"), str(tmp_path / "x.fa"), out)
    expected = [(0, 1), (0, 2), (0, 5), (1, 2), (1, 5), (2, 5)]
    assert as_pairs(done.edges) == expected == as_pairs(pipeline.edges(table(spark, SEQS), Params()))
    written = spark.read.schema("id1 long, id2 long, a double, b double, c double").csv(f"{out}/edges")
    assert as_pairs(written) == expected
    stats = json.loads(spark.read.text(f"{out}/stats").first()[0])
    assert stats["database"]["n_sequences"] == 6 and stats["database"]["longest"] == 23 and stats["database"]["replicated"]
    assert stats["alignments"]["edge_counts"] == 6 and stats["alignments"]["align_counts"] + stats["alignments"]["align_skipped"] == stats["duplicates"]["checked"]
    assert stats["arrays"]["suffixes"] == sum(map(len, SEQS)) and stats["arrays"]["pairs"] == stats["duplicates"]["returned"]
    assert stats["buckets"]["n"] > 10 and stats["refined_buckets"]["sum"] <= stats["buckets"]["sum"] and set(stats["seconds"]) >= {"read", "candidates", "align"}
    log = "\n".join(r[0] for r in spark.read.text(f"{out}/log").collect())
    assert "ExactMatchLength: 4" in log and "align: " in log


def test_program_by_key(spark, tmp_path):
    (tmp_path / "x.fa").write_text("".join(f">s{i}\n{s}\n" for i, s in enumerate(SEQS)))
    path = str(tmp_path / "x.fa")
    tree = dict(UseTree=True, DuplicatesLocal=False, DuplicatesGlobal=True, PrintStats=False)
    dry = program.run(spark, Params(**tree, PerformAlignments=False), path)
    assert dry.edges.count() == 0 and dry.stats["alignments"]["align_counts"] == 0 and dry.stats["alignments"]["align_skipped"] > 0
    assert pipeline.edges(table(spark, SEQS), Params(PerformAlignments=False)).count() == 0
    every = program.run(spark, Params(**tree, OutputAll=True, DistributeSequences=True, MemorySequences=1), path, str(tmp_path / "all"))
    assert not every.stats["database"]["replicated"] and {r["is_edge"] for r in every.edges.collect()} <= {True, False}
    assert not os.path.exists(tmp_path / "all" / "stats")
    quiet = program.run(spark, Params(**tree, OutputToDisk=False), path, str(tmp_path / "quiet"))
    assert quiet.edges.count() == 6 and not os.path.exists(tmp_path / "quiet" / "edges")
    same = program.run(spark, Params(**tree, SkipTree=True, SlideWindowSize=4), path)
    assert as_pairs(same.edges) == as_pairs(pairs.equal_left_pairs(table(spark, SEQS), 4).join(every.edges.where("is_edge").select("id1", "id2"), ["id1", "id2"]))
    repeated = program.run(spark, Params(UseTree=True, PrintStats=False), path)
    assert repeated.edges.count() >= 6 and set(as_pairs(repeated.edges)) == set(as_pairs(quiet.edges))
    (tmp_path / "bad.fa").write_text(">x\nMKTA1YIA\n")
    with pytest.raises(ValueError, match="outside the alphabet"):
        program.run(spark, Params(**tree), str(tmp_path / "bad.fa"))
    for bad in (dict(Matrix="pam0"), dict(Function="xx"), dict(SlideWindowSize=9), dict(SuffixArrayBlockSize=0), dict(DuplicatesLocal=False), dict(Open=10)):
        with pytest.raises(ValueError):
            program.run(spark, Params(**bad), path)


def test_refused_alphabet_is_read(spark):
    assert Params(Alphabet="ACGT:;").letters == "ACGT"
    assert fasta.outside_alphabet(table(spark, ["ACGT", "ACX"]), "ACGT").first()["letters"] == "X"


MATRIX = "# a comment\n   A  R  *\nA  2 -1 -3\nR -1  3 -3\n* -3 -3  1\n"


def test_matrices(spark, tmp_path):
    m = parse_matrix(MATRIX)
    at = RESIDUES.index
    assert m.shape == (24, 24) and m[at("A"), at("A")] == 2 and m[at("A"), at("R")] == -1 and m[at("W"), at("A")] == -3 and m[at("W"), at("W")] == 1
    for bad in ("", "A R\nA 1 2\n", "A R\nA 1\nR 1 2\n", "AA\nAA 1\n"):
        with pytest.raises(ValueError):
            parse_matrix(bad)
    text = "\n".join(["  ".join(["", *RESIDUES]), *(f"{a} " + " ".join(map(str, row)) for a, row in zip(RESIDUES, BLOSUM62.tolist(), strict=True))])
    assert np.array_equal(parse_matrix(text), BLOSUM62)
    (tmp_path / "m.txt").write_text(MATRIX)
    load_matrix(spark, "Tiny", str(tmp_path / "m.txt"))
    register_matrix("match", match_matrix(5, -4))
    df = spark.createDataFrame([(1, 2, "AARA", "ARA")], "id1 long, id2 long, seq1 string, seq2 string")
    assert align.align_pairs(df, "sw", "tiny").first()["score"] == 7 == align_lists(["AARA"], ["ARA"], "sw", m)[0][0]
    assert align.align_pairs(df, "sw", "match").first()["score"] == 15
    assert as_pairs(pipeline.edges(table(spark, SEQS[:3]), Params(Matrix="match"))) == [(0, 1), (0, 2), (1, 2)]
    with pytest.raises(ValueError):
        register_matrix("bad", np.zeros((3, 3)))


def test_pair_files_in_splits(spark, tmp_path):
    rows = [(i, 2 * i + 1) for i in range(5000)] + [(10, 266), (2570, 2**31 - 1)]
    pair_files.write_pairs(spark.createDataFrame(rows, "id1 long, id2 long").coalesce(1), str(tmp_path / "p"))
    one, two = (pair_files.read_pairs(spark, str(tmp_path / "p"), "part-*", limit) for limit in (pair_files.WHOLE_FILE, 100))
    assert as_pairs(one) == as_pairs(two) == sorted(rows)
    assert {r["file"] for r in one.select("file").distinct().collect()} == {r["file"] for r in two.select("file").distinct().collect()}
    both = pair_files.read_pairs(spark, str(tmp_path / "p"), "part-*").unionByName(one)
    assert pairs.distinct_by_file(both).count() == len(rows)
    found = pipeline.edges_of_files(spark, str(tmp_path / "none"), table(spark, SEQS), Params()) if os.path.exists(tmp_path / "none") else None
    assert found is None


def test_edges_of_pair_files(spark, tmp_path):
    pair_files.write_pairs(spark.createDataFrame([(1, 0), (0, 1), (0, 3), (2, 5), (4, 4)], "id1 long, id2 long"), str(tmp_path / "p"))
    assert as_pairs(pipeline.edges_of_files(spark, str(tmp_path / "p"), table(spark, SEQS), Params(), "part-*")) == [(0, 1), (2, 5)]


def test_costs_with_lengths(spark, tmp_path):
    df = pairs.with_cost(pairs.with_sequences(pairs.all_sequence_pairs(table(spark, ["ABC", "AB"])), table(spark, ["ABC", "AB"]), ["len"]))
    pair_files.write_costs(df, str(tmp_path / "c"), lengths=True)
    assert [r[0] for r in spark.read.text(str(tmp_path / "c")).collect()] == ["0\t1\t3\t2\t6"]


def test_pairs_spread_by_cost(spark):
    rng = random.Random(1)
    rows = [(i, i + 1, rng.choice([1, 10, 100, 10**6]) + rng.randrange(5)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id1 long, id2 long, cost long")
    dealt = align.spread_by_cost(df, 16)
    own = dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.sum("cost").alias("c")).collect()
    assert sorted((r["id1"], r["id2"], r["cost"]) for r in dealt.collect()) == sorted(rows)
    heavy = sorted((r["c"] for r in own), reverse=True)
    assert heavy[0] < 2 * sum(heavy) / 14
    assert align.spread_by_cost(df.where("false"), 4).count() == 0


def test_alignment_memory_is_bounded_on_both_sides():
    """Many short pairs with one long partner: the long one doesn't pad the others."""
    code = """
import resource, sys
sys.path.insert(0, %r)
from kinweave.operators.align import align_lists
align_lists(["AC"] * 8, ["AC"] * 8)
low = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
got = align_lists(["AC"] * 2048, ["AC"] * 2047 + ["ACDE" * 25_000])
assert got[0].tolist() == [13, 2, 2] and got[-1].tolist() == [13, 2, 2], got[-1]
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - low) // 1024)
"""
    grown = int(subprocess.run([sys.executable, "-c", code % ROOT], capture_output=True, text=True, check=True).stdout)
    assert grown < 64
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss > 0


def test_tables_hold_the_alignments(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("ACDEGKWUJ", k=rng.randint(0, 9)))
    rows = [(i, i + 100, word(), word()) for i in range(30)]
    df = spark.createDataFrame(rows, "id1 long, id2 long, seq1 string, seq2 string")
    for kind in ("nw", "sg", "sw"):
        cells = {(r["id1"], r["i"], r["j"]): (r["score"], r["matches"], r["length"]) for r in align.alignment_tables(df, kind).collect()}
        scores = align_lists([r[2] for r in rows], [r[3] for r in rows], kind)
        for (i, _, a, b), got in zip(rows, scores, strict=True):
            m, n = len(a), len(b)
            assert sum(k[0] == i for k in cells) == (m + 1) * (n + 1)
            if kind == "nw" and m and n:
                assert cells[i, m, n] == tuple(got)
            elif kind == "sw":
                assert max(c[0] for k, c in cells.items() if k[0] == i) == got[0]
            elif m and n:
                assert max(cells[i, x, y][0] for x in range(1, m + 1) for y in range(1, n + 1) if x == m or y == n) == got[0]


def test_suffixes_longer_than_a_head(spark):
    rng = random.Random(4)
    base = "".join(rng.choices("AB", k=90))
    seqs = [base + "A" * 80, "B" + base, base[30:], "", "A" * 70, base]
    df = table(spark, seqs)
    found = suffix.suffix_table(df).orderBy("idx").collect()
    whole = sorted((s[p:], i, p) for i, s in enumerate(seqs) for p in range(len(s)))
    assert [(r["sid"], r["pos"]) for r in found] == [(i, p) for _, i, p in whole]
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert [r["lcp"] for r in found] == [0] + [common(a[0], b[0]) for a, b in zip(whole, whole[1:])]
    checked = spark.createDataFrame(found)
    assert tuple(suffix.check_suffix_table(checked, df).first()) == (0, 0, 0, 0)
    broken = checked.withColumn("idx", F.when(F.col("idx") == 5, 9).when(F.col("idx") == 9, 5).otherwise(F.col("idx"))).where("idx <> 20").withColumn("lcp", F.when(F.col("idx") == 30, F.col("lcp") + 1).otherwise(F.col("lcp")))
    missing, repeated, unordered, wrong = suffix.check_suffix_table(broken, df).first()
    assert missing == 1 and not repeated and unordered and wrong
    ways = {}
    for i, s in enumerate(seqs):
        for p in range(len(s)):
            for k in range(1, len(s) - p + 1):
                ways.setdefault(s[p : p + k], set()).add(s[p + k] if p + k < len(s) else (i, p))
    inner = sorted((len(w), len(x)) for w, x in ways.items() if len(x) > 1)
    nodes = suffix.tree_nodes(df, checked)
    assert sorted((r["depth"], r["fanout"]) for r in nodes.collect()) == inner
    depths = [r["depth"] for r in suffix.by_depth(nodes).collect()]
    assert depths == sorted(depths, reverse=True)


def test_longest_match_of_copies(spark):
    """Copies of a long text are a seed or a few, not one for each window."""
    rng = random.Random(5)
    text = "".join(rng.choices("ACDEFGHIKL", k=5000))
    df = table(spark, [text, text, text[:3000], "WW" + text[1000:1500] + "WW"])
    got = {(r["id1"], r["id2"]): r["longest"] for r in pairs.longest_matches(df, 12).collect()}
    assert got == {(0, 1): 5000, (0, 2): 3000, (1, 2): 3000, (0, 3): 500, (1, 3): 500, (2, 3): 500}
    assert pairs.maximal_matches(df, 12).count() < 100


def test_groups_and_classes_hold_all_links(spark):
    rng = random.Random(6)
    base = ["".join(rng.choices("ABC", k=rng.randint(0, 20))) for _ in range(12)]
    seqs = [*base, *base[:6], base[0], "", ""]
    df = table(spark, seqs)
    expected = as_pairs(pairs.common_substring_pairs(df, 4))
    groups = {}
    for r in pairs.match_groups(df, 4).collect():
        groups.setdefault(r["kmer"], set()).add(r["sid"])
    assert sorted({(a, b) for g in groups.values() for a in g for b in g if a < b}) == expected
    members = pairs.sequence_classes(df)
    of = {r["sid"]: r["class"] for r in members.collect()}
    assert of == {i: seqs.index(s) for i, s in enumerate(seqs)}
    links = {}
    for a, b in expected:
        key = tuple(sorted((of[a], of[b])))
        links[key] = links.get(key, 0) + 1
    got = pairs.class_pairs(df, members, 4).collect()
    assert {(r["class1"], r["class2"]): r["links"] for r in got} == links and len(got) == len(links)


def test_orders_and_numbers(spark):
    df = table(spark, ["AB", "ABCD", "A", "ABCD"])
    assert [r["sid"] for r in pairs.by_length(df).collect()] == [1, 3, 0, 2]
    sizes = spark.createDataFrame([("B", 3), ("A", 1), ("C", 1)], "kmer string, size long")
    assert [r["kmer"] for r in pairs.by_size(sizes).collect()] == ["A", "C", "B"]
    assert sorted(r["n"] for r in numbered(spark.range(1000, numPartitions=7), "n").collect()) == list(range(1000))
    assert [r["n"] for r in numbered(spark.range(50, numPartitions=3), "n").orderBy("id").collect()] == list(range(50))
    assert numbered(spark.range(0), "n").count() == 0
    # Partitions of unequal sizes: files aren't read in the order in which they were written.
    uneven = spark.range(4000).withColumn("x", F.repeat(F.lit("z"), (F.col("id") % 50).cast("int"))).repartitionByRange(9, F.sqrt("id")).sortWithinPartitions("id")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        assert all(r["id"] == r["n"] for r in numbered(uneven, "n").collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_entry_without_the_corpus_libraries():
    """A missing library leaves out the corpus operators, and nothing else."""
    code = "import sys; sys.path.insert(0, %r); sys.modules[%r] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n.startswith('op') or n == 'pipeline' for n in q))"
    for name in ("xxhash", "zstandard", "kinweave.llm"):
        out = subprocess.run([sys.executable, "-c", code % (ROOT, name)], capture_output=True, text=True, check=True).stdout.split()
        assert int(out[0]) > 40 and out[1] == "0"
