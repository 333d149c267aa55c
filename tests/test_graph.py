import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kinweave.operators import kmers, pairs, suffix
from kinweave.operators.align import align_lists
from kinweave.plans import pipeline
from kinweave.sources import fasta
from kinweave.sources import pairs as pair_files
from kinweave.sources.params import Params, echo, from_map, load, parse_budget
from kinweave.streaming import dedup


def table(spark, seqs):
    return spark.createDataFrame([(i, f">{i}", s, len(s)) for i, s in enumerate(seqs)], fasta.SCHEMA)


def as_pairs(df):
    return sorted((r[0], r[1]) for r in df.collect())


def maximal(seqs, em, skip=lambda kmer: False):
    """Occurrences of left-maximal common windows."""
    out = Counter()
    for a in range(len(seqs)):
        for b in range(a + 1, len(seqs)):
            for i in range(len(seqs[a]) - em + 1):
                for j in range(len(seqs[b]) - em + 1):
                    w = seqs[a][i : i + em]
                    if w == seqs[b][j : j + em] and not skip(w) and (not i or not j or seqs[a][i - 1] != seqs[b][j - 1]):
                        out[a, b] += 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_matches_against_brute_force(spark, seed):
    rng = random.Random(seed)
    seqs = ["".join(rng.choices("ABC"[: rng.randint(2, 3)], k=rng.randint(0, 14))) for _ in range(8)]
    em = rng.randint(1, 4)
    df = table(spark, seqs)
    brute = maximal(seqs, em)
    assert as_pairs(pairs.common_substring_pairs(df, em)) == sorted(brute)
    assert Counter((r["id1"], r["id2"]) for r in pairs.maximal_matches(df, em).collect()) == brute
    skipped = maximal(seqs, em, lambda w: "AA" in w[:2])
    got = pairs.maximal_matches(df, em, ["A\\{2\\}"], 2)
    assert Counter((r["id1"], r["id2"]) for r in got.collect()) == skipped
    longest = {}
    for a, b in brute:
        subs = {seqs[a][i:j] for i in range(len(seqs[a])) for j in range(i + 1, len(seqs[a]) + 1)}
        longest[a, b] = max(len(x) for x in subs if x in seqs[b])
    assert {(r["id1"], r["id2"]): r["longest"] for r in pairs.longest_matches(df, em).collect()} == longest


def test_windows(spark):
    df = table(spark, ["ABCA", "AB", ""])
    assert sorted(map(tuple, kmers.slide(df, 3).collect())) == [(0, 1, "ABC"), (0, 2, "BCA")]
    assert kmers.slide(df, 5).count() == 0
    assert kmers.suffixes(df).count() == 6
    assert sorted(r["size"] for r in kmers.bucket_sizes(kmers.slide(df, 2), 3).collect()) == [1, 1, 2]
    row = kmers.bucket_stats(kmers.bucket_sizes(kmers.slide(df, 2))).first()
    assert (row["n"], row["sum"], row["least"], row["most"]) == (3, 4, 1, 2)


def test_refinement(spark):
    df = table(spark, ["A" * 30, "AAB", "ABC", "BCD"])
    got = {r["kmer"]: r["n"] for r in kmers.refine(df, 1, 4, 0.5).groupBy("kmer").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got["AAA"] == 28 and "A" not in got and got["AAB"] == 1 and got["B"] == 3


def test_tiles(spark):
    n, block = 23, 5
    df = table(spark, ["AB"] * n)
    tiled = pairs.tiles(pairs.brute_force_pairs(df, n), block)
    counts = {r["tile"]: r["n"] for r in tiled.groupBy("tile").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {r["tile"]: r["possible"] for r in pairs.possible_per_tile(df, block).collect()}
    assert sum(counts.values()) == n * (n - 1) // 2


def test_duplicate_scopes(spark):
    rows = [(1, 2, "a", 0)] * 3 + [(2, 1, "b", 1), (1, 2, "b", 1), (3, 4, "b", 0), (5, 5, "a", 0)]
    df = spark.createDataFrame(rows, "id1 long, id2 long, file string, tile int")
    clean = pairs.canonical(df)
    assert clean.count() == 6
    assert [pairs.deduplicate(clean, s).count() for s in ("none", "global", "tile", "file")] == [6, 2, 3, 3]
    assert pairs.deduplicate(clean.coalesce(1), "partition").count() == 2
    assert {r["file"]: (r["pairs"], r["kept"], r["removed"]) for r in pairs.file_duplicates(df).collect()} == {"a": (3, 1, 2), "b": (3, 2, 1)}
    assert as_pairs(pairs.unseen(pairs.deduplicate(clean, "global"), df.limit(1))) == [(3, 4)]
    assert as_pairs(pairs.sorted_by_range(clean)) == [(1, 2), (3, 4)]
    with pytest.raises(ValueError):
        pairs.deduplicate(df, "none at all")


def test_probes_and_costs(spark):
    df = table(spark, ["ABCD", "AB", "A"])
    assert pairs.probe_pairs(df, 2).count() == 6
    assert pairs.selectivity_limit(10, 0.5) == 23
    got = pairs.by_cost(pairs.with_cost(pairs.with_sequences(pairs.brute_force_pairs(df, 3), df))).collect()
    assert [r["cost"] for r in got] == [8, 4, 2]


@pytest.mark.parametrize("seed", range(2))
def test_suffix_table(spark, seed):
    rng = random.Random(seed)
    seqs = ["".join(rng.choices("ABC", k=rng.randint(0, 12))) for _ in range(6)]
    whole = sorted((s[p:], i, p) for i, s in enumerate(seqs) for p in range(len(s)))
    begin = [sum(len(s) + 1 for s in seqs[:i]) for i in range(len(seqs))]
    got = suffix.suffix_table(table(spark, seqs)).orderBy("idx").collect()
    assert [(r["sid"], r["pos"]) for r in got] == [(i, p) for _, i, p in whole]
    assert [r["sa"] for r in got] == [begin[i] + p for _, i, p in whole]
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert [r["lcp"] for r in got] == [0] + [common(a[0], b[0]) for a, b in zip(whole, whole[1:])]
    assert [r["bwt"] for r in got] == [seqs[i][p - 1] if p else "$" for _, i, p in whole]
    assert suffix.bucket_boundaries(table(spark, seqs), 2).first()[0] == len({s[p : p + 2] for s in seqs for p in range(len(s) - 1)})


FASTA = ">one first\nABC\nDE\r\n>two\n>three\nA>B\n\nC D\n>four\nXYZ"


def test_fasta(spark, tmp_path):
    (tmp_path / "x.fa").write_bytes(FASTA.encode())
    df = fasta.read_fasta(spark, str(tmp_path / "x.fa"))
    assert [tuple(r) for r in df.orderBy("sid").collect()] == [(0, ">one first", "ABCDE", 5), (1, ">three", "A>BCD", 5), (2, ">four", "XYZ", 3)]
    fasta.write_fasta(df, str(tmp_path / "out"))
    again = fasta.read_fasta(spark, str(tmp_path / "out"))
    assert sorted((r["id"], r["seq"]) for r in again.collect()) == sorted((r["id"], r["seq"]) for r in df.collect())
    assert tuple(fasta.database_stats(df).first()) == (3, 13, 5)
    assert fasta.file_size(spark, str(tmp_path / "x.fa")) == len(FASTA)
    (tmp_path / "bad.fa").write_text("ABC\n>x\nA\n")
    with pytest.raises(ValueError):
        fasta.read_fasta(spark, str(tmp_path / "bad.fa"))


def test_fasta_in_splits(spark, tmp_path):
    n = 3000
    (tmp_path / "many.fa").write_text("".join(f">s{i}\n{'ACDE' * (1 + i % 7)}\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9k")
    try:
        rows = fasta.read_fasta(spark, str(tmp_path / "many.fa")).orderBy("sid").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r["sid"], r["id"], r["len"]) for r in rows] == [(i, f">s{i}", 4 * (1 + i % 7)) for i in range(n)]


def test_pair_files(spark, tmp_path):
    rows = [(10, 266), (2570, 10), (0, 2**31 - 1), (1, 2)]
    pair_files.write_pairs(spark.createDataFrame(rows, "id1 long, id2 long").coalesce(1), str(tmp_path / "p"))
    assert as_pairs(pair_files.read_pairs(spark, str(tmp_path / "p"), "part-*")) == sorted(rows)
    edges = spark.createDataFrame([(1, 2, 0.5, 0.25, 1.0, True)], "id1 long, id2 long, a double, b double, c double, is_edge boolean")
    pair_files.write_edges(edges, str(tmp_path / "e"), with_label=True)
    assert spark.read.text(str(tmp_path / "e")).first()[0] == "1,2,0.5,0.25,1.0,Edge"
    costs = spark.createDataFrame([(1, 2, 6)], "id1 long, id2 long, cost long")
    pair_files.write_costs(costs, str(tmp_path / "c"))
    assert spark.read.text(str(tmp_path / "c")).first()[0] == "1\t2\t6"


def test_params(spark, tmp_path):
    assert [parse_budget(x) for x in ("536870912", "512m", "2G", "10k", "7b")] == [512 << 20, 512 << 20, 2 << 30, 10 << 10, 7]
    for bad in ("0", "-1", "5x", ""):
        with pytest.raises(ValueError):
            parse_budget(bad)
    (tmp_path / "c.yaml").write_text("ExactMatchLength: 7\nMemoryWorker: 1g\nSkipPrefixes: ['X\\{2,3\\}']\nDuplicatesLocal: false\nDuplicatesGlobal: true\nUseTree: true\nUnknown: 3\n")
    p = load(spark, str(tmp_path / "c.yaml"))
    assert (p.ExactMatchLength, p.MemoryWorker, p.SkipPrefixes, p.dedup, p.strategy, p.kind) == (7, 1 << 30, ["X\\{2,3\\}"], "global", "tree", "sw")
    assert "ExactMatchLength: 7" in echo(p)
    assert Params().dedup == "none" and from_map({}) == Params()
    with pytest.raises(ValueError):
        load(spark, "c.cfg")
    with pytest.raises(ValueError):
        _ = Params(DuplicatesLocal=False).dedup


def test_edges_and_stats(spark):
    seqs = ["MKTAYIAKQRQISFVKSHFSRQ", "MKTAYIAKQRQISFVKSHFSRQL", "MKTAYIAKQAQISFVKSHFSRQ", "WWWWWWWWWWWWWWWWWWW", "MK"]
    df = table(spark, seqs)
    tree = Params(UseTree=True, DuplicatesLocal=False, DuplicatesGlobal=True)
    found = as_pairs(pipeline.edges(df, tree))
    assert found == [(0, 1), (0, 2), (1, 2)] == as_pairs(pipeline.edges(df, Params()))
    stats = pipeline.align_stats(pipeline.candidates(df, Params()), df, Params()).first().asDict()
    assert stats["edge_counts"] == 3 and stats["align_counts"] + stats["align_skipped"] == 10
    dry = pipeline.align_stats(pipeline.candidates(df, Params()), df, Params(PerformAlignments=False)).first().asDict()
    assert dry["align_counts"] == 0 and dry["align_skipped"] == 10 and dry["edge_counts"] == 0
    loose = pipeline.edges(df, Params(UseTree=True, SkipPrefixes=["W\\{2\\}"], DuplicatesLocal=False, DuplicatesGlobal=True))
    assert as_pairs(loose) == found
    wide = pipeline.features(df, 2, Params()).collect()
    assert {r["id"]: r["class"] for r in wide} == {0: "Homologous", 1: "Homologous", 2: "Homologous", 3: "Not", 4: "Not"} and len(wide) == 5
    for r in wide:
        for j in range(2):
            score, matches, length = map(int, align_lists([seqs[r["id"]]], [seqs[j]])[0])
            most = max(len(seqs[r["id"]]), len(seqs[j]))
            assert r[f"{j}_alen_maxlen"] == round(length / most, 9) and r[f"{j}_ndig_alen"] == (round(matches / length, 9) if length else None)


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, 2), (2, 1), (1, 2), (3, 4)], "id1 long, id2 long").write.parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError):
        dedup.first_seen(dedup.read_pair_stream(spark, str(tmp_path / "in")))
    stream = dedup.first_seen(dedup.read_pair_stream(spark, str(tmp_path / "in")), bounded=True)
    q = stream.writeStream.format("memory").queryName("seen").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert as_pairs(spark.table("seen")) == [(1, 2), (3, 4)]
    spark.createDataFrame([(1, "x ABCDEF y"), (2, "nothing")], "n long, t string").write.parquet(str(tmp_path / "docs"))
    docs = dedup.sequence_stream(spark.readStream.schema("n long, t string").parquet(str(tmp_path / "docs")), "n", "t")
    with pytest.raises(ValueError):
        dedup.contaminated(docs, table(spark, ["ZABCDEFZ"]), 5)
    q = dedup.contaminated(docs, table(spark, ["ZABCDEFZ"]), 5, bounded=True).writeStream.format("memory").queryName("dirty").outputMode("append").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r[0] for r in spark.table("dirty").collect()] == [1]
