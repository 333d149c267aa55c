"""Registered queries over the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

import dataclasses
import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import alphabet, combin
from ..functions.scoring import BLOSUM62, RESIDUES, letter_scores, residue_index, self_score
from ..operators import align, kmers, pairs, shared, suffix
from ..operators.align import align_pairs
from ..sources.fasta import database_stats, from_column, read_fasta, write_fasta
from ..sources.pairs import read_pairs, write_costs, write_pairs
from ..sources.params import Params, load
from ..streaming import dedup
from . import pipeline, program
from .tables import fresh_path, numbered, spread, written

EM = 24
NAMES = Params(UseTree=True, ExactMatchLength=3, DuplicatesLocal=False, DuplicatesGlobal=True)
SKIP = ["E\\{2\\}"]


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return from_column(spread(_read(spark, sf, "documents").select("doc_id", "text"), "doc_id"), "doc_id", "text")


def benchmark(spark: SparkSession, sf: str) -> DataFrame:
    return from_column(_read(spark, sf, "benchmark"), "item_id", "text")


def part_names(spark: SparkSession, sf: str, gaps: bool = False) -> DataFrame:
    """The distinct names, numbered in order from 0, or by numbers with gaps; there are a few dozen at any scale."""
    names = _read(spark, sf, "part").select("p_name").distinct()
    n = (F.row_number().over(Window.orderBy("p_name")) - 1).cast("long")
    return from_column(names.select((n * n + 10 if gaps else n).alias("n"), "p_name"), "n", "p_name")


def nations(spark: SparkSession, sf: str) -> DataFrame:
    return from_column(_read(spark, sf, "nation"), "n_nationkey", "n_name")


def seq_index(spark, sf):
    return documents(spark, sf).select("sid", F.col("len").cast("long").alias("len"), self_score(F.col("seq")).alias("self_score"))


def db_stats(spark, sf):
    return database_stats(documents(spark, sf))


def kmer_buckets(spark, sf):
    bid = alphabet.bucket_index(F.col("kmer"), 3, alphabet.LETTERS)
    sizes = kmers.counted(documents(spark, sf), 3).groupBy(bid.alias("bid")).agg(F.sum("size").alias("size"))
    return sizes.select("bid", alphabet.bucket_kmer(F.col("bid"), 3, alphabet.LETTERS).alias("kmer"), "size", F.pmod("bid", F.lit(7)).alias("owner"))


def bucket_stats(spark, sf):
    stats = kmers.bucket_stats(kmers.counted(documents(spark, sf), 3))
    rounded = [F.round(c, 4).alias(c) for c in ("mean", "m2", "stddev")]
    return stats.select("n", "sum", "least", "most", *rounded)


def kmer_skip(spark, sf):
    return kmers.counted(documents(spark, sf), 4, SKIP)


def bucket_refine(spark, sf):
    return kmers.refine(benchmark(spark, sf), 2, 5, 1.0).groupBy("kmer").agg(F.count(F.lit(1)).alias("size"), F.max("k").cast("long").alias("k"))


def exact_match_pairs(spark, sf):
    return pairs.common_substring_pairs(documents(spark, sf), EM)


def exact_match_length_filtered(spark, sf):
    return pairs.common_substring_pairs(documents(spark, sf), EM, 32)


def match_occurrences(spark, sf):
    return pairs.maximal_matches(benchmark(spark, sf), 8)


def match_occurrences_skip(spark, sf):
    return pairs.maximal_matches(benchmark(spark, sf), 6, SKIP, 3)


def occurrences_by_pair(spark, sf):
    counts = shared.match_counts(documents(spark, sf), EM)
    return counts.select(F.col("matches").alias("checked"), F.col("pairs").alias("returned"))


def longest_match(spark, sf):
    return pairs.longest_matches(benchmark(spark, sf), 6)


def contamination(spark, sf):
    found = pairs.cross_set_pairs(documents(spark, sf), benchmark(spark, sf), 32)
    return found.select(F.col("left_id").alias("doc_id"), F.col("right_id").alias("item_id"))


def contamination_edges(spark, sf):
    """Documents aligned with the benchmark items that they share 32 letters with, whole texts: how much of the item a document holds."""
    docs, items = documents(spark, sf), benchmark(spark, sf)
    found = written(pairs.cross_set_pairs(docs, items, 32), "contamination")
    one = docs.select(F.col("sid").alias("left_id"), F.col("seq").alias("seq2"))
    two = items.select(F.col("sid").alias("right_id"), F.col("seq").alias("seq1"), F.col("len").alias("item_len"))
    both = found.join(one, "left_id").join(F.broadcast(two) if items.count() <= 10_000 else two, "right_id")
    aligned = align_pairs(both, "sw")
    held = F.round(F.try_divide(F.col("matches").cast("double"), F.col("item_len").cast("double")), 9)
    return aligned.select(F.col("left_id").alias("doc_id"), F.col("right_id").alias("item_id"), "score", "matches", "length", held.alias("held"))


def equal_left_pairs(spark, sf):
    return pairs.equal_left_pairs(benchmark(spark, sf), 6)


def exact_match_classes(spark, sf):
    """The links of exact_match_pairs between classes of equal sequences, each with the number of pairs that it stands for."""
    docs = documents(spark, sf)
    return pairs.class_pairs(docs, written(pairs.sequence_classes(docs), "classes"), EM)


def sequence_classes(spark, sf):
    return pairs.sequence_classes(documents(spark, sf)).select("sid", F.col("class").alias("class_id"))


def match_groups(spark, sf):
    """Windows that two documents or more share, and how many do: the links of exact_match_pairs in linear space."""
    return shared.shared_windows(documents(spark, sf), EM)


def tile_counts(spark, sf):
    return pairs.tile_counts(documents(spark, sf), pairs.common_substring_pairs(documents(spark, sf), EM), 100)


def possible_per_tile(spark, sf):
    return pairs.possible_per_tile(documents(spark, sf), 100)


def pair_costs(spark, sf):
    costed = pairs.with_cost(pairs.common_substring_pairs_with(documents(spark, sf), EM, ["len"]))
    return costed.select("id1", "id2", F.col("len1").cast("long").alias("len1"), F.col("len2").cast("long").alias("len2"), "cost")


def cost_by_owner(spark, sf):
    found = pair_costs(spark, sf).withColumn("owner", combin.pair_owner(F.col("id1"), F.col("id2"), 8))
    return found.groupBy("owner").agg(F.count(F.lit(1)).alias("pairs"), F.sum("cost").alias("work"))


def brute_force(spark, sf):
    names = part_names(spark, sf)
    found = pairs.with_sequences(pairs.brute_force_pairs(names, names.count()), names)
    return found.select("pos", "id1", "id2", "seq1", "seq2")


def selectivity(spark, sf):
    names = part_names(spark, sf)
    n = names.count()
    return pairs.brute_force_pairs(names, n, pairs.selectivity_limit(n, 0.25))


def rank_unrank(spark, sf):
    keys = _read(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("pos"))
    low, high = combin.unrank_pair(F.col("pos"))
    return keys.select("pos", low.alias("id1"), high.alias("id2")).withColumn("rank", combin.rank_pair(F.col("id1"), F.col("id2")))


def probe_pairs(spark, sf):
    return pairs.probe_pairs(part_names(spark, sf), 3)


def pairs_unseen(spark, sf):
    """Pairs by short matches that long ones don't have."""
    b = benchmark(spark, sf)
    return pairs.unseen(pairs.common_substring_pairs(b, 6), pairs.common_substring_pairs(b, 10))


def dedup_scopes(spark, sf):
    """Occurrences, and pairs left in each scope of duplicate removal."""
    found = pairs.tiles(pairs.maximal_matches(benchmark(spark, sf), 6).select("id1", "id2"), 10)
    count = lambda rows, s: pairs.deduplicate(rows, s).agg(F.count(F.lit(1)).alias("pairs")).select(F.lit(s).alias("scope"), "pairs")
    # One partition, so that the scope of a partition is that of all.
    counts = [count(found, s) for s in ("none", "tile", "global", "process")] + [count(found.coalesce(1), "partition")]
    return functools.reduce(DataFrame.unionByName, counts)


def file_duplicates(spark, sf):
    """Occurrences in files of binary records, a file for each third of the ids; pairs, distinct pairs and what is removed of each file."""
    found = pairs.maximal_matches(benchmark(spark, sf), 6).select("id1", "id2")
    folder = fresh_path(spark, "pair-files")
    for k in range(3):
        write_pairs(found.where(F.col("id1") % 3 == k).coalesce(1), f"{folder}/{k}")
    read = read_pairs(spark, f"{folder}/*", "part-*").withColumn("file", F.element_at(F.split("file", "/"), -2).cast("long"))
    stats = pairs.file_duplicates(read)
    return stats.select("file", "pairs", "kept", "removed", F.round("ratio", 9).alias("ratio"))


def pairs_by_range(spark, sf):
    """Distinct pairs in order by ranges of the first id, as rows with their place in that order."""
    return numbered(pairs.sorted_by_range(pairs.maximal_matches(benchmark(spark, sf), 6)), "place")


def cost_order(spark, sf):
    """Pairs by cost, the largest first, with their place."""
    names = part_names(spark, sf)
    costed = pairs.with_cost(pairs.with_sequences(pairs.all_sequence_pairs(names).select("id1", "id2"), names, ["len"]))
    return numbered(pairs.by_cost(costed).select("id1", "id2", "cost"), "place")


def length_order(spark, sf):
    """Documents by length, the longest first, with their place."""
    return numbered(pairs.by_length(documents(spark, sf).select("sid", F.col("len").cast("long").alias("len"))), "place")


def bucket_order(spark, sf):
    """Buckets by size, the smallest first, with their place."""
    return numbered(pairs.by_size(kmers.bucket_sizes(kmers.slide(benchmark(spark, sf), 3))).select("kmer", "size"), "place")


def cost_files(spark, sf):
    """Costs of the candidate pairs as they stand in their files."""
    names, folder = part_names(spark, sf), fresh_path(spark, "costs")
    write_costs(pairs.with_cost(pairs.with_sequences(pipeline.candidates(names, NAMES), names, ["len"])), folder, lengths=True)
    return spark.read.schema("id1 long, id2 long, len1 long, len2 long, cost long").option("sep", "\t").csv(folder)


def all_suffixes(spark, sf):
    """All suffixes in one bucket."""
    return kmers.suffixes(nations(spark, sf)).select("sid", "pid", "bid", F.col("k").cast("long").alias("k"))


def combinations(spark, sf):
    """All combinations of three of 26 by rank, and the numbers that follow them."""

    def run(batches):
        for pdf in batches:
            found = [combin.unrank_combination(int(p), 3) for p in pdf["pos"]]
            after = [combin.next_combination(c) for c in found]
            yield pdf.assign(a=[c[0] for c in found], b=[c[1] for c in found], c=[c[2] for c in found], rank=[combin.rank_combination(c) for c in found], following=[combin.rank_combination(c) for c in after])

    return spark.range(combin.binomial(26, 3)).withColumnRenamed("id", "pos").mapInPandas(run, "pos long, a long, b long, c long, rank long, following long")


def parameters(spark, sf):
    """A configuration of a few keys, read from its file: all keys with their values."""
    folder = fresh_path(spark, "config")
    given = "ExactMatchLength: 7\nMemoryWorker: 1g\nMemorySequences: 10K\nDuplicatesLocal: false\nDuplicatesGlobal: true\nUnknownKey: 3\n"
    spark.createDataFrame([(given,)], "value string").coalesce(1).write.text(f"{folder}/config.yaml")
    read = load(spark, f"{folder}/config.yaml")
    return spark.createDataFrame([(f.name, str(getattr(read, f.name))) for f in dataclasses.fields(read)], "name string, value string")


def fasta_round_trip(spark, sf):
    """Documents written as FASTA files and read again: id, length and letters of each record."""
    folder = fresh_path(spark, "fasta")
    write_fasta(documents(spark, sf), folder)
    read = read_fasta(spark, folder)
    return read.select("id", F.col("len").cast("long").alias("len"), F.sha2("seq", 256).alias("letters"))


def fasta_numbers(spark, sf):
    """The numbers of the records in one file, in its order."""
    folder = fresh_path(spark, "fasta")
    write_fasta(part_names(spark, sf).coalesce(1), folder)
    return read_fasta(spark, folder).select("sid", "id", "seq")


def suffix_lengths(spark, sf):
    """Moments of the lengths of all suffixes."""
    lengths = documents(spark, sf).select(F.explode(F.sequence(F.lit(1), F.greatest("len", F.lit(1)))).alias("length"), "len").where("len > 0")
    stats = lengths.agg(*kmers.moments(F.col("length").cast("long")))
    return stats.select("n", "sum", "least", "most", F.round("mean", 4).alias("mean"))


def all_kmers(spark, sf):
    return alphabet.enumerate_kmers(spark, 3, alphabet.LETTERS)


def edge_labels(spark, sf):
    found = pipeline.edges(part_names(spark, sf), Params(UseTree=True, ExactMatchLength=3, DuplicatesLocal=False, DuplicatesGlobal=True, OutputAll=True))
    return found.select("id1", "id2", F.when(F.col("is_edge"), "Edge").otherwise("NotAnEdge").alias("label"))


def stream_first_seen(spark, sf):
    """Pairs of part and supplier as a stream, each once; what the stream has written is the result."""
    folder = fresh_path(spark, "stream")
    stream = spark.readStream.schema("l_partkey long, l_suppkey long").parquet(f"{sf}/lineitem.parque[t]")  # a pattern may name one file as well as a folder
    seen = dedup.first_seen(stream.select(F.col("l_partkey").alias("id1"), F.col("l_suppkey").alias("id2")), bounded=True)
    query = seen.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("id1 long, id2 long").parquet(f"{folder}/out")


def residues(spark, sf):
    letters = _read(spark, sf, "nation").select(F.explode(F.split("n_name", "")).alias("letter")).where("letter <> ''").distinct()
    return letters.select("letter", residue_index(F.col("letter")).cast("long").alias("code"))


def suffix_table(spark, sf):
    return suffix.suffix_table(nations(spark, sf))


def suffix_check(spark, sf):
    return suffix.check_suffix_table(written(suffix.suffix_table(benchmark(spark, sf)), "esa"), benchmark(spark, sf))


def tree_dump(spark, sf):
    return suffix.tree_dump(nations(spark, sf))


def tree_stats(spark, sf):
    stats = suffix.tree_stats(nations(spark, sf))
    return stats.select("n_leaves", "n_inner", "most_depth", "most_fanout", *(F.round(c, 6).alias(c) for c in ("mean_depth", "mean_fanout")))


def packed_offsets(spark, sf):
    return suffix.packed_offsets(documents(spark, sf))


def kmer_boundaries(spark, sf):
    return suffix.bucket_boundaries(benchmark(spark, sf), 5)


def _aligned_names(spark, sf, kind):
    names = part_names(spark, sf)
    both = pairs.with_sequences(pairs.brute_force_pairs(names, names.count()).select("id1", "id2"), names, ["seq"])
    return align_pairs(both, kind)


def align_nw(spark, sf):
    return _aligned_names(spark, sf, "nw")


def align_sg(spark, sf):
    return _aligned_names(spark, sf, "sg")


def align_sw(spark, sf):
    return _aligned_names(spark, sf, "sw")


def edges(spark, sf):
    """Edges of the distinct part names by the tree strategy."""
    found = pipeline.edges(part_names(spark, sf), NAMES)
    return found.select("id1", "id2", *(F.round(c, 9).alias(c) for c in "abc"), "is_edge")


def edges_bruteforce(spark, sf):
    """Edges by the default strategy, all pairs, of sequences whose numbers have gaps."""
    found = pipeline.edges(part_names(spark, sf, gaps=True), Params())
    return found.select("id1", "id2", *(F.round(c, 9).alias(c) for c in "abc"), "is_edge")


def edges_of_files(spark, sf):
    """Edges of candidate pairs that were written to binary files and read again."""
    names, folder = part_names(spark, sf), fresh_path(spark, "pair-files")
    write_pairs(pipeline.candidates(names, NAMES), folder)
    found = pipeline.edges_of_files(spark, folder, names, NAMES, "part-*")
    return found.select("id1", "id2", *(F.round(c, 9).alias(c) for c in "abc"), "is_edge")


def program_edges(spark, sf):
    """The whole program on a FASTA file of the names; the edges as they stand in its CSV files."""
    folder = fresh_path(spark, "program")
    write_fasta(part_names(spark, sf).coalesce(1), f"{folder}/in")
    program.run(spark, NAMES, f"{folder}/in", f"{folder}/out")
    found = spark.read.schema("id1 long, id2 long, a double, b double, c double").csv(f"{folder}/out/edges")
    return found.select("id1", "id2", *(F.round(c, 9).alias(c) for c in "abc"))


def alignment_tables(spark, sf):
    """Every cell of the local alignments of the first nations with each other."""
    names = nations(spark, sf).where("sid < 6")
    both = pairs.with_sequences(pairs.all_sequence_pairs(names).select("id1", "id2"), names, ["seq"])
    return align.alignment_tables(both).select("id1", "id2", *(F.col(c).cast("long").alias(c) for c in ("i", "j", "score", "matches", "length")))


def align_stats(spark, sf):
    names = part_names(spark, sf)
    return pipeline.align_stats(pipeline.candidates(names, NAMES), names, NAMES)


def feature_matrix(spark, sf):
    return pipeline.features(part_names(spark, sf), 3, NAMES)


def benchmark_edges(spark, sf):
    """Edges among whole benchmark texts with a common substring."""
    found = pipeline.edges(benchmark(spark, sf), Params(UseTree=True, ExactMatchLength=8, DuplicatesLocal=False, DuplicatesGlobal=True, OutputAll=True))
    return found.select("id1", "id2", *(F.round(c, 9).alias(c) for c in "abc"), "is_edge")


QUERIES = {f.__name__: f for f in (
    seq_index, db_stats, kmer_buckets, bucket_stats, kmer_skip, bucket_refine, exact_match_pairs, exact_match_length_filtered, match_occurrences,
    match_occurrences_skip, occurrences_by_pair, longest_match, contamination, equal_left_pairs, tile_counts, pair_costs, cost_by_owner, brute_force,
    selectivity, rank_unrank, probe_pairs, pairs_unseen, residues, suffix_table, kmer_boundaries, align_nw, align_sg, align_sw, edges, align_stats,
    feature_matrix, benchmark_edges, dedup_scopes, suffix_lengths, all_kmers, edge_labels, stream_first_seen, exact_match_classes, sequence_classes,
    match_groups, possible_per_tile, file_duplicates, pairs_by_range, fasta_round_trip, fasta_numbers, suffix_check, tree_dump, tree_stats, packed_offsets,
    edges_bruteforce, edges_of_files, program_edges, alignment_tables, contamination_edges, cost_order, length_order, bucket_order, cost_files, all_suffixes,
    combinations, parameters,
)}


# The same in SQL.

_SEQ = "upper(regexp_replace(coalesce({text}, ''), '[^A-Za-z]', '', 'g'))"
_DOCS = f"docs as (select doc_id as sid, {_SEQ.format(text='text')} as seq from documents)"
_BENCH = f"bench as (select item_id as sid, {_SEQ.format(text='text')} as seq from benchmark)"
_NAMES = f"names as (select row_number() over (order by p_name) - 1 as sid, {_SEQ.format(text='p_name')} as seq from (select distinct p_name from part))"

_GAPPED = f"names as (select (n - 1) * (n - 1) + 10 as sid, seq from (select row_number() over (order by p_name) as n, {_SEQ.format(text='p_name')} as seq from (select distinct p_name from part)))"


def _slide(source: str, k: int) -> str:
    """Windows of a table: sid, pid, kmer, left."""
    return f"""(select sid, pid, substr(seq, pid, {k}) as kmer, case when pid = 1 then '$' else substr(seq, pid - 1, 1) end as left_char
        from (select sid, seq, unnest(range(1, length(seq) - {k} + 2)) as pid from {source} where length(seq) >= {k}))"""


def _t1(source: str, k: int) -> str:
    return f"""(select distinct a.sid as id1, b.sid as id2 from (select distinct sid, kmer from {_slide(source, k)}) a
        join (select distinct sid, kmer from {_slide(source, k)}) b on a.kmer = b.kmer and a.sid < b.sid)"""


def _t2(source: str, k: int, where: str = "true") -> str:
    return f"""(select a.sid as id1, a.pid as pos1, b.sid as id2, b.pid as pos2 from (select * from {_slide(source, k)} where {where}) a
        join (select * from {_slide(source, k)} where {where}) b on a.kmer = b.kmer and a.sid < b.sid
        and (a.left_char <> b.left_char or a.pid = 1 or b.pid = 1))"""


def _self_score(seq: str) -> str:
    return " + ".join(f"{s} * (length({seq}) - length(replace({seq}, '{c}', '')))" for c, s in letter_scores().items())


def _rank(a: str, b: str) -> str:
    return f"({b}) * (({b}) - 1) // 2 + ({a})"


_COSTS = f"""costs as (select p.id1, p.id2, length(x.seq) as len1, length(y.seq) as len2, length(x.seq) * length(y.seq) as cost
    from {_t1('docs', EM)} p join docs x on p.id1 = x.sid join docs y on p.id2 = y.sid)"""
_SIZES = f"sizes as (select kmer, count(*) as size from {_slide('docs', 3)} group by kmer)"


def _refine_sql() -> str:
    """Rounds at 2 and 3 characters; suffixes in large buckets move on."""
    return f"""with {_BENCH}, w2 as (select sid, pid, kmer from {_slide('bench', 2)}),
    s2 as (select kmer, count(*) as size from w2 group by kmer), lim as (select avg(size) + 1.0 * stddev_samp(size) as l from s2),
    big2 as (select kmer from s2, lim where size > l),
    w3 as (select w.sid, w.pid, substr(seq, w.pid, 3) as kmer from w2 w join big2 using (kmer) join bench using (sid) where w.pid + 2 <= length(seq)),
    big3 as (select kmer from (select kmer, count(*) as size from w3 group by kmer), lim where size > l),
    w4 as (select w.sid, w.pid, substr(seq, w.pid, 4) as kmer from w3 w join big3 using (kmer) join bench using (sid) where w.pid + 3 <= length(seq)),
    every as (select kmer from w2 where kmer not in (select kmer from big2) union all select kmer from w3 where kmer not in (select kmer from big3) union all select kmer from w4)
    select kmer, count(*) as size, length(kmer) as k from every group by kmer"""


def _residues_sql() -> str:
    return """select letter, cast(case when upper(letter) = 'U' then 22 when instr('ARNDCQEGHILKMFPSTWYVBZX*', upper(letter)) > 0
        then instr('ARNDCQEGHILKMFPSTWYVBZX*', upper(letter)) - 1 else 23 end as bigint) as code
        from (select distinct unnest(string_split(n_name, '')) as letter from nation) where letter <> ''"""


def _suffix_sql() -> str:
    seq = _SEQ.format(text="n_name")
    return f"""with s as (select cast(n_nationkey as bigint) as sid, {seq} as seq from nation),
    o as (select sid, sum(length(seq) + 1) over (order by sid) - length(seq) - 1 as begin_at from s),
    x as (select sid, unnest(range(0, length(seq))) as pos, seq from s),
    y as (select sid, pos, substr(seq, pos + 1) as rest, case when pos = 0 then '$' else substr(seq, pos, 1) end as bwt from x),
    z as (select *, row_number() over w - 1 as idx, lag(rest) over w as prior from y window w as (order by rest, sid, pos))
    select idx, cast(begin_at + pos as bigint) as sa,
      cast(case when prior is null then 0 else list_sum(list_transform(range(1, least(length(rest), length(prior)) + 1), lambda i: case when substr(rest, 1, i) = substr(prior, 1, i) then 1 else 0 end)) end as bigint) as lcp,
      bwt, substr(rest, 1, 1) as t, sid, pos, substr(rest, 1, 20) as suffix from z join o using (sid)"""


def _aligned_sql(kind: str, pairs_sql: str, source: str) -> str:
    """CTEs up to aligned(id1, id2, score, matches, length): the recurrence cell by cell, a row a pair, gap states with their own counts.

    h: the row above; cur: this row; d: deletions by column; ins: the insertion so far; best: the answer of sg and sw.
    """
    edge = (lambda k: f"case when {k} = 0 then 0 else -10 - ({k} - 1) end") if kind == "nw" else (lambda k: "0")
    cell = lambda s, m="0", n="0": f"{{'s': cast({s} as integer), 'm': cast({m} as integer), 'n': cast({n} as integer)}}"
    matrix = "[" + ", ".join(str(row) for row in BLOSUM62.tolist()) + "]"
    code = lambda seq: f"list_transform(string_split({seq}, ''), lambda c: case when c = 'U' then 22 when instr('{RESIDUES}', c) > 0 then instr('{RESIDUES}', c) - 1 else 23 end)"
    low = -1_000_000
    gapped = lambda frm, state: f"case when {frm}.s - 10 >= {state}.s - 1 then {cell(frm + '.s - 10', frm + '.m', frm + '.n + 1')} else {cell(state + '.s - 1', state + '.m', state + '.n + 1')} end"
    top = "case when g.s >= dd.s and g.s >= ii.s then g when dd.s >= ii.s then dd else ii end"
    if kind == "sw":
        top = f"case when greatest(g.s, dd.s, ii.s) <= 0 then {cell('0')} else {top} end"
    better = {"nw": "false", "sg": "(i = m or j = n) and c.s > best.s", "sw": "c.s > best.s"}[kind]
    answer = "h[n + 1]" if kind == "nw" else "best"
    return f"""todo as (select p.id1, p.id2, {code('x.seq')} as a, {code('y.seq')} as b from {pairs_sql} p join {source} x on p.id1 = x.sid join {source} y on p.id2 = y.sid),
    dp as (
        select id1, id2, a, b, len(a) as m, len(b) as n, cast(1 as bigint) as i, cast(1 as bigint) as j,
            list_transform(range(0, len(b) + 1), lambda k: {cell(edge('k'))}) as h, [{cell(edge('1'))}] as cur,
            list_transform(range(0, len(b) + 1), lambda k: {cell(str(low))}) as d, {cell(str(low))} as ins, {cell('0' if kind == 'sw' else str(low))} as best
        from todo
        union all
        select id1, id2, a, b, m, n, case when j = n then i + 1 else i end, case when j = n then 1 else j + 1 end,
            case when j = n then list_append(cur, c) else h end, case when j = n then [{cell(edge('(i + 1)'))}] else list_append(cur, c) end,
            list_concat(list_concat(d[1:j], [dd]), d[j + 2:]), case when j = n then {cell(str(low))} else ii end, case when {better} then c else best end
        from (select *, {top} as c from (
            select *, {cell(f'nw.s + {matrix}[a[i] + 1][b[j] + 1]', 'nw.m + (case when a[i] = b[j] then 1 else 0 end)', 'nw.n + 1')} as g from (
                select *, {gapped('up', 'dp_')} as dd, {gapped('lf', 'ins')} as ii from (
                    select *, h[j + 1] as up, h[j] as nw, cur[j] as lf, d[j + 1] as dp_ from dp where i <= m))))
    ),
    aligned as materialized (select id1, id2, {answer}.s as score, {answer}.m as matches, {answer}.n as length from dp where i = m + 1)"""


_ALL_NAMES = "(select x.sid as id1, y.sid as id2 from names x join names y on x.sid < y.sid)"


_LONG_ENOUGH = "100 * least(x.len, y.len) >= 32 * greatest(x.len, y.len)"


def _edges_sql(pairs_sql: str, where: str = _LONG_ENOUGH, names: str = _NAMES) -> str:
    """CTEs up to edged: aligned pairs with their ratios and verdict at the default thresholds."""
    score = _self_score("seq")
    return f"""with recursive {names}, selves as materialized (select sid, seq, length(seq) as len, cast({score} as bigint) as self from names),
    wanted as (select p.id1, p.id2 from {pairs_sql} p join selves x on p.id1 = x.sid join selves y on p.id2 = y.sid where {where}),
    {_aligned_sql('sw', 'wanted', 'names')},
    longer as (select l.*, greatest(x.len, y.len) as max_len, case when x.len > y.len then x.self else y.self end as own, x.len * y.len as cost
        from aligned l join selves x on l.id1 = x.sid join selves y on l.id2 = y.sid),
    edged as (select *, round(length / nullif(max_len, 0), 9) as a, round(matches / nullif(length, 0), 9) as b, round(score / nullif(own, 0), 9) as c,
        score > 0 and length * 100 >= 80 * max_len and matches * 100 >= 40 * length and score * 100 >= 30 * own as is_edge from longer)"""


def _features_sql() -> str:
    """Every sequence with the first three, whatever their lengths; a row for each sequence."""
    wide = ", ".join(f"max({v}) filter (where id2 = {j}) as \"{j}_{name}\"" for j in range(3) for v, name in (("a", "alen_maxlen"), ("b", "ndig_alen"), ("c", "score_sscore")))
    probes = "(select x.sid as id1, y.sid as id2 from names x, names y where y.sid < 3)"
    return f"{_edges_sql(probes, 'true')} select n.sid as id, {wide}, case when bool_or(coalesce(is_edge, false)) then 'Homologous' else 'Not' end as class from names n left join edged on n.sid = id1 group by n.sid"


def _tables_sql() -> str:
    """A row of cells is the state above the first cell of the next row."""
    seq = _SEQ.format(text="n_name")
    first = f"with recursive names as (select cast(n_nationkey as bigint) as sid, {seq} as seq from nation where n_nationkey < 6), {_aligned_sql('sw', _ALL_NAMES, 'names')}"
    return f"""{first}, lines as (select id1, id2, i - 1 as i, h, unnest(range(0, n + 1)) as j from dp where j = 1)
    select id1, id2, i, j, cast(h[j + 1].s as bigint) as score, cast(h[j + 1].m as bigint) as matches, cast(h[j + 1].n as bigint) as length from lines"""


def _tree_sql() -> str:
    """All substrings with the ways in which they go on; ends of sequences are ways of their own."""
    seq = _SEQ.format(text="n_name")
    return f"""with s as (select cast(n_nationkey as bigint) as sid, {seq} as seq from nation),
    p as (select sid, seq, unnest(range(1, length(seq) + 1)) as pos from s), w as (select sid, seq, pos, unnest(range(1, length(seq) - pos + 2)) as k from p),
    ways as (select substr(seq, pos, k) as node, k, case when pos + k <= length(seq) then substr(seq, pos + k, 1) else concat(sid, ':', pos) end as way from w),
    inner_nodes as (select node, max(k) as depth, count(distinct way) as fanout from ways group by node having count(distinct way) > 1)
    select (select cast(sum(length(seq)) as bigint) from s) as n_leaves, count(*) as n_inner, max(depth) as most_depth, max(fanout) as most_fanout,
        round(avg(depth), 6) as mean_depth, round(avg(fanout), 6) as mean_fanout from inner_nodes"""


def _stats_sql() -> str:
    return f"""{_edges_sql(_t1('names', 3))},
    every as (select x.len * y.len as cost, 100 * least(x.len, y.len) >= 32 * greatest(x.len, y.len) as kept from {_t1('names', 3)} p join selves x on p.id1 = x.sid join selves y on p.id2 = y.sid)
    select (select count(*) from edged where is_edge) as edge_counts, count(*) filter (where kept) as align_counts, count(*) filter (where not kept) as align_skipped,
        cast(coalesce(sum(cost) filter (where kept), 0) as bigint) as work, cast(coalesce(sum(cost) filter (where not kept), 0) as bigint) as work_skipped from every"""


_SKIP_SQL = "not regexp_matches({}, 'E{{2}}')"

ORACLE_SQL = {
    "seq_index": f"with {_DOCS} select sid, length(seq) as len, cast({_self_score('seq')} as bigint) as self_score from docs",
    "db_stats": f"with {_DOCS} select count(*) as n_sequences, cast(coalesce(sum(length(seq)), 0) as bigint) as n_chars, coalesce(max(length(seq)), 0) as longest from docs",
    "kmer_buckets": f"""with {_DOCS}, {_SIZES} select cast((ascii(kmer) - 65) * 676 + (ascii(substr(kmer, 2)) - 65) * 26 + ascii(substr(kmer, 3)) - 65 as bigint) as bid, kmer, size,
        cast(((ascii(kmer) - 65) * 676 + (ascii(substr(kmer, 2)) - 65) * 26 + ascii(substr(kmer, 3)) - 65) % 7 as bigint) as owner from sizes""",
    "bucket_stats": f"""with {_DOCS}, {_SIZES} select count(*) as n, cast(sum(size) as bigint) as sum, min(size) as least, max(size) as most,
        round(avg(size), 4) as mean, round(var_pop(size) * count(*), 4) as m2, round(stddev_samp(size), 4) as stddev from sizes""",
    "kmer_skip": f"with {_DOCS} select kmer, count(*) as size from {_slide('docs', 4)} where {_SKIP_SQL.format('kmer')} group by kmer",
    "bucket_refine": _refine_sql(),
    "exact_match_pairs": f"with {_DOCS} select * from {_t1('docs', EM)}",
    "exact_match_length_filtered": f"""with {_DOCS} select id1, id2 from {_t1('docs', EM)} p join docs x on p.id1 = x.sid join docs y on p.id2 = y.sid
        where 100 * least(length(x.seq), length(y.seq)) >= 32 * greatest(length(x.seq), length(y.seq))""",
    "match_occurrences": f"with {_BENCH} select * from {_t2('bench', 8)}",
    "match_occurrences_skip": f"with {_BENCH} select * from {_t2('bench', 6, _SKIP_SQL.format('substr(kmer, 1, 3)'))}",
    "occurrences_by_pair": f"with {_DOCS} select count(*) as checked, count(distinct (id1, id2)) as returned from {_t2('docs', EM)}",
    "longest_match": f"""with {_BENCH}, hits as (select a.sid as id1, b.sid as id2, a.pid as pos, a.pid - b.pid as diagonal from {_slide('bench', 6)} a join {_slide('bench', 6)} b on a.kmer = b.kmer and a.sid < b.sid),
        runs as (select id1, id2, diagonal, pos - row_number() over (partition by id1, id2, diagonal order by pos) as run from hits)
        select id1, id2, max(n) + 5 as longest from (select id1, id2, diagonal, run, count(*) as n from runs group by all) group by id1, id2""",
    "contamination": f"""with {_DOCS}, {_BENCH} select distinct a.sid as doc_id, b.sid as item_id from (select distinct sid, kmer from {_slide('docs', 32)}) a
        join (select distinct sid, kmer from {_slide('bench', 32)}) b on a.kmer = b.kmer""",
    "equal_left_pairs": f"""with {_BENCH} select distinct a.sid as id1, b.sid as id2 from {_slide('bench', 6)} a join {_slide('bench', 6)} b
        on a.kmer = b.kmer and a.sid < b.sid and a.left_char = b.left_char and a.pid > 1 and b.pid > 1""",
    "tile_counts": f"""with {_DOCS}, b as (select sid // 100 as blk, count(*) as n from docs group by 1),
        possible as (select -1 - blk as tile, n * (n - 1) // 2 as possible from b union all select {_rank('x.blk', 'y.blk')}, x.n * y.n from b x join b y on x.blk < y.blk),
        found as (select case when id1 // 100 = id2 // 100 then -1 - id1 // 100 else {_rank('id1 // 100', 'id2 // 100')} end as tile, count(*) as generated from {_t1('docs', EM)} group by 1),
        every as (select tile, possible, generated from possible left join found using (tile))
        select tile, 1 as tiles, possible, generated from every where generated is not null
        union all select null, count(*) filter (where generated is null), cast(coalesce(sum(possible) filter (where generated is null), 0) as bigint), 0 from every""",
    "possible_per_tile": f"""with {_DOCS}, b as (select sid // 100 as blk, count(*) as n from docs group by 1)
        select -1 - blk as tile, n * (n - 1) // 2 as possible from b union all select {_rank('x.blk', 'y.blk')}, x.n * y.n from b x join b y on x.blk < y.blk""",
    "sequence_classes": f"with {_DOCS} select sid, min(sid) over (partition by seq) as class_id from docs",
    "exact_match_classes": f"""with {_DOCS}, c as (select sid, seq, min(sid) over (partition by seq) as class from docs)
        select x.class as class1, y.class as class2, count(*) as links from
            (select least(p.c1, p.c2) as class, greatest(p.c1, p.c2) as other, id1, id2 from (select t.id1, t.id2, a.class as c1, b.class as c2 from {_t1('docs', EM)} t join c a on t.id1 = a.sid join c b on t.id2 = b.sid) p) x
            join (select distinct class from c) y on x.other = y.class group by all""",
    "match_groups": f"with {_DOCS} select kmer, count(distinct sid) as n from {_slide('docs', EM)} group by kmer having count(distinct sid) > 1",
    "file_duplicates": f"""with {_BENCH}, o as (select id1 % 3 as file, id1, id2 from {_t2('bench', 6)})
        select file, count(*) as pairs, count(distinct (id1, id2)) as kept, count(*) - count(distinct (id1, id2)) as removed, round((count(*) - count(distinct (id1, id2))) / count(*), 9) as ratio from o group by file""",
    "pairs_by_range": f"with {_BENCH} select id1, id2, row_number() over (order by id1, id2) - 1 as place from {_t1('bench', 6)}",
    "fasta_round_trip": f"with {_DOCS} select '>' || sid as id, length(seq) as len, sha256(seq) as letters from docs where seq <> ''",
    "fasta_numbers": f"with {_NAMES} select row_number() over (order by sid) - 1 as sid, '>' || sid as id, seq from names where seq <> ''",
    "suffix_check": "select 0 as missing, 0 as repeated, 0 as unordered, 0 as wrong_lcp",
    "tree_dump": f"select idx, bwt, sid, pos + 1 as pid, suffix from ({_suffix_sql()})",
    "tree_stats": _tree_sql(),
    "packed_offsets": f"""with {_DOCS}, o as (select sid, length(seq) as n, sum(length(seq) + 1) over (order by sid) as upto from docs)
        select sid, cast(upto - n - 1 as bigint) as begin, cast(upto - 1 as bigint) as "end" from o""",
    "edges_bruteforce": f"{_edges_sql(_ALL_NAMES, names=_GAPPED)} select id1, id2, a, b, c, is_edge from edged where is_edge",
    "edges_of_files": f"{_edges_sql(_t1('names', 3))} select id1, id2, a, b, c, is_edge from edged where is_edge",
    "program_edges": f"{_edges_sql(_t1('names', 3))} select id1, id2, a, b, c from edged where is_edge",
    "alignment_tables": _tables_sql(),
    "cost_order": f"""with {_NAMES}, p as (select x.sid as id1, y.sid as id2, length(x.seq) * length(y.seq) as cost from names x join names y on x.sid < y.sid)
        select id1, id2, cost, row_number() over (order by cost desc, id1, id2) - 1 as place from p""",
    "length_order": f"with {_DOCS} select sid, length(seq) as len, row_number() over (order by length(seq) desc, sid) - 1 as place from docs",
    "bucket_order": f"with {_BENCH}, b as (select kmer, count(*) as size from {_slide('bench', 3)} group by kmer) select kmer, size, row_number() over (order by size, kmer) - 1 as place from b",
    "cost_files": f"""with {_NAMES} select id1, id2, length(x.seq) as len1, length(y.seq) as len2, length(x.seq) * length(y.seq) as cost
        from {_t1('names', 3)} p join names x on p.id1 = x.sid join names y on p.id2 = y.sid""",
    "all_suffixes": f"""with s as (select cast(n_nationkey as bigint) as sid, {_SEQ.format(text='n_name')} as seq from nation)
        select sid, unnest(range(1, length(seq) + 1)) as pid, cast(0 as bigint) as bid, cast(0 as bigint) as k from s""",
    "combinations": """with c as (select x.a, y.b, z.c from range(26) x(a) join range(26) y(b) on x.a < y.b join range(26) z(c) on y.b < z.c)
        select row_number() over w - 1 as pos, a, b, c, row_number() over w - 1 as rank, row_number() over w as following from c window w as (order by c, b, a)""",
    "parameters": """select * from (values ('AlignOverLongerSequence', '80'), ('MatchSimilarity', '40'), ('OptimalScoreOverSelfScore', '30'), ('SlideWindowSize', '3'), ('ExactMatchLength', '7'),
        ('SuffixArrayBlockSize', '100'), ('Function', 'sw_stats_striped_16'), ('Matrix', 'blosum62'), ('Open', '-10'), ('Gap', '-1'), ('MemoryWorker', '1073741824'), ('MemorySequences', '10240'),
        ('SkipPrefixes', '[]'), ('OutputAll', 'False'), ('OutputToDisk', 'True'), ('DistributeSequences', 'False'), ('UseLengthFilter', 'True'), ('UseIterator', 'False'), ('UseCounter', 'False'),
        ('UseArray', 'False'), ('UseTree', 'False'), ('UseTreeDynamic', 'False'), ('UseTreeHybrid', 'False'), ('PrintStats', 'True'), ('Alphabet', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ:;'),
        ('AlphabetBegin', ':'), ('AlphabetDollar', ';'), ('DuplicatesLocal', 'False'), ('DuplicatesSemiLocal', 'False'), ('DuplicatesSmp', 'False'), ('DuplicatesGlobal', 'True'),
        ('BucketCutoff', '30'), ('SkipTree', 'False'), ('PerformAlignments', 'True')) v(name, value)""",
    "pair_costs": f"with {_DOCS}, {_COSTS} select * from costs",
    "cost_by_owner": f"with {_DOCS}, {_COSTS} select ({_rank('id1', 'id2')}) % 8 as owner, count(*) as pairs, cast(sum(cost) as bigint) as work from costs group by 1",
    "brute_force": f"with {_NAMES} select {_rank('x.sid', 'y.sid')} as pos, x.sid as id1, y.sid as id2, x.seq as seq1, y.seq as seq2 from names x join names y on x.sid < y.sid",
    "selectivity": f"""with {_NAMES}, p as (select {_rank('x.sid', 'y.sid')} as pos, x.sid as id1, y.sid as id2 from names x join names y on x.sid < y.sid)
        select * from p where pos < (select cast(floor(count(*) * 0.25 + 0.5) as bigint) from p)""",
    "rank_unrank": """with k as (select cast(o_orderkey as bigint) as pos from orders), h as (select pos, cast(floor((1 + sqrt(1 + 8.0 * pos)) / 2) as bigint) as id2 from k)
        select pos, pos - id2 * (id2 - 1) // 2 as id1, id2, pos as rank from h""",
    "probe_pairs": f"with {_NAMES} select x.sid as id1, y.sid as id2, y.sid as probe from names x, names y where y.sid < 3",
    "pairs_unseen": f"with {_BENCH} select * from {_t1('bench', 6)} except select * from {_t1('bench', 10)}",
    "residues": _residues_sql(),
    "suffix_table": _suffix_sql(),
    "align_nw": f"with recursive {_NAMES}, {_aligned_sql('nw', _ALL_NAMES, 'names')} select * from aligned",
    "align_sg": f"with recursive {_NAMES}, {_aligned_sql('sg', _ALL_NAMES, 'names')} select * from aligned",
    "align_sw": f"with recursive {_NAMES}, {_aligned_sql('sw', _ALL_NAMES, 'names')} select * from aligned",
    "edges": f"{_edges_sql(_t1('names', 3))} select id1, id2, a, b, c, is_edge from edged where is_edge",
    "align_stats": _stats_sql(),
    "feature_matrix": _features_sql(),
    "edge_labels": f"{_edges_sql(_t1('names', 3))} select id1, id2, case when is_edge then 'Edge' else 'NotAnEdge' end as label from edged",
    "dedup_scopes": f"""with {_BENCH}, o as (select id1, id2, case when id1 // 10 = id2 // 10 then -1 - id1 // 10 else {_rank('id1 // 10', 'id2 // 10')} end as tile from {_t2('bench', 6)})
        select 'none' as scope, count(*) as pairs from o union all select 'tile', count(distinct (tile, id1, id2)) from o
        union all select unnest(['global', 'process', 'partition']), count(distinct (id1, id2)) from o""",
    "suffix_lengths": f"""with {_DOCS}, l as (select unnest(range(1, length(seq) + 1)) as length from docs)
        select count(*) as n, cast(sum(length) as bigint) as sum, min(length) as least, max(length) as most, round(avg(length), 4) as mean from l""",
    "all_kmers": "select a * 676 + b * 26 + c as bid, chr(cast(65 + a as integer)) || chr(cast(65 + b as integer)) || chr(cast(65 + c as integer)) as kmer from range(26) x(a), range(26) y(b), range(26) z(c)",
    "stream_first_seen": "select distinct cast(least(l_partkey, l_suppkey) as bigint) as id1, cast(greatest(l_partkey, l_suppkey) as bigint) as id2 from lineitem where l_partkey <> l_suppkey",
    "kmer_boundaries": f"with {_BENCH} select count(distinct kmer) as n_buckets from {_slide('bench', 5)}",
}
