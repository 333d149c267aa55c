"""Every query with SQL gives the rows of its SQL."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
from kinweave.functions.scoring import BLOSUM62, residue_codes
from kinweave.plans import queries
from test_align import plain

SF = "/root/testdata/sf0.001"
SLOW = {"occurrences_by_pair", "pair_costs", "exact_match_length_filtered", "tile_counts"}


@pytest.fixture
def con():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "part", "nation", "orders", "lineitem"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(set(queries.ORACLE_SQL) - SLOW))
def test_query_against_sql(spark, con, name):
    mine = queries.QUERIES[name](spark, SF)
    sql = con.sql(queries.ORACLE_SQL[name])
    columns = sorted(mine.columns)
    assert columns == sorted(sql.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r) for r in mine.select(*columns).collect()), key=key) == sorted(sql.select(*columns).fetchall(), key=key)


def test_benchmark_edges_cell_by_cell(spark):
    """No SQL is fast enough for whole texts; every candidate pair is aligned cell by cell instead."""
    seqs = {r["sid"]: r["seq"] for r in queries.benchmark(spark, SF).collect()}
    share = lambda a, b: any(a[i : i + 8] in b for i in range(len(a) - 7))
    diagonal = {c: int(BLOSUM62[residue_codes()[ord(c)], residue_codes()[ord(c)]]) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    expected = {}
    for a in seqs:
        for b in seqs:
            x, y = seqs[a], seqs[b]
            if a < b and share(x, y) and 100 * min(len(x), len(y)) >= 32 * max(len(x), len(y)):
                score, matches, length = plain(x, y, "sw", True)
                longer, most = (x if len(x) > len(y) else y), max(len(x), len(y))
                own = sum(diagonal[c] for c in longer)
                edge = score > 0 and length * 100 >= 80 * most and matches * 100 >= 40 * length and score * 100 >= 30 * own
                expected[a, b] = (round(length / most, 9), round(matches / length, 9), round(int(score) / own, 9), bool(edge))
    got = {(r["id1"], r["id2"]): (r["a"], r["b"], r["c"], r["is_edge"]) for r in queries.benchmark_edges(spark, SF).collect()}
    assert got == expected and len(got) > 20


def test_contamination_edges_cell_by_cell(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("length(text) < 1500")
    items = [(1, "the plain item text that a document holds as it is written here"), (2, "another passage of some length about other matters"), (3, "nobody holds this")]
    extra = [(900001, "Before. The plain item text that a document holds as it is WRITTEN here; after."), (900002, "the plain item text that a document holds, or a part"), (900003, None), (900004, "")]
    docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = lambda t: re.sub("[^A-Za-z]", "", t or "").upper()
    got = {(r["doc_id"], r["item_id"]): (r["score"], r["matches"], r["length"], r["held"]) for r in queries.contamination_edges(spark, str(tmp_path)).collect()}
    expected = {}
    for i in (900001, 900002):
        item, doc = clean(items[0][1]), clean(dict(extra)[i])
        score, matches, length = map(int, plain(item, doc, "sw", True))
        expected[i, 1] = (score, matches, length, round(matches / len(item), 9))
    assert got == expected


def test_entry(spark):
    assert entry.entry(spark).columns == ["id1", "id2", "a", "b", "c", "is_edge"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
