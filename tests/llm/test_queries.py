"""The queries of this subpackage on the smallest tables, against SQL or against each other."""

import collections
import glob
import os

import duckdb
import pytest

from quillstream.llm.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want = c.sql(ORACLE[name]).df()
    got = QUERIES[name](spark, DATA).toPandas()[list(want.columns)]
    assert sorted(map(str, got.values.tolist())) == sorted(map(str, want.values.tolist()))


def test_pieces(spark):
    """Pieces cover recordings without a hole, overlap as asked and are short enough."""
    limit = {r.dataset_id: (round(r.max_piece_sec * 1000), round(r.overlap_sec * 1000)) for r in spark.read.parquet(f"{DATA}/run_settings.parquet").collect()}
    by = collections.defaultdict(list)
    for r in QUERIES["p2_pieces"](spark, DATA).orderBy("piece_no").collect():
        by[r.dataset_id, r.audio_file].append(r)
    for (d, _), ps in by.items():
        assert [p.piece_no for p in ps] == list(range(1, len(ps) + 1)) and ps[-1].cut == "end"
        assert all(p.end_ms - p.begin_ms <= limit[d][0] for p in ps)
        assert all(a.end_ms - b.begin_ms == limit[d][1] for a, b in zip(ps, ps[1:]))


def test_found_texts_are_those_that_change(spark):
    texts = {(r.text_table, r.record_id): r.unified for r in QUERIES["p4_texts"](spark, DATA).collect()}
    found = {(r.text_table, r.record_id) for r in QUERIES["p4_found"](spark, DATA).collect()}
    assert found and found <= set(texts)


def test_packed(spark):
    cap = {r.target_name: r.capacity_tokens for r in spark.read.parquet(f"{DATA}/pack_targets.parquet").collect()}
    fill, docs = collections.Counter(), collections.defaultdict(set)
    for r in QUERIES["p6_packed"](spark, DATA).collect():
        fill[r.target_name, r.container_id] += r.n_tokens
        docs[r.target_name].add(r.doc_id)
    assert all(n <= cap[t] for (t, _), n in fill.items())
    n = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").distinct().count()
    assert {t: len(d) for t, d in docs.items()} == {t: n for t in cap}


def test_packing_report(spark):
    """At most one container in a hundred, and one more, above what no packing can go below."""
    for r in QUERIES["p6_report"](spark, DATA).collect():
        assert r.least_containers <= r.n_containers <= 1.01 * r.least_containers + 1


@pytest.mark.parametrize("name", ["p7_found", "p7_items", "p8_found", "p8_stretches", "p6_report"])
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
