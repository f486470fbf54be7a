import glob
import os
import re

import brute
import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from check import rows_of
from statewalk.llm import runlength
from statewalk.llm.catalog import QUERIES
from statewalk.llm.oracle import ORACLE

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = QUERIES[name](spark, SF_DIR)
    want = con.execute(ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got and got == rows_of(columns, want.fetchall())


def test_repeats_query(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    want = brute.without_repeats({r["doc_id"]: r["text"] for r in docs}, 400)
    got = QUERIES["op6_remove_repeats"](spark, SF_DIR).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want


@pytest.mark.parametrize("hot", [2048, 6])
def test_repeats_of_a_larger_table(spark, monkeypatch, hot):
    """Every row of the next size, ordinary anchors and, at a bound of 6, many hot ones."""
    monkeypatch.setattr(runlength, "HOT_STRETCHES", hot)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = brute.without_repeats({r["doc_id"]: r["text"] for r in docs.collect()}, 400)
    got = runlength.without_repeats(docs).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want


def test_simhash_query(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    want = brute.fingerprint_groups({r["doc_id"]: r["text"] for r in docs})
    got = QUERIES["op9_simhash"](spark, SF_DIR).collect()
    assert {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in got} == want


def test_pipeline_stages(spark):
    """Each stage on what its predecessor kept, against plain Python."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}

    good = stages["quality classifier"](spark, docs, SF_DIR).cache()
    kept = {r["doc_id"] for r in good.collect()}
    assert kept == {r["doc_id"] for r in QUERIES["op1_quality"](spark, SF_DIR).where("predicted = 1").collect()}

    single = stages["SimHash near-dedup"](spark, good, SF_DIR).cache()
    groups = brute.fingerprint_groups({i: rows[i] for i in kept})
    kept = {r["doc_id"] for r in single.collect()}
    assert kept == {c for _, c in groups.values()}

    clean = stages["benchmark decontamination"](spark, single, SF_DIR).cache()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    hits = brute.contamination({i: rows[i] for i in kept}, items)
    kept = {r["doc_id"] for r in clean.collect()}
    assert kept == {i for i, (_, n, _) in hits.items() if not n}

    safe = stages["secret scans"](spark, clean, SF_DIR).cache()
    got = {r["doc_id"]: r["text"] for r in safe.collect()}
    assert got.keys() == kept and safe.columns == docs.columns
    for i, text in got.items():
        assert "[SECRET]" in text if brute.base_spans(rows[i]) else len(text) <= len(rows[i])
        assert not re.search(r"AKIA[A-Z0-9]{14}", text)

    mixed = stages["mixing to target weights"](spark, safe, SF_DIR).collect()
    size = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    total, widest = safe.agg(F.sum(size), F.max(size)).first()
    assert abs(sum(r["taken"] for r in mixed) - 1.5 * total) <= 2 * widest * safe.select("source").distinct().count()
    assert {r["doc_id"] for r in mixed} <= kept
