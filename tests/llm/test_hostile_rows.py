"""Rows that repeat ids, clash in names or lack values, and the pipeline on them."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from statewalk.llm.quality import distinct_in_blocks, fit_quality
from statewalk.llm.secrets import redact_secrets
from statewalk.llm.simhash import first_of_groups
from statewalk.llm.warc import read_index, write_archives
from statewalk.sources.store import scratch_path

PLACE = "/root/testdata/sf0.001"


def words(seed, n=60):
    return " ".join(random.Random(seed).choices(["one", "two", "three", "four", "five", "six", "seven"], k=n))


A, B, C = (words(i) for i in range(3))


@pytest.mark.parametrize(
    "rows,want",
    [
        ([(1, A), (2, A), (2, B)], [(1, A), (2, B)]),
        ([(2, B), (2, C)], [(2, B), (2, C)]),
        ([(2, B), (2, B), (3, B)], [(2, B)]),
        ([(None, A), (None, A), (None, C), (4, C)], [(None, A), (4, C)]),
        ([(5, ""), (6, None), (7, A)], [(5, ""), (7, A)]),
        ([], []),
    ],
)
def test_one_row_of_each_group_stays(spark, rows, want):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "doc_id as id", "1 as fp", "2 as root", "3 as _fp")
    got = first_of_groups(docs)
    assert got.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter(want)


def test_a_column_named_spans_stays(spark):
    docs = spark.createDataFrame([(1, 'token = "abcdefghijklmnop" end', 7), (1, None, 8)], "doc_id bigint, text string, spans int")
    got = {r["spans"]: r["text"] for r in redact_secrets(docs).collect()}
    assert got == {7: "[SECRET] end", 8: None} or got == {7: '[SECRET]" end', 8: None}
    assert redact_secrets(docs.limit(0)).count() == 0


def test_pages_with_text_ids(spark):
    rows = [("x", None, "<p>a</p>"), ("10", "http://a.org/", "<p>a</p>"), ("y y", "http://b.org/", None)]
    place = scratch_path(spark, "warc-text")
    write_archives(spark.createDataFrame(rows, "page_id string, url string, html string"), place)
    got = {r["id"]: r for r in read_index(spark, place, "string").collect()}
    assert got["10"]["record_type"] == "response" and got["x"]["refers_to"] == "10"
    assert got["y y"]["payload_bytes"] == 0


def test_all_words_count():
    assert distinct_in_blocks([]) == 0.0
    assert distinct_in_blocks([b"a"] * 200 + [b"b", b"c"]) == pytest.approx((1 / 200 + 1) / 2)
    assert distinct_in_blocks([bytes([i % 250]) for i in range(400)]) == 1.0


def test_pipeline_stages_on_hostile_rows(spark):
    docs = spark.read.parquet(f"{PLACE}/documents.parquet")
    odd = docs.limit(20).unionByName(docs.limit(20)).unionByName(
        spark.createDataFrame([(None, None, None, None, None), (-5, "", None, "s", 0), (-5, A, "en", None, 3)], docs.schema)
    )
    clashing = odd.selectExpr("*", "1 as score", "2 as predicted", "3 as spans", "4 as n_hit", "5 as fp", "'x' as id", "6 as words", "7 as row", "8 as key")
    for rows in (clashing, clashing.limit(0)):
        now = rows
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before = now.count()
            now = stage(spark, now, PLACE).cache()
            assert now.columns == rows.columns and now.count() <= before, name
            assert now.where("score <> 1 or predicted <> 2 or spans <> 3").count() == 0, name
        assert corpus_pipeline.STAGES[-1][1](spark, now, PLACE).count() <= now.count()
    assert fit_quality(docs.limit(0), spark.read.parquet(f"{PLACE}/labels.parquet")).score is not None
