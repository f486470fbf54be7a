"""Published tables, and lookups in tables that stay where they are stored."""

import glob
import json
import os

import pytest
from plain import arrays, fold
from pyspark.sql import functions as F

import statewalk.operators.joins as joins
from statewalk.functions.algebra import STATE_FIELDS, identity_struct
from statewalk.operators.replay import lookup_paths, lookup_stored, replay_inverse, replay_trace
from statewalk.plans import stages
from statewalk.sources.store import bucket_paths, cut, publish, published, scratch_path


def test_a_table_is_published_whole(spark):
    place = scratch_path(spark, "published")
    assert published(spark, place, "squares") is None
    rows = spark.range(50).select(F.col("id").alias("n"), (F.col("id") * F.col("id")).alias("square"))
    first = publish(rows.repartition(3), place, "squares")
    assert sorted(first.collect()) == sorted(rows.collect())
    again = publish(rows.where("n < 5"), place, "squares")  # the first one holds
    assert again.count() == 50 and again.schema == first.schema
    with pytest.raises(ValueError, match="holds 'squares'"):
        published(spark, place, "cubes")


def test_unfinished_and_torn_tables(spark):
    place = scratch_path(spark, "torn")
    spark.range(7).write.parquet(f"{place}/rows-unfinished")  # a writer that died before its manifest
    assert published(spark, place, "ids") is None
    publish(spark.range(10).repartition(2), place, "ids")
    folder = json.load(open(f"{place}/manifest.json"))["folder"]
    part = max(glob.glob(f"{place}/{folder}/part-*"), key=os.path.getsize)
    os.rename(part, f"{place}/{folder}/_gone")
    with pytest.raises(ValueError, match="is torn"):
        published(spark, place, "ids")
    os.rename(f"{place}/.manifest.json.crc", f"{place}/.old.crc")
    with open(f"{place}/manifest.json", "w") as out:
        out.write('{"folder": "x"')
    with pytest.raises(ValueError, match="cannot be read"):
        published(spark, place, "ids")


def test_a_stage_table_builds_itself_where_it_is_missing(spark, monkeypatch):
    place = scratch_path(spark, "stage")
    assert stages.stage_table(spark, 1, place).count() == 2048
    monkeypatch.setattr(stages, "build_stage", None)  # from now on it is only read
    assert stages.stage_table(spark, 1, place).count() == 2048
    with pytest.raises(ValueError, match="not 'paths of stage 2"):
        stages.stage_table(spark, 2, place)


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("limit", [2, 1024])
def test_stored_paths_do_not_move(spark, monkeypatch, how, limit):
    monkeypatch.setattr(joins.hot_keys, "__defaults__", (limit, 10_000_000))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        paths = spark.range(500).select(F.concat(F.lit("s"), "id").alias("state"), F.array(F.lit("a"), F.col("id").cast("string")).alias("path"))
        stored = bucket_paths(paths, 8)
        key = F.when(F.col("id") % 3 == 0, F.lit("s7")).when(F.col("id") % 3 == 1, F.concat(F.lit("s"), F.col("id")))
        entries = cut(spark.range(3_000).select("id", key.alias("state")))
        found = lookup_stored(entries, stored, how=how)
        plan = found._jdf.queryExecution().executedPlan().toString()
        stored_side = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert "Bucketed: true" in plan and len(stored_side) == 1  # the entries
        want = lookup_paths(entries, paths.select("state", F.array_join("path", " ").alias("path_text")), how=how, small=True)
        rows = lambda df: sorted((r["id"], r["state"], r["path"]) for r in df.select("id", "state", "path").collect())
        assert sorted(map(str, rows(found) if how == "inner" else [tuple(r) for r in found.select("id", "state", "path").collect()])) == sorted(
            map(str, rows(want) if how == "inner" else [tuple(r) for r in want.select("id", "state", "path").collect()])
        )
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_broken_paths(spark):
    start = [c.alias(f) for f, c in zip(STATE_FIELDS, [identity_struct()[f] for f in STATE_FIELDS])]
    rows = spark.createDataFrame([(1, ["U", "R"]), (2, ["U", "?", "F2"]), (3, ["?"]), (4, [])], "k int, path array<string>").select("*", *start)
    assert {r["k"] for r in replay_inverse(rows).collect()} == {1, 4}
    got = {r["k"]: r for r in replay_inverse(rows, keep_broken=True).collect()}
    assert {k: (r["broken"], r["applied"]) for k, r in got.items()} == {1: (False, ["r", "u"]), 2: (True, ["F2"]), 3: (True, []), 4: (False, [])}
    assert arrays(got[2]) == fold(["F2"])[0] and arrays(got[3]) == fold([])[0]
    steps = replay_trace(rows).groupBy("k").count().collect()
    assert {r["k"]: r["count"] for r in steps} == {1: 3, 2: 2, 3: 1, 4: 1}
    assert {r["k"] for r in replay_trace(rows, keep_broken=False).collect()} == {1, 4}
