"""What the plans of edge searches and lookups read, move and leave behind."""

import glob
import random

import pytest
from plain import bfs
from pyspark.sql import functions as F

import statewalk.operators.search as search
from statewalk.operators.joins import keys_over, lookup_join
from statewalk.operators.numbering import numbered
from statewalk.operators.search import Adjacency, Forest, Visited, bfs_paths, dedupe_new
from statewalk.sources.store import cut, scratch_path, scratch_scope, shared_folder, write_bucketed as search_write


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_scanned(spark, df):
    """Rows that come out of the file scans of a plan, after it ran."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        executed = df._jdf.queryExecution()
        df._jdf.collectToPython()
        leaves, found = executed.executedPlan().collectLeaves(), 0
        for i in range(leaves.size()):
            metric = leaves.apply(i).metrics().get("numOutputRows")
            found += metric.get().value() if metric.isDefined() else 0
        return found
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def as_dict(found):
    return {r["node"]: (r["distance"], list(r["path"])) for r in found.collect()}


@pytest.mark.parametrize("start", [0, 1 << 40])
def test_numbers_are_dense_and_in_order(spark, start):
    rng = random.Random(start)
    rows = [(rng.randrange(500), f"n{i}") for i in range(3000)]
    got = numbered(cut(spark.createDataFrame(rows, "a int, b string").repartition(7)), ["a", "b"], "id", start).collect()
    assert [r["id"] for r in sorted(got, key=lambda r: (r["a"], r["b"]))] == list(range(start, start + 3000))
    assert numbered(spark.createDataFrame([], "a int"), ["a"], "id").count() == 0


def test_a_small_level_reads_few_edges(spark, monkeypatch):
    monkeypatch.setattr(search, "GROUP_ROWS", 100)
    chain = spark.range(9_999).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    graph = Adjacency(chain, directed=False)
    assert graph.edges.count() == 19_998
    forest = Forest(spark, graph.low, graph.high)
    one = forest.add(spark.createDataFrame([(5_000, None)], "node bigint, parent bigint"))
    near = graph.near(one)
    assert sorted(r["dst"] for r in near.collect()) == [4_999, 5_001]
    assert rows_scanned(spark, graph.near(one)) <= 2 * 100
    # a span of many nodes: the scan skips what lies beyond
    span = forest.add(spark.range(6_000, 6_100).select(F.col("id").alias("node"), F.lit(0).cast("bigint").alias("parent")))
    assert span.nodes is None and span.size == 100
    read = rows_scanned(spark, graph.near(span))
    assert 200 <= read <= 200 + 2 * 100 * graph.buckets < 19_998 / 4
    assert graph.neighbours(span).count() == 200


def test_only_a_part_of_the_edges_is_sketched(spark):
    pairs = cut(spark.range(64_000).select(F.col("id").alias("src"), (F.col("id") * 7 % 64_000 + 64_000).alias("dst")))
    whole, part = search.measures(pairs.unionByName(pairs))
    # all edges go through compiled aggregates only; quantiles and sketches see one in PART of them
    assert "ObjectHashAggregate" not in plan(whole) and "ObjectHashAggregate" in plan(part)
    assert plan(part).index("Filter", plan(part).rindex("ObjectHashAggregate")) > 0
    assert tuple(whole.first()) == (128_000, 0, 127_999)
    src, dst, n, distinct = part.first()
    # equal pairs are in the part together
    assert 1_600 <= n <= 2_400 and n % 2 == 0 and abs(distinct - n / 2) < n / 10
    assert len(src) == len(dst) == search.RANGES - 1
    assert all(abs(q - 2_000 * i) < 4_000 for i, q in enumerate(src, 1)) and all(abs(q - 64_000 - 2_000 * i) < 4_000 for i, q in enumerate(dst, 1))
    graph = Adjacency(pairs.unionByName(pairs), directed=True)
    assert graph.edges.count() == 64_000 and graph.bounds == sorted({*src, *dst})
    empty = Adjacency(pairs.limit(0), directed=True)
    assert (empty.low, empty.high, empty.bounds) == (0, 1, [])


def test_levels_are_hash_aggregates_on_numbers(spark):
    edges = spark.createDataFrame([(f"n{i % 40}", f"n{i * 7 % 61}") for i in range(300)], "src string, dst string")
    pairs = cut(edges.distinct())
    names = search.node_numbers(pairs, spark.createDataFrame([("n0",)], "node string"))
    assert [r["name"] for r in names.orderBy("id").collect()] == sorted({r["name"] for r in names.collect()})
    ids = {r["name"]: r["id"] for r in names.collect()}
    numbers = spark.createDataFrame([(ids[a], ids[b]) for a, b in pairs.collect()], "src bigint, dst bigint")
    graph = Adjacency(numbers, directed=False)
    forest = Forest(spark, graph.low, graph.high)
    level = forest.add(spark.createDataFrame([(0, None)], "node bigint, parent bigint"))
    found = dedupe_new(graph.neighbours(level), level.rows.select("node"), "node", F.min("parent").alias("parent"))
    assert "HashAggregate" in plan(found) and "SortAggregate" not in plan(found)


def test_visited_nodes_do_not_move(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        visited = Visited(spark, 8)
        visited.append(spark.range(100).select(F.col("id").alias("node")))
        visited.append(spark.range(200, 300).select(F.col("id").alias("node")))
        found = visited.without(spark.range(0, 400, 2).groupBy(F.col("id").alias("node")).agg(F.min("id").alias("parent")))
        assert plan(found).count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan(found)
        assert sorted(r["node"] for r in found.collect()) == [*range(100, 200, 2), *range(300, 400, 2)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_visited_nodes_are_written_together_again(spark, monkeypatch):
    monkeypatch.setattr(search, "COMPACT_EVERY", 2)
    edges = [(f"n{i:02}", f"n{i + 1:02}") for i in range(7)] + [("n07", "n00"), ("n03", "n01")]
    found = bfs_paths(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([("n00",)], "node string"), directed=True)
    assert as_dict(found) == bfs(edges, ["n00"], 20, True)


@pytest.mark.parametrize("directed", [False, True])
@pytest.mark.parametrize("small", [-1, 3, 100_000])
def test_the_smallest_path_wins(spark, monkeypatch, directed, small):
    monkeypatch.setattr(search, "SMALL_LEVEL", small)
    # the smallest predecessor of t is c, the smallest path goes by z
    edges = [("s", "b"), ("s", "a"), ("a", "z"), ("b", "c"), ("z", "t"), ("c", "t"), ("t", "u"), ("s2", "b")]
    rng = random.Random(11)
    edges += [(f"m{rng.randrange(9)}", f"m{rng.randrange(9)}") for _ in range(14)] + [("s", "m1"), (None, "x"), ("y", None)]
    df = spark.createDataFrame(edges, "src string, dst string")
    found = as_dict(bfs_paths(df, spark.createDataFrame([("s",), ("s2",), (None,)], "node string"), directed=directed))
    assert found["t"] == (3, ["s", "a", "z", "t"])
    assert found == bfs([e for e in edges if None not in e and e[0] != e[1]], ["s", "s2"], 20, directed)


def test_a_search_drops_what_it_wrote(spark):
    folder = shared_folder(spark)
    tables, before = {t.name for t in spark.catalog.listTables()}, set(glob.glob(f"{folder}/*"))
    with scratch_scope(spark) as scope:
        edges = spark.createDataFrame([(i, i // 2) for i in range(1, 60)], "src int, dst int")
        kept = scope.keep(bfs_paths(edges, spark.createDataFrame([(0,)], "node int"), directed=False).where("distance < 3"))
        other = scratch_path(spark, "left")
        kept.write.parquet(other)
    assert {t.name for t in spark.catalog.listTables()} == tables
    left = set(glob.glob(f"{folder}/*")) - before
    assert len(left) == 1 and kept.count() == 1 + 1 + 2
    assert kept.schema["node"].dataType.simpleString() == "int"


def test_rows_without_a_key_spread(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        many = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("k"), F.col("id").alias("v"))
        one = spark.range(0, 20_000, 4).select(F.col("id").alias("k"), (F.col("id") * 3).alias("w"))
        joined = lookup_join(cut(many), cut(one), "k", "left", small=False)
        sizes = [r["n"] for r in joined.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert sum(sizes) == 20_000 and max(sizes) < 2 * 20_000 / 8
        assert joined.where("k is null and w is null").count() == 10_000
        assert joined.where("w = 3 * k").count() == 5_000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.mark.parametrize("names", [["", "o1", "o10", "o9", "o100", "p0", "c", "0", "00"], ["", "-", "a b", "A", "Z~", "~", "a", "aA"]])
def test_packed_names_keep_their_order(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "node string")
    code = search.name_code(df.select(F.col("node").alias("src"), F.col("node").alias("dst")), df.limit(0))
    packed = df.select("node", code.pack("node").alias("n")).select("node", "n", code.text("n").alias("back")).collect()
    assert [r["node"] for r in sorted(packed, key=lambda r: r["n"])] == sorted(names)
    assert all(r["back"] == r["node"] for r in packed)


@pytest.mark.parametrize("odd", ["été", "x" * 40, "nul\0", "".join(map(chr, range(48, 90)))])
def test_names_that_do_not_pack_are_numbered(spark, odd):
    edges = [("n0", "n1"), ("n1", odd), ("n1", "n2"), ("n2", odd), (odd, "n4"), ("n0", "n1")]
    df = spark.createDataFrame(edges, "src string, dst string")
    seeds = spark.createDataFrame([("n0",)], "node string")
    assert search.name_code(df, seeds) is None
    assert as_dict(bfs_paths(df, seeds, directed=True)) == bfs(edges, ["n0"], 20, True)


def test_short_names_are_not_joined_and_edges_move_once(spark, monkeypatch):
    monkeypatch.setattr(search, "node_numbers", lambda *_: pytest.fail("short names were numbered"))
    written = []
    monkeypatch.setattr(search, "write_bucketed", lambda df, *a: written.append((df, a)) or search_write(df, *a))
    edges = [(f"o{i % 50}", f"p{i % 7}") for i in range(500)]  # every edge ten times or so
    found = bfs_paths(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([("p0",)], "node string"))
    assert as_dict(found) == bfs(edges, ["p0"], 20, False)
    ((rows, args),) = written
    assert "Exchange" not in plan(rows) and args[-1]


def test_keys_are_counted_in_classes_that_can_hold_them(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"))
    rows = rows.unionByName(spark.range(60).select(F.lit(None).cast("bigint").alias("k")))
    found = keys_over(rows, ["k"], lambda n: n > 50)
    assert {r["k"]: r["n_rows"] for r in found.collect()} == {7: 2501, None: 60}
    assert keys_over(rows, ["k"], lambda n: n > 5000).count() == 0


def test_letters_with_numbers_are_packed_without_a_pass_over_their_characters(spark, monkeypatch):
    monkeypatch.setattr(search, "name_code", lambda *_: pytest.fail("characters were counted"))
    rng = random.Random(5)
    edges = [(f"o{rng.randrange(120)}", f"p{rng.randrange(30)}") for _ in range(200)] + [("p9", "c999999999999999"), ("p3", "o0"), (None, "p1")]
    found = bfs_paths(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([("p3",), ("p9",)], "node string"))
    assert as_dict(found) == bfs([e for e in edges if None not in e], ["p3", "p9"], 20, False)


def test_numbers_behind_a_letter_keep_their_order(spark):
    names = ["o0", "o1", "o10", "o100", "o11", "o9", "o99", "p0", "p5", "a7", "~123456", "07", "\x017", "p100000"]
    df = spark.createDataFrame([(n,) for n in names], "node string")
    code, pairs, _ = search.key_coded(df.select(F.col("node").alias("src"), F.col("node").alias("dst")), df.limit(0))
    assert code.digits == 6
    packed = pairs.select("src", code.text("src").alias("back")).collect()
    assert [r["back"] for r in sorted(packed, key=lambda r: r["src"])] == sorted(names)
    assert len({r["src"] for r in packed}) == len(names)


def test_other_names_are_not_taken_for_letters_with_numbers(spark):
    seeds = spark.createDataFrame([("o1",)], "node string")
    odd = ["o01", "o", "", "o 1", "o1 ", "o+1", "o-1", "o1.0", "o1e2", "é1", "oo1", "o1234567890123456", "o" + "9" * 40]
    rows = spark.createDataFrame([(n,) for n in odd], "n string").select("n", search.KeyCode.loose("n").alias("code"))
    assert [r["n"] for r in rows.where("code is not null").collect()] == []
    edges = [("o1", "o2"), ("o2", "o01"), ("o01", "o3"), ("o1", "o11")]
    df = spark.createDataFrame(edges, "src string, dst string")
    assert search.key_coded(df, seeds) is None
    many = spark.range(3000).select(F.concat(F.lit("o"), F.col("id")).alias("src"), F.lit("p1").alias("dst")).coalesce(1)
    assert search.key_coded(many.unionByName(df), seeds) is None  # behind the rows looked at first
    assert as_dict(bfs_paths(df, seeds)) == bfs(edges, ["o1"], 20, False)


def test_a_filter_of_edges_names_few_spans():
    spans = [(i * 100, i * 100 + 50 + i) for i in range(40)]
    few = search.joined_spans(spans[::-1], 6)
    assert few == [(0, 50), (100, 151), (200, 252), (300, 353), (400, 454), (500, 3989)]
    assert search.joined_spans(spans[:3], 6) == spans[:3] and search.joined_spans([], 6) == []
