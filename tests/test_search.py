import random

import pytest
from plain import bfs
from pyspark.sql import functions as F

import statewalk.operators.search as search
from statewalk.functions.algebra import TOKENS
from statewalk.functions.keys import canonical
from statewalk.functions.successors import OrbitKeys, TextKeys
from statewalk.operators.search import PathCode, bfs_paths, bfs_states, dedupe_new, expand, expand_n
from statewalk.plans.stages import KEYS, LAYOUTS, _next_canonical, build_stage, stage_tokens
from statewalk.sources.fixed import STAGE_SEEDS

GOLDEN = {
    1: [1, 2, 25, 202, 620, 900, 285, 13],
    2: [1, 2, 17, 134, 1065, 8190, 54694, 267576, 560568, 187204, 3114],
    3: [6, 12, 54, 216, 744, 3180, 10836, 22392, 30948, 42420, 43308, 19212, 2928, 144],
    4: [1, 6, 27, 120, 519, 1932, 6484, 20310, 55034, 113892, 178495, 179196, 89728, 16176, 1488, 144],
}


def as_dict(found):
    return {r["node"]: (r["distance"], list(r["path"])) for r in found.collect()}


def graph(seed, hub):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(60)]
    edges += [("n1", "n1"), edges[0], edges[0], ("far1", "far2")]  # loop, copies, island
    if hub:
        edges += [("n0", f"h{i}") for i in range(40)] + [(f"h{i}", "n7") for i in range(0, 40, 3)]
    return edges


@pytest.mark.parametrize("directed", [False, True])
@pytest.mark.parametrize("large", [False, True])
def test_bfs_equals_plain(spark, monkeypatch, directed, large):
    if large:
        monkeypatch.setattr(search, "SMALL_LEVEL", -1)  # always the salted, shuffled way
    edges = graph(5, hub=True)
    seeds = ["n0", "n3", "nowhere"]
    found = bfs_paths(
        spark.createDataFrame(edges, "src string, dst string"),
        spark.createDataFrame([(s,) for s in [*seeds, "n0"]], "node string"),
        6,
        directed=directed,
        per_salt=4,
    )
    assert as_dict(found) == bfs(edges, seeds, 6, directed)


def test_bfs_limits(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    one = spark.createDataFrame([("a",)], "node string")
    assert as_dict(bfs_paths(edges, one, 0)) == {"a": (0, ["a"])}
    assert set(as_dict(expand_n(edges, one, 1))) == {"a", "b"}
    none = spark.createDataFrame([], "node string")
    assert as_dict(bfs_paths(edges, none, 3)) == {}
    empty = spark.createDataFrame([], "src string, dst string")
    assert as_dict(bfs_paths(empty, one, 3)) == {"a": (0, ["a"])}


def test_teaching_steps(spark):
    keys = TextKeys(LAYOUTS[1])
    code = PathCode(TOKENS, 7)
    seed = spark.createDataFrame([("0" * 12,)], "state string").select("state", code.start().alias("path"))
    once = expand(seed, keys.moves(code.tokens), keys.successor, code.extend())
    assert once.count() == 18
    assert dedupe_new(once, seed, "state", F.min("path").alias("path")).count() == 2
    assert build_stage(spark, 1, max_depth=2).count() == 28


@pytest.mark.parametrize("number, depth", [(1, 7), (2, 6), (3, 5), (4, 6)])
def test_stage_levels(spark, number, depth):
    found = build_stage(spark, number, max_depth=depth)
    counts = {r["distance"]: r["count"] for r in found.groupBy("distance").count().collect()}
    assert [counts[d] for d in range(depth + 1)] == GOLDEN[number][: depth + 1]
    assert found.select("state").distinct().count() == sum(counts.values())


def test_stage_sizes(stage_tables):
    assert [stage_tables[k].count() for k in (1, 2, 3, 4)] == [2048, 1082565, 176400, 663552]


def test_packed_search_equals_text_search(spark):
    def next_text(rows):
        rows = TextKeys(LAYOUTS[3]).successor(rows)
        whole = F.concat(canonical(F.col("_corners")), F.substring("state", 9, 12))
        return rows.withColumn("_corners", F.substring("state", 1, 8)).withColumn("state", whole)

    for number in (1, 2, 3, 4):
        text = TextKeys(LAYOUTS[number])
        seeds = spark.createDataFrame([(s,) for s in STAGE_SEEDS[number]], "state string")
        a = bfs_states(seeds, text, stage_tokens(number), 4, next_state=next_text if number == 3 else None)
        b = build_stage(spark, number, 4)
        rows = lambda df: sorted((r["state"], r["distance"], list(r["path"])) for r in df.collect())
        assert rows(a) == rows(b)
    assert KEYS[2].pack("00000000000000001111") == 15


def test_long_paths_are_carried_as_arrays(spark):
    seeds = spark.createDataFrame([("0" * 12,)], "state string")
    assert not PathCode(TOKENS, 13).packed
    a = bfs_states(seeds, TextKeys(LAYOUTS[1]), TOKENS, 13)
    b = build_stage(spark, 1)
    rows = lambda df: sorted((r["state"], r["distance"], list(r["path"])) for r in df.collect())
    assert rows(a) == rows(b)


@pytest.mark.parametrize("directed", [False, True])
def test_a_long_chain_is_walked_to_its_end(spark, directed):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "src int, dst int")
    found = bfs_paths(edges, spark.createDataFrame([(0,)], "node int"), directed=directed)
    assert {r["node"]: r["path"] for r in found.collect()} == {i: list(range(i + 1)) for i in range(41)}


def test_stage_levels_are_hash_aggregates(spark):
    for number, keys in KEYS.items():
        seeds = spark.createDataFrame([(keys.pack(s),) for s in STAGE_SEEDS[number]], f"state {keys.type}")
        code = PathCode(stage_tokens(number), 15)
        level = seeds.select("state", code.start().alias("path"))
        step = _next_canonical if number == 3 else keys.successor
        found = dedupe_new(expand(level, keys.moves(code.tokens), step, code.extend()), level, "state", F.min("path").alias("path"))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert code.packed == (number > 1) and keys.type == "bigint"
        if code.packed:
            assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_orbits_are_kept(spark):
    keys = KEYS[4]
    assert sorted({tuple(o) for o in keys.orbits[8:]}) == sorted({tuple(o) for o in keys.orbits[8:] if len(o) == 4})
    for text in (STAGE_SEEDS[4][0], "123056740123456789AB"):
        try:
            packed = keys.pack(text)
        except ValueError:
            assert text != STAGE_SEEDS[4][0]
            continue
        assert spark.range(1).select(keys.text(F.lit(packed))).first()[0] == text
    with pytest.raises(ValueError, match="leaves the orbits"):
        keys.moves(["U"])
    with pytest.raises(ValueError):
        OrbitKeys([("edge", "ori")], ["U2"])


def test_one_way_tokens_and_no_seeds(spark):
    keys = TextKeys(LAYOUTS[4])
    seeds = spark.createDataFrame([(keys.pack(STAGE_SEEDS[4][0]),)], f"state {keys.type}")
    found = bfs_states(seeds, keys, ["U"], 8).collect()
    assert sorted(r["distance"] for r in found) == [0, 1, 2, 3]
    assert len({r["state"] for r in found}) == 4
    assert bfs_states(seeds.limit(0), keys, ["U", "u"], 3).count() == 0
