import random

import pytest
from plain import arrays, fold
from pyspark.sql import functions as F

from statewalk.functions.algebra import TOKENS, int_array
from statewalk.operators.fold import (
    _levels,
    concat_trace,
    explode_tokens,
    fold_events,
    fold_history,
    last_state,
    ordered_blocks,
)
from statewalk.sources.store import cut


def sequences():
    rng = random.Random(11)
    out = {k: rng.choices(TOKENS, k=rng.randrange(1, 25)) for k in range(6)}
    out["hot"] = rng.choices(TOKENS, k=300)
    out = {str(k): v for k, v in out.items()}
    out["unknown"] = ["U", "X", "R"]
    out["double space"] = ["U", "", "R"]
    out["null"] = ["F", None, "R"]
    return out


def events(spark):
    rows = [(k, i, t) for k, tokens in sequences().items() for i, t in enumerate(tokens)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "k string, i int, t string").repartition(5)


@pytest.mark.parametrize("bits", [1, 3, 10])
def test_fold_in_blocks_equals_plain(spark, bits):
    got = {r["k"]: r for r in fold_events(events(spark), "k", "i", "t", bits=bits).collect()}
    for k, tokens in sequences().items():
        state, n = fold(tokens)
        assert arrays(got[k]) == state, k
        assert (got[k]["n_applied"], got[k]["n_tokens"]) == (n, len(tokens))


def test_folds_from_another_state_and_levels(spark):
    tokens = ["R", "u", "F2"]
    begin, _ = fold(tokens)
    lists = [begin[kind][part] for kind in ("pos", "ori") for part in ("corner", "edge")]
    names = ["corner_pos", "edge_pos", "corner_ori", "edge_ori"]
    init = F.struct(*[int_array(values).alias(name) for name, values in zip(names, lists)])
    known = events(spark).where("k in ('hot', '3')")
    got = {r["k"]: r for r in fold_events(known, "k", "i", "t", init=init, bits=1).collect()}
    steps = {(r["k"], r["i"]): r for r in fold_history(known, "k", "i", "t", init=init, bits=1).collect()}
    for k in ("hot", "3"):
        mine = sequences()[k]
        assert arrays(got[k]) == fold(tokens + mine)[0] == arrays(steps[k, len(mine) + 1])
        assert arrays(steps[k, 1]) == begin
    blocks = cut(ordered_blocks(known, ["k"], ["i"], F.col("t"), 1).selectExpr("k", "_block", "size(items) AS value"))
    levels = _levels(blocks, ["k"], 1, lambda v: F.aggregate(v, F.lit(0), lambda a, x: a + x))
    assert len(levels) >= 4
    assert all(r["s"] == len(sequences()[r["k"]]) for r in levels[-1].groupBy("k").agg(F.sum("value").alias("s")).collect())
    assert levels[-1].groupBy("k").count().where("count > 2").isEmpty()


@pytest.mark.parametrize("bits", [1, 8])
def test_history_equals_plain(spark, bits):
    history = fold_history(events(spark), "k", "i", "t", bits=bits)
    got = {(r["k"], r["i"]): r for r in history.collect()}
    want = 0
    for k, tokens in sequences().items():
        _, n = fold(tokens)
        want += n + 1
        for i in range(n + 1):
            row = got[(k, i + 1)]
            assert arrays(row) == fold(tokens[:i])[0]
            assert row["token"] == (tokens[i - 1] if i else None)
    assert len(got) == want
    last = {r["k"]: r["i"] for r in last_state(history, "k").collect()}
    assert last == {k: fold(tokens)[1] + 1 for k, tokens in sequences().items()}


@pytest.mark.parametrize("bits", [1, 10])
def test_concat(spark, bits):
    got = {r["k"]: r["result"] for r in concat_trace(events(spark), "k", "i", "t", bits=bits).collect()}
    assert got == {k: " ".join(t for t in v if t) or None for k, v in sequences().items()}
    blank = spark.createDataFrame([("a", 1, ""), ("a", 2, None)], "k string, i int, t string")
    assert concat_trace(blank, "k", "i", "t").first()["result"] is None


def test_explode_tokens(spark):
    rows = spark.createDataFrame(
        [(1, "U  R2"), (2, ""), (3, None), (4, "a.b")], "id int, text string"
    )
    got = {(r["id"], r["i"], r["token"]) for r in explode_tokens(rows, "text").collect()}
    assert got == {(1, 1, "U"), (1, 2, ""), (1, 3, "R2"), (4, 1, "a.b")}
    dots = {(r["i"], r["token"]) for r in explode_tokens(rows.where("id = 4"), "text", ".").collect()}
    assert dots == {(1, "a"), (2, "b")}
    chars = [r["token"] for r in explode_tokens(rows.where("id = 4"), "text", None).collect()]
    assert chars == ["a", ".", "b"]


def test_empty_input(spark):
    none = spark.createDataFrame([], "k string, i int, t string")
    assert fold_events(none, "k", "i", "t").count() == 0
    assert fold_history(none, "k", "i", "t").count() == 0


def test_ordinary_keys_move_once(spark):
    ordinary = cut(events(spark).where("k <> 'hot'"))
    for df in (fold_events(ordinary, "k", "i", "t", bits=5), fold_history(ordinary, "k", "i", "t", bits=5), concat_trace(ordinary, "k", "i", "t", bits=5)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1 and "rangepartitioning" not in plan


@pytest.mark.parametrize("bits", [2, 10])
def test_null_keys_are_a_key(spark, bits):
    rows = [(None, 1, i, "U") for i in range(9)] + [("a", None, i, "R") for i in range(3)] + [("a", 1, i, "F") for i in range(20)]
    df = spark.createDataFrame(rows, "k string, g int, i int, t string")
    want = {(None, 1): 9, ("a", None): 3, ("a", 1): 20}
    got = {(r["k"], r["g"]): r for r in fold_events(df, ["k", "g"], "i", "t", bits=bits).collect()}
    assert {k: r["n_applied"] for k, r in got.items()} == want
    assert arrays(got[None, 1]) == fold(["U"] * 9)[0] and arrays(got["a", 1]) == fold(["F"] * 20)[0]
    steps = fold_history(df, ["k", "g"], "i", "t", bits=bits).groupBy("k", "g").count().collect()
    assert {(r["k"], r["g"]): r["count"] for r in steps} == {k: n + 1 for k, n in want.items()}
    texts = {(r["k"], r["g"]): r["result"] for r in concat_trace(df, ["k", "g"], "i", "t", bits=bits).collect()}
    assert texts["a", 1] == " ".join("F" * 20) and texts[None, 1] == " ".join("U" * 9)
