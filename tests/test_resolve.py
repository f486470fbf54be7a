import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from plain import START, arrays, fold

from statewalk.functions.algebra import TOKENS
from statewalk.operators.fold import concat_trace, explode_tokens, fold_events
from statewalk.operators.joins import fits_broadcast, hot_keys, lookup_join
from statewalk.operators.keyed import key_states
from statewalk.operators.replay import lookup_paths, replay_inverse, replay_trace
from statewalk.operators.resolve import resolve_sequences, resolve_states, resolve_trace
from statewalk.sources.store import load_paths, save_paths, scratch_path, shared_folder

FIXED = "L2 d U F2 U F2 D B f D f l B2 f R2 F2 r F D2 l U L R2 f D2 F d"
GOLDEN = {
    FIXED: "d L b d L F U2 l B2 D2 l b F2 D2 L U2 l B2 L B2 l B2 l B2 U2 F2 U2 R2 U2 D2",
    "U": "u",
    "R2": "R2",
    "U r": "R u",
    "F B2 l": "L f B2",
    "": None,
    None: None,
    "U X R": "u",
}


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "seq_id int, turns_text string")


def test_golden(spark, stage_tables):
    values = list(GOLDEN)
    got = {r["seq_id"]: r for r in resolve_sequences(texts(spark, values), stage_tables).collect()}
    for i, text in enumerate(values):
        assert got[i]["result"] == GOLDEN[text]
        assert got[i]["solved"]
    assert (got[7]["n_applied"], got[7]["n_tokens"]) == (1, 3)


def test_random_sequences_are_solved(spark, stage_tables):
    rng = random.Random(7)
    values = [" ".join(rng.choices(TOKENS, k=30)) for _ in range(200)]
    rows = resolve_sequences(texts(spark, values), stage_tables).collect()
    assert len(rows) == 200
    for r in rows:
        assert r["solved"] and r["n_moves"] <= 45
        state, _ = fold(values[r["seq_id"]].split() + r["result"].split())
        assert state == START


def test_shuffled_lookup_and_unresolved(spark, stage_tables):
    values = ["U r", "U r", "U r", "F B2 l"]
    part = dict(stage_tables)
    part[4] = stage_tables[4].where("state <> '012345670123456789AB'").limit(0)
    got = resolve_sequences(texts(spark, values), stage_tables, small=False)
    assert sorted(r["result"] for r in got.collect()) == ["L f B2", "R u", "R u", "R u"]
    assert resolve_sequences(texts(spark, values), part).count() == 0
    kept = resolve_sequences(texts(spark, values), part, keep_unresolved=True).collect()
    assert len(kept) == 4 and all(r["unresolved"] for r in kept)


def test_states_and_trace_agree_with_texts(spark, stage_tables):
    rows = texts(spark, [FIXED, "U r", "F B2 l", "R2 d"])
    states = fold_events(explode_tokens(rows, "turns_text"), "seq_id", "i", "token")
    want = {r["seq_id"]: r.asDict() for r in resolve_sequences(rows, stage_tables).collect()}
    got = {r["seq_id"]: r.asDict() for r in resolve_states(states, stage_tables).collect()}
    assert got == want
    trace = resolve_trace(states.drop("n_tokens", "n_applied"), stage_tables)
    text = {r["seq_id"]: r["result"] for r in concat_trace(trace, "seq_id", ["stage", "step"], "move").collect()}
    assert text == {k: r["result"] for k, r in want.items()}
    steps = sorted(trace.collect(), key=lambda r: (r["seq_id"], r["stage"], r["step"]))
    for key, row in want.items():
        mine = [s for s in steps if s["seq_id"] == key]
        assert {(s["stage"], s["move"]) for s in mine if s["step"] == 0} == {(k, None) for k in (1, 2, 3, 4)}
        begin = rows.where(rows["seq_id"] == key).first()["turns_text"].split()
        done = []
        for s in mine:
            done += [s["move"]] if s["move"] else []
            assert arrays(s) == fold(begin + done)[0]
        assert arrays(mine[-1]) == START
    part = stage_tables | {2: stage_tables[2].limit(0)}
    assert resolve_trace(states, part).count() == 0
    kept = resolve_trace(states, part, keep_unresolved=True)
    assert kept.where("stage = 2 and step > 0").count() == 0 and kept.where("stage = 1 and step > 0").count() > 0


def test_lookup_join_with_a_hot_key(spark):
    rows = [("hot" if i % 3 == 0 else f"k{i}", i) for i in range(3000)]
    many = spark.createDataFrame(rows, "state string, n int")
    one = spark.createDataFrame([("hot", 1), *[(f"k{i}", i) for i in range(0, 3000, 2)]], "state string, v int")
    assert [r["state"] for r in hot_keys(many, ["state"], limit=10).collect()] == ["hot"]
    assert fits_broadcast(one) and not fits_broadcast(one, limit=1000)
    for how in ("inner", "left"):
        a = sorted(map(str, lookup_join(many, one, "state", how, small=True).collect()))
        for limit in (2, 10):  # without and with hot keys
            joined = lookup_join(many, one, "state", how, small=False, limit=limit)
            assert a == sorted(map(str, joined.collect())) and a


def test_equal_rows_of_a_hot_key_are_spread(spark):
    many = spark.createDataFrame([("hot", 1)] * 3000, "state string, n int")
    one = spark.createDataFrame([("hot", 1)], "state string, v int")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = lookup_join(many, one, "state", small=False, per_task=50)
        sizes = [n for _, n in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 3000 and len(sizes) == 8 and max(sizes) < 1000


def test_replay_ends_at_the_seed_and_trace_agrees(spark, stage_tables):
    tokens = explode_tokens(texts(spark, [FIXED, "U r", "L F2 b U"]), "turns_text")
    states = key_states(fold_events(tokens, "seq_id", "i", "token"), "digits")
    found = lookup_paths(states, stage_tables[1], small=True)
    end = {r["seq_id"]: r for r in replay_inverse(found).collect()}
    assert all(r["edge_ori"] == [0] * 12 for r in end.values())
    trace = replay_trace(found).collect()
    for key, row in end.items():
        steps = sorted((r for r in trace if r["seq_id"] == key), key=lambda r: r["step"])
        assert steps[0]["move"] is None
        assert [s["move"] for s in steps[1:]] == row["applied"]
        assert arrays(steps[-1]) == arrays(row)


def test_every_stage1_path_leads_from_the_seed(stage_tables):
    for row in stage_tables[1].collect():
        state, n = fold(row["path_text"].split())
        assert "".join(map(str, state["ori"]["edge"])) == row["state"]


def test_store_round_trip(spark):
    paths = spark.createDataFrame([("a", ["x", "y"]), ("b", [])], "state string, path array<string>")
    place = scratch_path(spark, "round-trip")
    save_paths(paths, place)
    assert {(r["state"], tuple(r["path"])) for r in load_paths(spark, place).collect()} == {
        ("a", ("x", "y")),
        ("b", ()),
    }


def test_shared_folder():
    def session(master, folder=None):
        return SimpleNamespace(
            conf=SimpleNamespace(get=lambda key, default: folder),
            sparkContext=SimpleNamespace(master=master, applicationId="app"),
        )

    assert shared_folder(session("yarn", "hdfs:///shared")) == "hdfs:///shared"
    assert shared_folder(session("local[2]")) == shared_folder(session("local[2]"))
    with pytest.raises(RuntimeError):
        shared_folder(session("yarn"))
