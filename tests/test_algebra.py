import random

from plain import arrays, fold, turn, START
from pyspark.sql import functions as F

from statewalk.functions import algebra as A
from statewalk.operators.transitions import (
    apply_transitions,
    basic_transitions,
    power_table,
    transition_table,
)


def test_literal_transitions():
    assert len(A.TRANSITIONS) == 18 and A.TOKENS == sorted(A.TOKENS)
    half, back = A.BY_TOKEN["U2"], A.BY_TOKEN["u"]
    assert half.pos["corner"] == [3, 1, 2, 0, 7, 5, 6, 4]
    assert half.pos["edge"] == [3, 1, 2, 0, 4, 5, 6, 7, 11, 9, 10, 8]
    assert not any(half.ori["corner"]) and not any(half.ori["edge"])
    assert back.pos["corner"] == [7, 1, 2, 4, 0, 5, 6, 3]
    assert back.pos["edge"] == [11, 1, 2, 8, 4, 5, 6, 7, 0, 9, 10, 3]
    assert back.ori["corner"] == [2, 0, 0, 2, 1, 0, 0, 1]
    assert back.ori["edge"] == [1, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 1]
    for t in A.TRANSITIONS:
        assert turn(turn(START, t.token), t.inverse) == START


def test_power_table_equals_literals(spark):
    built = {tuple(map(str, r)) for r in power_table(basic_transitions(spark), "initial").collect()}
    literal = {tuple(map(str, r)) for r in transition_table(spark).collect()}
    assert built == literal and len(built) == 18


def test_apply_transitions_on_both_join_paths(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for i in range(120):
        tokens = rng.choices(A.TOKENS, k=6)
        state, _ = fold(tokens)
        move = "U" if i % 3 == 0 else rng.choice(A.TOKENS)
        rows.append((i, move, *state["pos"].values(), *state["ori"].values()))
        want[i] = turn(state, move)
    arrays_ddl = ", ".join(f"{f} array<int>" for f in A.STATE_FIELDS)
    states = spark.createDataFrame(rows, f"id int, move string, {arrays_ddl}")
    moves = transition_table(spark).select("move", *A.MOVE_FIELDS)
    for small in (True, False):
        got = apply_transitions(states, moves, "move", small=small).collect()
        assert {r["id"]: arrays(r) for r in got} == want


def test_null_arrays_give_no_row(spark):
    states = spark.createDataFrame(
        [(1, "U", None, list(range(12)), [0] * 8, [0] * 12)],
        "id int, move string, corner_pos array<int>, edge_pos array<int>,"
        " corner_ori array<int>, edge_ori array<int>",
    )
    moves = transition_table(spark).select("move", *A.MOVE_FIELDS)
    assert apply_transitions(states, moves, "move", small=True).count() == 0


def test_faces_round_trip(spark):
    state, _ = fold("L2 d U F2 U F2 D B".split())
    row = spark.createDataFrame(
        [(*state["pos"].values(), *state["ori"].values())],
        ", ".join(f"{f} array<int>" for f in A.STATE_FIELDS),
    )
    struct = {f: F.col(f) for f in A.STATE_FIELDS}
    back = row.select(A.to_faces(struct).alias("f")).select(A.from_faces(F.col("f")).alias("s"))
    assert arrays(back.first()["s"]) == state
