"""Transition tables: literals, powers of operators, application to states."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statewalk.functions.algebra import (
    MOVE_FIELDS,
    STATE_FIELDS,
    TRANSITIONS,
    compose,
)
from statewalk.operators.joins import lookup_join
from statewalk.sources.fixed import BASIC_TRANSITIONS
from statewalk.sources.store import cut

_ARRAYS = ", ".join(f"{name} array<int>" for name in MOVE_FIELDS)


def basic_transitions(spark: SparkSession) -> DataFrame:
    rows = [(initial, *arrays) for initial, arrays in BASIC_TRANSITIONS.items()]
    return spark.createDataFrame(rows, f"initial string, {_ARRAYS}")


def transition_table(spark: SparkSession, transitions=TRANSITIONS) -> DataFrame:
    """The literal transitions as a table (18 rows)."""
    rows = [
        (t.turns, t.initial, t.token, t.inverse, *t.pos.values(), *t.ori.values())
        for t in transitions
    ]
    return spark.createDataFrame(
        rows, f"turns int, initial string, move string, reverse string, {_ARRAYS}"
    )


def as_state(prefix: str | None = None, fields=MOVE_FIELDS) -> Column:
    """The four array columns of a row as one struct that `compose` takes."""
    dot = f"{prefix}." if prefix else ""
    return F.struct(*[F.col(dot + f).alias(s) for f, s in zip(fields, STATE_FIELDS)])


def iterate_join(
    base: DataFrame,
    step: Callable[[int], list[Column]],
    on: list[str],
    max_rounds: int,
) -> DataFrame:
    """Rounds 1..max_rounds: each joins the round before (`l`) to the base (`b`).

    `step(n)` gives the columns of round n besides `on`; they must be named as
    in the base.  The base holds each key once, so a round never grows.  Every
    round is written out, since the next one and the result both read it.
    """
    base = cut(base)
    rounds = [base.withColumn("round", F.lit(1))]
    last = base
    for n in range(2, max_rounds + 1):
        joined = last.alias("l").join(base.alias("b"), on)
        last = cut(joined.select(*on, *step(n)))
        rounds.append(last.withColumn("round", F.lit(n)))
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out


def power_table(base: DataFrame, name: str, max_rounds: int = 3) -> DataFrame:
    """Every operator of `base` composed with itself up to `max_rounds` times.

    Rounds one to three of an operator X are named X, X2, x and undone by
    x, X2, X.
    """

    def step(_):
        composed = compose(as_state("l"), as_state("b"))
        return [composed[s].alias(m) for s, m in zip(STATE_FIELDS, MOVE_FIELDS)]

    rounds = iterate_join(base.select(name, *MOVE_FIELDS), step, [name], max_rounds)
    n, x = F.col("round"), F.col(name)
    return rounds.select(
        n.alias("turns"),
        x.alias("initial"),
        F.when(n == 1, x).when(n == 2, F.concat(x, F.lit("2"))).when(n == 3, F.lower(x)).alias("move"),
        F.when(n == 1, F.lower(x)).when(n == 2, F.concat(x, F.lit("2"))).when(n == 3, x).alias("reverse"),
        *MOVE_FIELDS,
    )


def apply_transitions(
    states: DataFrame, transitions: DataFrame, on: list[str] | str, small: bool | None = None
) -> DataFrame:
    """Every state row turned by the transition it joins to.

    Rows with a NULL array on either side give no row.
    """
    joined = lookup_join(states, transitions, on, small=small)
    complete = F.lit(True)
    for name in [*STATE_FIELDS, *MOVE_FIELDS]:
        complete = complete & F.col(name).isNotNull()
    kept = [c for c in joined.columns if c not in (*STATE_FIELDS, *MOVE_FIELDS)]
    turned = compose(as_state(fields=STATE_FIELDS), as_state())
    return (
        joined.where(complete)
        .select(*kept, turned.alias("_turned"))
        .select(*kept, "_turned.*")
    )
