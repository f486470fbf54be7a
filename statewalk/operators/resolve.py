"""The bulk solver: a table of states or token texts in, a table of answers out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statewalk.functions.algebra import (
    FOLD_TYPE,
    STATE_FIELDS,
    fold_move,
    fold_start,
    fold_tokens,
    from_faces,
    identity_struct,
    to_faces,
    token_faces,
    undo_tokens,
)
from statewalk.functions.keys import SCHEMES, STAGE_SCHEME
from statewalk.functions.text import join_tokens, split_tokens
from statewalk.operators.replay import lookup_paths
from statewalk.sources.store import cut

STEPS = "array<struct<stage: int, step: int, move: string, faces: array<int>>>"


def _steps(number: int, applied: Column, faces: Column) -> Column:
    """The states of one stage: step 0 as it was entered, then one per token of `applied`."""
    states = F.aggregate(
        token_faces(applied),
        F.array(fold_start(faces=faces)),
        lambda out, move: F.array_append(out, fold_move(F.element_at(out, -1), move).cast(FOLD_TYPE)),
    )
    moves = F.concat(F.array(F.lit(None).cast("string")), applied)
    return F.transform(
        F.arrays_zip(states.alias("s"), moves.alias("move")),
        lambda x, i: F.struct(F.lit(number).alias("stage"), i.alias("step"), x["move"].alias("move"), x["s"]["faces"].alias("faces")),
    ).cast(STEPS)


def _through_stages(
    rows: DataFrame, tables: dict[int, DataFrame], keep_unresolved: bool, small: bool, trace: bool
) -> DataFrame:
    """`rows` with `_faces` taken through key, lookup and replay of every stage.

    Adds `_moves`, `unresolved` and, for a trace, `_steps`.
    """
    carried = [c for c in rows.columns if c != "_faces"]
    rows = rows.select(
        *carried,
        "_faces",
        F.array().cast("array<string>").alias("_moves"),
        F.lit(False).alias("unresolved"),
        *([F.array().cast(STEPS).alias("_steps")] if trace else []),
    )
    how = "left" if keep_unresolved else "inner"
    for number in sorted(tables):
        state = from_faces(F.col("_faces"))
        rows = rows.withColumn("state", SCHEMES[STAGE_SCHEME[number]](state))
        if not small:
            rows = cut(rows)  # read twice by the lookup: hot keys are counted first
        rows = lookup_paths(rows, tables[number], how=how, small=small)
        path = F.coalesce("path", F.array().cast("array<string>"))
        rows = rows.select(
            *carried,
            "_faces",
            "_moves",
            (F.col("unresolved") | F.col("path").isNull()).alias("unresolved"),
            *(["_steps"] if trace else []),
            undo_tokens(path).alias("_applied"),
        )
        walked = _steps(number, F.col("_applied"), F.col("_faces"))
        rows = rows.select(
            *carried,
            fold_tokens(F.col("_applied"), fold_start(faces=F.col("_faces"))).getField("faces").alias("_faces"),
            F.concat("_moves", "_applied").alias("_moves"),
            "unresolved",
            *([F.concat("_steps", walked).alias("_steps")] if trace else []),
        )
    return rows


def _answers(
    rows: DataFrame, tables: dict[int, DataFrame], keep_unresolved: bool, small: bool
) -> DataFrame:
    carried = [c for c in rows.columns if c != "_faces"]
    solved = F.col("_faces") == to_faces(identity_struct())
    out = _through_stages(rows, tables, keep_unresolved, small, trace=False).select(
        *carried,
        join_tokens(F.col("_moves")).alias("result"),
        F.size("_moves").alias("n_moves"),
        solved.alias("solved"),
        "unresolved",
    )
    return out if keep_unresolved else out.drop("unresolved")


def _with_faces(states: DataFrame) -> DataFrame:
    kept = [c for c in states.columns if c not in STATE_FIELDS]
    return states.select(*kept, to_faces({f: F.col(f) for f in STATE_FIELDS}).alias("_faces"))


def resolve_states(
    states: DataFrame, tables: dict[int, DataFrame], keep_unresolved: bool = False, small: bool = True
) -> DataFrame:
    """Tokens that lead every state (STATE_FIELDS) back to the start state.

    Per stage: key, lookup, replay.  The stage tables have a fixed number of
    rows (two million together, about 80 bytes each), so with `small` they are
    broadcast and the states never move; otherwise the skew-safe shuffled lookup
    is used.  All other columns stay, those of `fold_events` included.

    Adds result (NULL if nothing is to be undone), n_moves and solved.  A state a
    stage cannot look up drops out, or stays with `unresolved` set.
    """
    return _answers(_with_faces(states), tables, keep_unresolved, small)


def resolve_trace(
    states: DataFrame, tables: dict[int, DataFrame], keep_unresolved: bool = False, small: bool = True
) -> DataFrame:
    """One row per state, stage and step: the move made and the state after it.

    Step 0 of a stage is the state it was entered with and has no move.  The
    moves in order of (stage, step) are the answer of `resolve_states`.  States
    a stage cannot look up drop out, or show no move there.
    """
    kept = [c for c in states.columns if c not in STATE_FIELDS]
    found = _through_stages(_with_faces(states), tables, keep_unresolved, small, trace=True)
    steps = found.select(*kept, F.explode("_steps").alias("_x")).select(
        *kept, "_x.stage", "_x.step", "_x.move", F.col("_x.faces").alias("_faces")
    )
    return steps.select(*kept, "stage", "step", "move", from_faces(F.col("_faces")).alias("_s")).select(
        *kept, "stage", "step", "move", "_s.*"
    )


def resolve_sequences(
    sequences: DataFrame,
    tables: dict[int, DataFrame],
    text: str = "turns_text",
    keep_unresolved: bool = False,
    small: bool = True,
) -> DataFrame:
    """`resolve_states` for token texts, each folded in its row.

    A NULL text is an empty one: nothing to undo, answer NULL.  Adds n_tokens
    and n_applied besides.  Tokens that lie in rows are better folded by
    `fold_events`, which holds no key in one text.
    """
    kept = [c for c in sequences.columns if c != text]
    folded = F.col("_fold")
    rows = sequences.select(
        *kept, fold_tokens(split_tokens(F.coalesce(F.col(text), F.lit("")))).alias("_fold")
    ).select(
        *kept,
        folded["n_tokens"].alias("n_tokens"),
        folded["n_applied"].alias("n_applied"),
        folded["faces"].alias("_faces"),
    )
    return _answers(rows, tables, keep_unresolved, small)
