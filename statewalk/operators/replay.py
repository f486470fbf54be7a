"""Lookup of keys in path tables, and replay of the paths found."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statewalk.functions.algebra import (
    FOLD_TYPE,
    STATE_FIELDS,
    TRANSITIONS,
    fold_move,
    fold_start,
    fold_tokens,
    from_faces,
    token_faces,
    undo_tokens,
)
from statewalk.functions.text import split_tokens
from statewalk.operators.joins import hot_keys, lookup_join
from statewalk.sources.store import cut


def lookup_paths(
    entries: DataFrame,
    paths: DataFrame,
    on: str = "state",
    how: str = "inner",
    small: bool | None = None,
) -> DataFrame:
    """Entries with the stored path of their key; `paths` holds each key once.

    Paths stored as text are joined as text, which keeps the table narrow, and
    split afterwards.  Entries without a path drop out, or stay with a NULL path
    for `how="left"`.
    """
    found = lookup_join(entries, paths, on, how, small=small)
    if "path_text" not in paths.columns:
        return found
    return found.withColumn("path", split_tokens(F.col("path_text"))).drop("path_text")


def lookup_stored(entries: DataFrame, stored: DataFrame, on: str = "state", how: str = "inner") -> DataFrame:
    """`lookup_paths` in a table kept in buckets of its key (`bucket_paths`), which never moves.

    Entries are shuffled to the buckets.  The keys that own much of them, fewer
    than HOT_KEYS + rows / ROWS_PER_TASK, are found by a combined count; their
    few stored rows are broadcast and those entries stay where they are, as do
    entries without a key.  `entries` is read several times, so a written table
    is best.
    """
    hot = cut(hot_keys(entries.where(F.col(on).isNotNull()), [on]).select(on))
    rest = entries.where(F.col(on).isNotNull())
    parts = []
    if not hot.isEmpty():
        few = stored.join(F.broadcast(hot), on, "left_semi")
        parts.append(rest.join(F.broadcast(hot), on, "left_semi").join(F.broadcast(few), on, how))
        rest = rest.join(F.broadcast(hot), on, "left_anti")
    parts.append(rest.join(stored.hint("merge"), on, how))
    if how == "left":
        names = [F.lit(None).cast(f.dataType).alias(f.name) for f in stored.schema if f.name != on]
        parts.append(entries.where(F.col(on).isNull()).select("*", *names))
    found = reduce(DataFrame.unionByName, parts)
    if "path_text" not in stored.columns:
        return found
    return found.withColumn("path", split_tokens(F.col("path_text"))).drop("path_text")


def _state() -> dict[str, Column]:
    return {f: F.col(f) for f in STATE_FIELDS}


def replay_inverse(
    entries: DataFrame, path: str = "path", transitions=TRANSITIONS, keep_broken: bool = False
) -> DataFrame:
    """Undo the path of every row: the end state and the tokens applied.

    The path is taken from its end, each token replaced by its inverse.  One
    projection, no shuffle: a path lies in its row.  A row whose path holds an
    unknown token drops out; with `keep_broken` it stays as far as it went, and
    the column `broken` tells.
    """
    kept = [c for c in entries.columns if c not in (*STATE_FIELDS, path)]
    undone = entries.select(
        *kept, *STATE_FIELDS, undo_tokens(F.col(path), transitions).alias("applied")
    )
    end = fold_tokens(F.col("applied"), fold_start(_state()), transitions)
    walked = undone.select(*kept, "applied", end.alias("_end"))
    if keep_broken:
        done = F.slice("applied", 1, F.col("_end.n_applied").cast("int"))
        walked = walked.withColumn("applied", done).withColumn("broken", F.col("_end.stopped"))
        kept = [*kept, "broken"]
    else:
        walked = walked.where(~F.col("_end.stopped"))
    return (
        walked.select(*kept, "applied", F.col("_end.faces").alias("_faces"))
        .select(*kept, "applied", from_faces(F.col("_faces")).alias("_s"))
        .select(*kept, "applied", "_s.*")
    )


def replay_trace(
    entries: DataFrame, path: str = "path", transitions=TRANSITIONS, keep_broken: bool = True
) -> DataFrame:
    """One row per step of `replay_inverse`; step 0 is the entry with no token.

    A path with an unknown token shows its steps up to there; without
    `keep_broken` it shows none.
    """
    kept = [c for c in entries.columns if c not in (*STATE_FIELDS, path)]
    undone = entries.select(
        *kept, *STATE_FIELDS, undo_tokens(F.col(path), transitions).alias("_applied")
    )
    states = F.aggregate(
        token_faces(F.col("_applied"), transitions),
        F.array(fold_start(_state())),
        lambda out, faces: F.array_append(
            out, fold_move(F.element_at(out, -1), faces).cast(FOLD_TYPE)
        ),
    )
    tokens = F.concat(F.array(F.lit(None).cast("string")), F.col("_applied"))
    if not keep_broken:
        undone = undone.where(~fold_tokens(F.col("_applied"), fold_start(_state()), transitions)["stopped"])
    return (
        undone.select(
            *kept, F.posexplode(F.arrays_zip(states.alias("s"), tokens.alias("move"))).alias("step", "_x")
        )
        .where(~F.col("_x.s.stopped"))
        .select(*kept, "step", F.col("_x.move").alias("move"), F.col("_x.s.faces").alias("_faces"))
        .select(*kept, "step", "move", from_faces(F.col("_faces")).alias("_s"))
        .select(*kept, "step", "move", "_s.*")
    )


def reverse_paths(paths: DataFrame, path: str = "path") -> DataFrame:
    """Paths over nodes taken the other way: from the node back to its seed."""
    return paths.withColumn(path, F.reverse(path))
