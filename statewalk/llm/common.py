"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def row_key(id: str, text: str) -> Column:
    """128 bits that name a row by its id and text, nulls included.

    Rows that agree in both get the same key, which is wanted: whatever is
    computed from the text holds for all of them.
    """
    return F.md5(F.concat(F.coalesce(F.col(id).cast("string"), F.lit("")), F.lit("|"), whole(text)))


def whole(text: str) -> Column:
    """The text, null as the empty text."""
    return F.coalesce(F.col(text), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """A column name close to `name` that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def running(values: Column, start: Column, combine: Callable[[Column, Column], Column], block: int = 128) -> Column:
    """For an array of bigints, `start` and all values before each place, combined.

    `start` must change nothing when combined.  Two levels, blocks and places in
    a block, so that an array of n entries costs n * block steps and not n * n.
    """

    def walk(values: Column, start: Column) -> Column:
        return F.slice(
            F.aggregate(
                values,
                F.array(start.cast("bigint")),
                lambda out, x: F.array_append(out, combine(F.element_at(out, -1), x.cast("bigint"))),
            ),
            1,
            F.size(values),
        )

    n_blocks = F.ceil(F.size(values) / F.lit(block)).cast("int")
    blocks = F.when(
        F.size(values) > 0,
        F.transform(
            F.sequence(F.lit(0), n_blocks - 1), lambda b: F.slice(values, b * block + 1, block)
        ),
    ).otherwise(F.array().cast("array<array<bigint>>"))
    whole_blocks = F.transform(
        blocks, lambda xs: F.aggregate(xs, start.cast("bigint"), lambda s, x: combine(s, x.cast("bigint")))
    )
    starts = walk(whole_blocks, start)
    return F.flatten(F.transform(blocks, lambda xs, i: walk(xs, F.get(starts, i))))


def running_starts(lengths: Column) -> Column:
    """For an array of lengths, the sum of all before each place."""
    return running(lengths, F.lit(0), lambda a, b: a + b)


def running_greatest(values: Column) -> Column:
    """For an array of numbers from 0, the greatest of all before each place, -1 at the first."""
    return running(values, F.lit(-1), F.greatest)
