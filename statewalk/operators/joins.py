"""Many-to-one joins that hold up when one key owns a third of the rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statewalk.sources.store import cut

BROADCAST_BYTES = 128 * 1024 * 1024
HOT_KEYS = 1024
ROWS_PER_TASK = 10_000_000
#: Classes of keys by hash, counted before keys are; classes that a filter names one by one.
KEY_CLASSES, FEW_CLASSES = 1 << 16, 4096


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Measure rows x widest row; one pass with one row per task shuffled."""
    size = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.octet_length(F.to_json(F.struct("*")))).alias("width"),
    ).first()
    return size["n"] * ((size["width"] or 0) + 64) <= limit


def keys_over(rows: DataFrame, on: list[str], enough: Callable[[Column], Column]) -> DataFrame:
    """The keys, with n_rows, for whose count `enough` holds, as it must for every greater count.

    Classes of keys by hash are counted first: a class without enough rows has
    no such key.  So a task shuffles KEY_CLASSES counts, however many keys there
    are, and single keys are only counted in the few classes that are left.
    """
    place = F.pmod(F.xxhash64(*on), F.lit(KEY_CLASSES)).cast("int")
    classes = rows.groupBy(place.alias("_class")).agg(F.count(F.lit(1)).alias("n_rows"))
    left = [r["_class"] for r in classes.where(enough(F.col("n_rows"))).select("_class").limit(FEW_CLASSES + 1).collect()]
    if len(left) <= FEW_CLASSES:
        rows = rows.where(place.isin(left) if left else F.lit(False))
    return rows.groupBy(*on).agg(F.count(F.lit(1)).alias("n_rows")).where(enough(F.col("n_rows")))


def hot_keys(many: DataFrame, on: list[str], limit: int = HOT_KEYS, per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Keys that own more than 1/`limit` of the rows, or more than `per_task` rows, with n_rows.

    The counts are combined before the shuffle, so a hot key costs one row per
    task here.
    """
    total = many.count()
    return keys_over(many, on, lambda n: (n * limit > F.lit(total)) | (n > per_task))


def lookup_join(
    many: DataFrame,
    one: DataFrame,
    on: list[str] | str,
    how: str = "inner",
    small: bool | None = None,
    salts: int = 64,
    limit: int = HOT_KEYS,
    per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Join `many` to `one`, which holds each key once.

    If `one` fits (`small`, or measured when not given) it is broadcast and
    `many` does not move.  Otherwise both are shuffled.  If `many` has hot keys,
    their rows are spread over at least `salts` partitions, and over as many as
    keep `per_task` rows in each, with the matching row of `one` repeated there.
    Rows with a NULL key are spread alike if they are many.
    Fewer than `limit` + rows / `per_task` keys can be hot.  The salt comes from
    the place of a row in a written table: equal rows are spread too, and a
    task that runs again gives the same.

    Finding the hot keys reads `many` before the join does, so a caller that
    computed it at some cost should hand over a written table.
    """
    on = [on] if isinstance(on, str) else list(on)
    if small is None:
        small = fits_broadcast(one)
    if small:
        return many.join(F.broadcast(one), on, how)
    count = F.greatest(F.lit(salts), F.ceil(F.col("n_rows") / per_task)).cast("int")
    found = cut(hot_keys(many, on, limit, per_task).select(*on, count.alias("_salts")))
    if found.isEmpty():
        return many.join(one, on, how)
    hot = F.broadcast(found)
    absent = reduce(Column.__or__, [F.col(c).isNull() for c in on])
    # rows without a key match nothing, so they only need spreading
    apart = found.where(absent).agg(F.max("_salts")).first()[0] or 1
    place = F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("_place")
    placed = cut(many).select("*", place)
    salt = (
        F.when(F.col("_salts").isNotNull(), F.pmod("_place", "_salts").cast("int"))
        .when(absent, F.pmod("_place", F.lit(apart)).cast("int"))
        .otherwise(0)
    )
    spread = placed.join(hot, on, "left").withColumn("_salt", salt).drop("_salts", "_place")
    every = F.when(F.col("_salts").isNotNull(), F.sequence(F.lit(0), F.col("_salts") - 1))
    repeated = (
        one.join(hot, on, "left")
        .withColumn("_salt", F.explode(F.coalesce(every, F.array(F.lit(0)))))
        .drop("_salts")
    )
    return spread.join(repeated, [*on, "_salt"], how).drop("_salt")
