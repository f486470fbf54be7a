"""Key columns of states, and grouping by the representative of a class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewalk.functions.algebra import STATE_FIELDS
from statewalk.functions.keys import SCHEMES, canonical


def key_states(states: DataFrame, scheme: str, name: str = "state") -> DataFrame:
    """Add the text key of every state: digits, flags, buckets, hex or full."""
    arrays = {f: F.col(f) for f in STATE_FIELDS}
    return states.withColumn(name, SCHEMES[scheme](arrays))


def canonical_groups(rows: DataFrame, key: str, name: str = "canonical") -> DataFrame:
    """Add the representative of the class that each row's key belongs to."""
    return rows.withColumn(name, canonical(F.col(key)))


def class_sizes(rows: DataFrame, key: str) -> DataFrame:
    """Rows and distinct keys per class.

    Keys are counted before classes, so a key or class that owns most of the
    rows is reduced to one row per task ahead of each shuffle.
    """
    keys = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return (
        canonical_groups(keys, key)
        .groupBy("canonical")
        .agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"))
    )
