"""Dense numbers in the order of some columns, without a global window."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewalk.sources.store import cut

#: The bits of `monotonically_increasing_id` below the number of the partition.
_ROW_BITS = 33


def numbered(rows: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """`rows` with `name`: start, start + 1, ... in the ascending order of the columns `order`.

    The rows are sorted by range and written with their place in the partition;
    the driver only gets one count per partition, whose running sum is added.
    The sort samples `rows` before it moves them, so a written table is best.
    """
    spark = rows.sparkSession
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _ROW_BITS)
    counts = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before = accumulate((n for _, n in counts), initial=start)
    offsets = spark.createDataFrame([(p, b) for (p, _), b in zip(counts, before)], "_part bigint, _before bigint")
    number = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    joined = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return joined.select(*rows.columns, number.alias(name))
