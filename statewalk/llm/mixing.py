"""Mixing sources to target weights by thresholds on a hash of the documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statewalk.llm.common import WORD, whole
from statewalk.operators.joins import lookup_join
from statewalk.sources.store import cut

HASH_BITS = 60


def document_hash(id: str, text: str) -> Column:
    """60 bits of the MD5 of id and text; SQL engines agree on it."""
    digest = F.md5(F.concat_ws(":", F.col(id).cast("string"), F.col(text)))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("bigint")


def source_key(source: str) -> Column:
    """A non-null key: '+' and the source, or '-' for null."""
    return F.coalesce(F.concat(F.lit("+"), F.col(source)), F.lit("-"))


def ranked_sources(sized: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """key, source, source_size, weight: sources in byte order, null last.

    Ranks come from a range sort and the row count of each range, so no task
    sees all sources.
    """
    totals = (
        sized.groupBy("key", "source")
        .agg(F.sum("size").alias("source_size"))
        .repartitionByRange(F.col("source").asc_nulls_last())
        .sortWithinPartitions(F.col("source").asc_nulls_last())
        .select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    )
    totals = cut(totals)
    # one row per range, as many as there are shuffle partitions
    ranges = totals.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.col("at") - F.col("first") + F.col("offset")
    weight = F.get(F.array(*[F.lit(w) for w in weights]), F.pmod(rank, F.lit(len(weights))).cast("int"))
    return totals.join(F.broadcast(ranges), "part").select(
        "key", "source", "source_size", weight.alias("weight")
    )


def with_targets(sources: DataFrame, share: float, max_repeats: int) -> DataFrame:
    """Adds `target`: `share` of all sizes dealt by weight, at most `max_repeats` times a size.

    A source is full if its cap lies under level * weight.  Raising the level
    fills more sources and frees their excess for the rest, until the level
    stays; the driver sees three sums per round.
    """
    cap = F.col("source_size") * max_repeats
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    budget, level = share * total, -1.0
    while True:
        full = cap < F.lit(level) * F.col("weight")
        capped, open_weight = sources.agg(
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)),
        ).first()
        found = (budget - capped) / open_weight if open_weight else level
        if found <= level or not open_weight:
            break
        level = found
    share_of = F.lit(level) * F.col("weight")
    return sources.withColumn("target", F.when(cap < share_of, cap).otherwise(share_of).cast("double"))


def boundaries(sized: DataFrame, sources: DataFrame, bits: int) -> DataFrame:
    """key, edge, below, edge_size: where the budget `rest` of each source ends.

    Sizes are summed by source and the next `bits` bits of the hash.  The bucket
    in which the running sum passes the budget is the boundary; only its rows
    are read on, by the following bits, until each boundary is one hash value.
    """
    zero = F.lit(0).cast("bigint")
    edge = sources.select("key", "rest", zero.alias("prefix"), zero.alias("below"))
    rows, used = sized, 0
    while True:
        if used:
            rows = lookup_join(sized, edge.select("key", "prefix"), "key").where(
                F.shiftright("hash", HASH_BITS - used) == F.col("prefix")
            )
        used += min(bits, HASH_BITS - used)
        sums = rows.groupBy("key", F.shiftright("hash", HASH_BITS - used).alias("bucket")).agg(
            F.sum("size").alias("sum"), F.min("hash").alias("low"), F.max("hash").alias("high")
        )
        # at most 2^bits rows of a source
        inside = Window.partitionBy("key").orderBy("bucket")
        found = (
            sums.join(edge.select("key", "rest", "below"), "key")
            .withColumn("upto", F.col("below") + F.sum("sum").over(inside))
            .where(F.col("upto") > F.col("rest"))
            .groupBy("key")
            .agg(F.min_by(F.struct("bucket", "sum", "upto", "low", "high", "rest"), "bucket").alias("b"))
            .select(
                "key",
                "b.rest",
                F.col("b.bucket").alias("prefix"),
                (F.col("b.upto") - F.col("b.sum")).alias("below"),
                F.col("b.sum").alias("edge_size"),
                "b.low",
                "b.high",
            )
        )
        edge = cut(found)
        if used == HASH_BITS or edge.where("low < high").isEmpty():
            return edge.select("key", F.col("low").alias("edge"), "below", "edge_size")


def mix_plan(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    max_repeats: int = 2,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    bits: int = 10,
) -> tuple[DataFrame, DataFrame]:
    """The sized documents (id, key, source, size, hash) and one plan row per source.

    A plan row has source_size, target, times (how often the whole source is
    taken), and the hash up to which it is taken once more.  Raising a target
    only raises that hash: mixes are nested.
    """
    sized = cut(
        docs.select(
            F.col(id).alias("id"),
            source_key(source).alias("key"),
            F.col(source).alias("source"),
            F.regexp_count(whole(text), F.lit(WORD)).cast("bigint").alias("size"),
            document_hash(id, text).alias("hash"),
        )
    )
    sources = with_targets(ranked_sources(sized, weights), share, max_repeats)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    sources = cut(
        sources.withColumn("times", times.cast("bigint")).withColumn(
            "rest", F.col("target") - F.col("times") * F.col("source_size")
        )
    )
    edges = boundaries(sized, sources, bits)
    # the boundary hash is taken if that comes nearer to the target
    nearer = F.col("below") + F.col("edge_size") / 2 < F.col("rest")
    last = F.col("edge") - F.when(nearer, 0).otherwise(1)
    return sized, cut(
        sources.join(edges, "key", "left").select(
            "key", "source_size", "target", "times", F.coalesce(last, F.lit(-1)).alias("last")
        )
    )


def copies_of(hash: Column) -> Column:
    return F.col("times") + (hash <= F.col("last")).cast("bigint")


def mix_sources(docs: DataFrame, id: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """How often the mix takes each document.

    Returns one row per row of `docs`: the id, source, size (words), source_size,
    target (of its source), copies, taken (copies * size).  Sources get weights
    by their place in byte order, null last, repeating.  Each source is taken
    whole floor(target / size) times and once more up to a hash threshold whose
    sum of sizes comes nearest to what is left.  Rows of equal hash, that is of
    equal id and text, are taken alike.  Null text has size 0 and takes nothing;
    a source of size 0 has target 0; an empty table gives an empty result.
    Other columns of `docs` are not looked at.
    """
    sized, plan = mix_plan(docs, id=id, source=source, **options)
    copies = copies_of(F.col("hash"))
    return lookup_join(sized, plan, "key").select(
        F.col("id").alias(id),
        F.col("source").alias(source),
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )


def mixed_documents(
    docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", **options
) -> DataFrame:
    """The documents that the mix takes, with `copies` and `taken`; the rest go.

    All columns of `docs` stay, but one named `copies` or `taken` is replaced.
    The plan comes to the documents, which do not move while it is small.
    """
    _, plan = mix_plan(docs, id=id, text=text, source=source, **options)
    kept = [c for c in docs.columns if c.lower() not in ("copies", "taken")]
    rows = docs.select(
        F.struct(*kept).alias("row"),
        source_key(source).alias("key"),
        F.regexp_count(whole(text), F.lit(WORD)).cast("bigint").alias("size"),
        document_hash(id, text).alias("hash"),
    )
    taken = lookup_join(rows, plan, "key").withColumn("copies", copies_of(F.col("hash"))).where("copies > 0")
    return taken.select("row.*", "copies", (F.col("copies") * F.col("size")).alias("taken"))
