"""Ordered folds of token rows into states, without gathering a large key.

A count, combined before its shuffle, tells the keys with more rows than a
block of 2^10.  All others are one block each: one hash shuffle brings their
rows together, and they are folded in place.  A large key may own any share of
the rows, so its rows are range-partitioned and sorted by (key, order), which
splits it over many tasks; each run of 2^10 rows of one key is a block.  Blocks
are folded on their own and their results combined level by level, as many
levels as the largest key needs, so no list holds more than 2^10 entries.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statewalk.functions.algebra import (
    FOLD_TYPE,
    STATE_FIELDS,
    TRANSITIONS,
    compose_faces,
    fold_combine,
    fold_move,
    fold_start,
    fold_tokens,
    from_faces,
    identity_struct,
    to_faces,
    token_faces,
)
from statewalk.functions.text import join_tokens, split_tokens
from statewalk.operators.joins import lookup_join
from statewalk.sources.store import cut

BLOCK_BITS = 10


def _names(columns) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def _ordered_list(*fields: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(*fields)))


def ordered_blocks(
    rows: DataFrame, key, order, payload: Column, bits: int = BLOCK_BITS
) -> DataFrame:
    """key, block, items: the payloads of up to 2^bits successive rows of a key.

    `order` must be total within a key.  After the range sort the row ids rise
    with (key, order) over all partitions, so id >> bits cuts successive rows.
    """
    key, order = _names(key), _names(order)
    sort = [*key, *order]
    placed = (
        rows.select(*[F.col(c) for c in sort], payload.alias("_item"))
        .repartitionByRange(*sort)
        .sortWithinPartitions(*sort)
        .select(*key, "_item", F.monotonically_increasing_id().alias("_at"))
    )
    return (
        placed.groupBy(*key, F.shiftright("_at", bits).alias("_block"))
        .agg(_ordered_list("_at", "_item").alias("_items"))
        .select(*key, "_block", F.col("_items._item").alias("items"))
    )


def small_and_large(
    rows: DataFrame, key, order, payload: Column, bits: int = BLOCK_BITS
) -> tuple[DataFrame, DataFrame | None]:
    """The blocks of keys with up to 2^bits rows, one each, and of the others if there are any.

    There are fewer large keys than rows / 2^bits; if they fit, they are
    broadcast to part the rows, and ordinary rows move once.
    """
    key, order = _names(key), _names(order)
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    large = cut(counts.where(F.col("_n") > (1 << bits)).select(*key, F.lit(True).alias("_large")))
    slim = rows.select(*dict.fromkeys([*key, *order]), payload.alias("_item"))
    some = not large.isEmpty()
    if some:
        # a NULL key matches no other; it goes the way that no size can harm
        absent = reduce(Column.__or__, [F.col(k).isNull() for k in key])
        parted = lookup_join(slim, large, key, "left")
        slim = parted.where(F.col("_large").isNull() & ~absent).drop("_large")
        rest = parted.where(F.col("_large").isNotNull() | absent).drop("_large")
    items = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order if c not in key], "_item")))
    small = slim.groupBy(*key).agg(items.alias("_items")).select(
        *key, F.lit(0).cast("bigint").alias("_block"), F.col("_items._item").alias("items")
    )
    return small, ordered_blocks(rest, key, order, F.col("_item"), bits) if some else None


def _dense(blocks: DataFrame, bits: int) -> DataFrame:
    """Written blocks with numbers that follow each other closely over the partitions.

    Row ids leave 33 bits for the rows of a partition; levels would run through
    all of them before blocks of two partitions meet.
    """
    inside = F.col("_block").bitwiseAND(F.lit((1 << (33 - bits)) - 1))
    width = int(blocks.agg(F.max(inside)).first()[0] or 0).bit_length()
    partition = F.shiftright("_block", 33 - bits)
    return blocks.withColumn("_block", F.shiftleft(partition, width).bitwiseOR(inside))


def _too_many(blocks: DataFrame, key: list[str], bits: int) -> bool:
    """Whether a key has more blocks than one list may hold; counted before the shuffle."""
    counts = blocks.groupBy(*key).count()
    return not counts.where(F.col("count") > (1 << bits)).isEmpty()


def _grouped(blocks: DataFrame, key: list[str], *over: Column) -> DataFrame:
    """The (_block, value) pairs of a key in order, as `_items`."""
    return blocks.groupBy(*key, *over).agg(_ordered_list("_block", "value").alias("_items"))


def _levels(blocks: DataFrame, key: list[str], bits: int, combine) -> list[DataFrame]:
    """Written tables (key, _block, value), each joining up to 2^bits neighbours of the one before.

    The last one has at most 2^bits rows of any key; mostly it is the first.
    """
    levels = [_dense(blocks, bits)]
    while _too_many(levels[-1], key, bits):
        above = F.shiftright("_block", bits).alias("_block")
        groups = _grouped(levels[-1], key, above)
        levels.append(cut(groups.select(*key, "_block", combine(F.col("_items.value")).alias("value"))))
    return levels


def _combine_blocks(blocks: DataFrame, key: list[str], bits: int, combine) -> DataFrame:
    """Join `value` of neighbouring blocks, in order, up to one row per key."""
    top = _levels(cut(blocks), key, bits, combine)[-1]
    return _grouped(top, key).select(*key, combine(F.col("_items.value")).alias("value"))


def _fold_values(values: Column) -> Column:
    return F.aggregate(values, fold_start(), fold_combine)


def fold_events(
    events: DataFrame,
    key,
    order,
    token: str,
    transitions=TRANSITIONS,
    init: Column | None = None,
    bits: int = BLOCK_BITS,
) -> DataFrame:
    """Final state per key after applying its tokens in order.

    An unknown token ends the fold of its key; `n_applied` < `n_tokens` shows it.
    """
    key = _names(key)
    small, large = small_and_large(events, key, order, F.col(token), bits)
    value = fold_tokens(F.col("items"), transitions=transitions).alias("value")
    folded = small.select(*key, value)
    if large is not None:
        folded = folded.unionByName(_combine_blocks(large.select(*key, "_block", value), key, bits, _fold_values))
    faces = F.col("value.faces")
    if init is not None:
        faces = compose_faces(to_faces(init), faces)
    return folded.select(*key, faces.alias("_faces"), "value.n_tokens", "value.n_applied").select(
        *key, *_state_columns("_faces"), "n_tokens", "n_applied"
    )


def _state_columns(faces: str) -> list[Column]:
    state = from_faces(F.col(faces))
    return [state[f].alias(f) for f in STATE_FIELDS]


def _starts(items: Column, first: Column) -> Column:
    """For (_block, value) items: (_block, fold of everything before it)."""
    before = F.aggregate(
        F.slice(items, 1, F.size(items) - 1),
        F.array(first.cast(FOLD_TYPE)),
        lambda out, item: F.array_append(
            out, fold_combine(F.element_at(out, -1), item["value"]).cast(FOLD_TYPE)
        ),
    )
    return F.arrays_zip(F.transform(items, lambda x: x["_block"]).alias("_block"), before.alias("start"))


def fold_history(
    events: DataFrame,
    key,
    order,
    token: str,
    transitions=TRANSITIONS,
    init: Column | None = None,
    bits: int = 8,
) -> DataFrame:
    """One row per key and applied prefix: step `i`, its token, the state after it.

    Step 1 is the start state with a NULL token.  A small key lists its steps in
    place.  The blocks of a large one are folded once and written out; the state
    each starts from is found from the folded values alone, then each lists its
    own steps.
    """
    key = _names(key)
    start = identity_struct() if init is None else init
    small, large = small_and_large(events, key, order, F.col(token), bits)
    begun = small.withColumn("start", fold_start(start))
    steps = _steps(begun, key, transitions, first=start)
    if large is not None:
        value = fold_tokens(F.col("items"), transitions=transitions).alias("value")
        blocks = cut(large.select(*key, "_block", "items", value))
        levels = _levels(blocks, key, bits, _fold_values)
        tops = _grouped(levels[-1], key)
        starts = tops.select(*key, F.explode(_starts(F.col("_items"), fold_start(start))).alias("s"))
        for level in reversed(levels[:-1]):
            above = starts.select(*key, F.col("s._block").alias("_up"), F.col("s.start").alias("_from"))
            groups = _joined(_grouped(level, key, F.shiftright("_block", bits).alias("_up")), above, [*key, "_up"])
            starts = groups.select(*key, F.explode(_starts(F.col("_items"), F.col("_from"))).alias("s"))
        block_starts = starts.select(*key, "s._block", "s.start")
        begun = _joined(levels[0].drop("value"), block_starts, [*key, "_block"])
        steps = steps.unionByName(_steps(begun, key, transitions))
        keys = tops.select(
            *key,
            F.lit(1).cast("bigint").alias("i"),
            F.lit(None).cast("string").alias("token"),
            to_faces(start).alias("_faces"),
        )
        steps = steps.unionByName(keys)
    return steps.select(*key, "i", "token", *_state_columns("_faces"))


def _joined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join in which NULL keys are equal."""
    right = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on])
    return left.join(right, same).drop(*[f"_r_{c}" for c in on])


def _steps(blocks: DataFrame, key: list[str], transitions, first: Column | None = None) -> DataFrame:
    """(key, i, token, _faces) for each applied token of `items` from the fold `start` on, and `first` as step 1."""
    walked = F.aggregate(
        token_faces(F.col("items"), transitions),
        F.array(F.col("start").cast(FOLD_TYPE)),
        lambda out, faces: F.array_append(
            out, fold_move(F.element_at(out, -1), faces).cast(FOLD_TYPE)
        ),
    )
    if first is None:
        pairs = F.arrays_zip(F.slice(walked, 2, F.size("items")).alias("s"), F.col("items").alias("token"))
    else:
        none = F.array(F.lit(None).cast("string"))
        pairs = F.arrays_zip(walked.alias("s"), F.concat(none, F.col("items")).alias("token"))
    return (
        blocks.select(*key, F.explode(pairs).alias("x"))
        .where(~F.col("x.s.stopped"))
        .select(
            *key,
            (F.col("x.s.n_applied") + 1).alias("i"),
            F.col("x.token").alias("token"),
            F.col("x.s.faces").alias("_faces"),
        )
    )


def last_state(history: DataFrame, key, order: str = "i") -> DataFrame:
    """The newest row of every key; combined before the shuffle."""
    key = _names(key)
    rest = [c for c in history.columns if c not in key]
    newest = F.max_by(F.struct(*rest), F.col(order)).alias("_newest")
    return history.groupBy(*key).agg(newest).select(*key, "_newest.*")


def concat_trace(
    trace: DataFrame, key, order, text: str, sep: str = " ", bits: int = BLOCK_BITS
) -> DataFrame:
    """The texts of a key in order as one text, NULL and empty ones left out."""
    key = _names(key)
    small, large = small_and_large(trace, key, order, F.col(text), bits)
    value = join_tokens(F.col("items"), sep).alias("value")
    joined = small.select(*key, value)
    if large is not None:
        blocks = large.select(*key, "_block", value)
        joined = joined.unionByName(_combine_blocks(blocks, key, bits, lambda values: join_tokens(values, sep)))
    return joined.withColumnRenamed("value", "result")


def explode_tokens(sequences: DataFrame, text: str, sep: str | None = " ") -> DataFrame:
    """One row per token with its place `i`, from 1; no row for an empty text."""
    kept = [c for c in sequences.columns if c != text]
    return sequences.select(
        *kept, F.posexplode(split_tokens(F.col(text), sep)).alias("_at", "token")
    ).select(*kept, (F.col("_at") + 1).cast("bigint").alias("i"), "token")
