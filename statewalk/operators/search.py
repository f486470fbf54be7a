"""Breadth-first search, level by level, over edge tables and over states.

The driver only runs the loop: every level is one Spark job whose rows are
written to the shared folder, so a level is computed once and a lost executor
costs no more than the level in work.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DataType, IntegerType, LongType, ShortType, StringType

from statewalk.functions.algebra import TRANSITIONS
from statewalk.functions.successors import PackedKeys, TextKeys
from statewalk.operators.joins import BROADCAST_BYTES, keys_over, lookup_join
from statewalk.operators.numbering import numbered
from statewalk.sources.store import (
    add_bucketed,
    bucketed_name,
    checkpointed,
    cut,
    scratch_path,
    scratch_scope,
    write_bucketed,
)

#: A level of (node, place) pairs up to this many is broadcast: 16 bytes each.
SMALL_LEVEL = 100_000
EDGES_PER_SALT = 1_000_000
EDGES_PER_BUCKET = 4_000_000
#: Row groups of the edges, so that a level can skip most; ranges and single nodes that it asks for.
GROUP_BYTES, GROUP_ROWS = 1 << 20, 10_000
RANGES, FEW_NODES = 32, 32
#: Spans that a filter of edges names: with many more its code is too long to be compiled, and every row pays for that.
FEW_SPANS = 6
#: Up to this depth paths are put together level by level, beyond it by pointer jumping.
FEW_LEVELS = 16
#: Digits of packed names, in byte order.
DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"
#: One in so many pairs tells where ranges are cut and how many pairs are equal.
PART = 64
#: Edges are made distinct if fewer than this part of them are.
DISTINCT_PART = 0.8
#: Levels of a directed search after which the visited nodes are written together again.
COMPACT_EVERY = 64


# --- one step ---------------------------------------------------------------


def expand(
    frontier: DataFrame,
    moves: Column,
    next_state: Callable[[DataFrame], DataFrame],
    extend: Column,
) -> DataFrame:
    """Every frontier state (state, path) under every allowed move, duplicates kept.

    `moves` is a constant array of the allowed transitions; `next_state` replaces
    `state` by its successor and `extend` gives the longer path.
    """
    paired = frontier.select("*", F.inline(moves))
    return next_state(paired.withColumn("path", extend)).select("state", "path")


def expand_edges(
    frontier: DataFrame,
    edges: DataFrame,
    distance: int,
) -> DataFrame:
    """Frontier (node, path) over an edge table (src, dst), duplicates kept."""
    reached = lookup_join(edges.withColumnRenamed("src", "node"), frontier, "node")
    return reached.select(
        F.col("dst").alias("node"),
        F.lit(distance).alias("distance"),
        F.array_append("path", F.col("dst")).alias("path"),
    )


def dedupe_new(candidates: DataFrame, visited: DataFrame, on: str, choice: Column) -> DataFrame:
    """One row per new key: `choice` aggregates its candidates, visited keys go.

    The visited keys join the candidates as marked rows, and one aggregation
    both drops them and picks the survivor: a single shuffle, combined before it
    so that no key is hot, and no join.
    """
    rest = [c for c in candidates.columns if c != on]
    marked = visited.select(
        on, *[F.lit(None).cast(candidates.schema[c].dataType).alias(c) for c in rest],
        F.lit(1).alias("_old"),
    )
    return (
        candidates.select(on, *rest, F.lit(0).alias("_old"))
        .unionByName(marked)
        .groupBy(on)
        .agg(choice, F.max("_old").alias("_old"))
        .where("_old = 0")
        .drop("_old")
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


# --- implicit graphs --------------------------------------------------------


class PathCode:
    """How a path is carried during a search.

    All paths of a level have equal length, so packing token numbers into a
    bigint keeps their byte order and `min` stays a hash aggregate.  Paths too
    long for that are carried as arrays.
    """

    def __init__(self, tokens: list[str], max_depth: int):
        self.tokens = sorted(tokens)
        self.bits = max(1, (len(self.tokens) - 1).bit_length())
        self.packed = self.bits * max_depth <= 62

    def start(self) -> Column:
        return F.lit(0).cast("bigint") if self.packed else F.array().cast("array<string>")

    def extend(self) -> Column:
        """The path longer by the move (number, token) in the row."""
        if self.packed:
            return F.shiftleft("path", self.bits).bitwiseOR(F.col("number").cast("bigint"))
        return F.array_append("path", F.col("token"))

    def text(self, distance: int, sep: str = " ") -> Column:
        """The path as text; plain shifts when packed."""
        if not self.packed:
            return F.array_join("path", sep)
        names = F.array(*[F.lit(t) for t in self.tokens])
        mask = F.lit((1 << self.bits) - 1)
        steps = [
            F.get(names, F.shiftright("path", self.bits * at).bitwiseAND(mask).cast("int"))
            for at in range(distance - 1, -1, -1)
        ]
        return F.concat_ws(sep, *steps) if steps else F.lit("")

    def array(self, distance: int) -> Column:
        if not self.packed:
            return F.col("path")
        if distance == 0:
            return F.array().cast("array<string>")
        return F.split(self.text(distance), " ")


def bfs_states(
    seeds: DataFrame,
    keys: TextKeys | PackedKeys,
    tokens: list[str],
    max_depth: int,
    next_state: Callable[[DataFrame], DataFrame] | None = None,
    inverse_closed: bool | None = None,
) -> DataFrame:
    """Shortest paths from `seeds` (state) on the graph that the tokens span.

    Returns state, distance, path: each state once, with the smallest of its
    shortest paths in byte order.  If every token's inverse is allowed too, which
    is looked up unless the caller says so, a neighbour of a level lies at most
    one level back, so two levels are enough to recognise old states.  Without
    seeds the result is empty.
    """
    if inverse_closed is None:
        inverses = {t.token: t.inverse for t in TRANSITIONS}
        inverse_closed = all(inverses.get(t) in tokens for t in tokens)
    code = PathCode(tokens, max_depth)
    moves = keys.moves(code.tokens)
    next_state = next_state or keys.successor
    level = checkpointed(seeds.select("state").distinct().select("state", code.start().alias("path")))
    levels, sizes = [level], [level.count()]
    while len(levels) <= max_depth and sizes[-1]:
        back = 2 if inverse_closed else len(levels)
        found = dedupe_new(
            expand(level, moves, next_state, code.extend()),
            union_all(levels[-back:]),
            "state",
            F.min("path").alias("path"),
        )
        level = checkpointed(found)
        levels.append(level)
        sizes.append(level.count())
    return union_all(
        [
            rows.select("state", F.lit(distance).alias("distance"), code.array(distance).alias("path"))
            for distance, rows in enumerate(levels)
            if sizes[distance] or not distance
        ]
    )


# --- edge tables ------------------------------------------------------------


def _all_of(schemas: list, *kinds: type[DataType]) -> bool:
    return all(isinstance(f.dataType, kinds) for schema in schemas for f in schema)


@dataclass
class NameCode:
    """Names of up to `width` characters, each out of `alphabet`, as bigints in the same order, and back.

    A name is a number whose digits are the places of its characters, filled up
    with zeros behind its end, and then its length, which tells apart what the
    zeros made equal: the shorter comes first.  Characters that are digits as
    they stand are not replaced.  `fits` tells whether a bigint holds all names.
    """

    alphabet: str
    width: int

    def __post_init__(self):
        self.bits = self.width.bit_length()
        self.plain = all(c in DIGITS for c in self.alphabet) and self._holds(DIGITS.index(max(self.alphabet, default="0")) + 1)
        self.base = max(2, DIGITS.index(max(self.alphabet, default="0")) + 1 if self.plain else len(self.alphabet))
        self.fits = all(" " <= c <= "~" for c in self.alphabet) and self.base <= len(DIGITS) and self._holds(self.base)

    def _holds(self, base: int) -> bool:
        return max(2, base) ** self.width << self.bits < 1 << 63

    def pack(self, name: str) -> Column:
        digits = F.col(name) if self.plain else F.translate(name, self.alphabet, DIGITS[: self.base])
        number = F.conv(F.rpad(digits, self.width, DIGITS[0]), self.base, 10).cast("bigint")
        return F.shiftleft(number, self.bits).bitwiseOR(F.length(name).cast("bigint"))

    def text(self, number: str) -> Column:
        length = F.col(number).bitwiseAND(F.lit((1 << self.bits) - 1)).cast("int")
        digits = F.lower(F.conv(F.shiftright(number, self.bits).cast("string"), 10, self.base))
        digits = F.substring(F.lpad(digits, self.width, DIGITS[0]), F.lit(1), length)
        return digits if self.plain else F.translate(digits, DIGITS[: self.base], self.alphabet)


@dataclass
class KeyCode:
    """Names of one ASCII character and a number of up to `digits` digits, without leading zeros, as bigints in the same order, and back.

    The digits stand as they are, filled up with zeros behind their end, and
    their number tells apart what the zeros made equal.
    """

    digits: int
    #: More digits do not fit.
    MOST = 15

    @property
    def width(self) -> int:
        return 1 + self.digits

    @classmethod
    def loose(cls, name: str) -> Column:
        """A name as a bigint that is in no order yet, as its digits are not filled up; NULL if it is no such name."""
        digits = F.expr(f"substring({name}, 2)")
        number, length = digits.try_cast("bigint"), F.octet_length(digits)
        kept = (number.cast("string") == digits) & (number >= 0) & length.between(1, cls.MOST) & (F.ascii(name) < 128)
        return F.when(kept, F.shiftleft(F.ascii(name) * F.lit(10**cls.MOST) + number, 4).bitwiseOR(length.cast("bigint")))

    def _filling(self, number: str) -> str:
        """Ten to the number of zeros behind the digits."""
        powers = ", ".join(f"{10 ** max(0, self.digits - n)}L" for n in range(self.MOST + 1))
        return f"get(array({powers}), cast({number} & 15 as int))"

    def pack(self, loose: str) -> Column:
        first, rest = [f"shiftright({loose}, 4) {o} {10**self.MOST}L" for o in ("div", "%")]
        return F.expr(f"shiftleft(({first}) * {10**self.digits}L + ({rest}) * {self._filling(loose)}, 4) | ({loose} & 15)")

    def text(self, number: str) -> Column:
        first, rest = [f"shiftright({number}, 4) {o} {10**self.digits}L" for o in ("div", "%")]
        return F.expr(f"concat(char({first}), ({rest}) div {self._filling(number)})")


def key_coded(pairs: DataFrame, seeds: DataFrame) -> tuple[KeyCode, DataFrame, DataFrame] | None:
    """The code and `pairs` (src, dst) and `seeds` (node) in it; None if a name does not fit.

    The loose form of the names is written and tells the most digits; it is
    packed where it is read.
    """
    loose = [df.select(*[KeyCode.loose(c).alias(c) for c in df.columns]) for df in (pairs, seeds)]
    unfit = lambda df: reduce(Column.__or__, [F.col(c).isNull() for c in df.columns])
    # a few rows tell most tables that do not fit, before all are written
    if any(not df.limit(1000).where(unfit(df)).isEmpty() for df in loose):
        return None
    digits = 1
    for i, df in enumerate(loose):
        loose[i] = df = cut(df)
        longest = F.max(F.greatest(F.lit(1), *[F.col(c).bitwiseAND(F.lit(15)) for c in df.columns]))
        found = df.agg(F.bool_or(unfit(df)), longest).first()
        if found[0]:
            return None
        digits = max(digits, found[1] or 0)
    code = KeyCode(int(digits))
    pairs, seeds = [df.select(*[code.pack(c).alias(c) for c in df.columns]) for df in loose]
    return code, pairs, seeds


def name_code(pairs: DataFrame, seeds: DataFrame) -> NameCode | None:
    """A code that holds every name of `pairs` (src, dst) and `seeds` (node); None if there is none.

    The characters of a few names are taken off all of them first, so that the
    pass over the rest has next to nothing to count.
    """
    plain = StringType()
    if any(f.dataType != plain for f in [*pairs.schema, *seeds.schema]):
        return None
    names = pairs.select(F.explode(F.array("src", "dst")).alias("name")).unionByName(seeds.select(F.col("node").alias("name")))
    common = {c for r in pairs.limit(1000).collect() for name in r for c in name if " " <= c <= "~"}
    rest = F.translate("name", "".join(sorted(common)), "") if common else F.col("name")
    others = F.when(rest != "", F.array_distinct(F.split(rest, "")))
    counted = names.select(F.length("name").alias("n"), F.explode_outer(others).alias("c")).groupBy("c").agg(F.max("n").alias("n"))
    found = counted.limit(2 * len(DIGITS)).collect()
    alphabet = common | {c for r in found if r["c"] for c in r["c"]}
    code = NameCode("".join(sorted(alphabet)), max([1, *(r["n"] for r in found)]))
    return code if len(found) < 2 * len(DIGITS) and code.fits else None


def node_numbers(pairs: DataFrame, seeds: DataFrame) -> DataFrame | None:
    """(name, id): dense numbers of all nodes in the order of their names; None if names are integers already.

    Numbers keep the order of names, so a search may compare them instead, its
    edges are two bigints, and names are only joined to its result.
    """
    if _all_of([pairs.schema, seeds.schema], ByteType, ShortType, IntegerType, LongType):
        return None
    names = pairs.select(F.explode(F.array("src", "dst")).alias("name")).unionByName(seeds.select(F.col("node").alias("name")))
    return cut(numbered(cut(names.distinct()), ["name"], "id"))


def joined_spans(spans: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """At most `most` spans that hold the given ones, which do not overlap; the widest gaps stay open."""
    spans = sorted(spans)
    gaps = sorted(range(1, len(spans)), key=lambda i: spans[i][0] - spans[i - 1][1], reverse=True)
    cuts = [0, *sorted(gaps[: most - 1]), len(spans)]
    return [(spans[a][0], spans[b - 1][1]) for a, b in zip(cuts, cuts[1:]) if a < b]


def measures(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row about all `pairs` (src, dst): count, least and greatest node; one about a part of them.

    The second has RANGES - 1 quantiles of src and of dst, the count and the
    count of distinct pairs.  These only guide the layout and cost far more a
    row, so they see one in PART pairs; a pair is in that part with all its
    equals, which keeps the share of distinct ones.
    """
    whole = pairs.agg(F.count(F.lit(1)), F.min(F.least("src", "dst")), F.max(F.greatest("src", "dst")))
    cuts = [i / RANGES for i in range(1, RANGES)]
    few = pairs.where(F.pmod(F.xxhash64("src", "dst"), F.lit(PART)) == 0)
    quantiles = [F.percentile_approx(c, cuts, 1000) for c in ("src", "dst")]
    return whole, few.agg(*quantiles, F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64("src", "dst")))


class Adjacency:
    """Edges (src, dst), two bigints, laid out once for all levels of a search; `pairs` may repeat them.

    Rows are written in buckets of src, sorted, in small row groups.  Equal edges
    change no level; if many are equal, by an estimate, one of each stays, in the
    bucket where they meet.  A large level is shuffled to the buckets, each of
    which holds its part of the level, and the edges never move.  A small one is
    broadcast, and its ranges of nodes tell the scan which row groups, and for
    a few nodes which buckets, to read at all.  A source with many edges gets one
    salt per EDGES_PER_SALT of them, so no task holds a hub; the frontier row of
    a hub is repeated once per salt.  Hubs are fewer than edges / EDGES_PER_SALT;
    their equal edges go before they are shuffled.  `pairs` is read several
    times, so a written table is best.
    """

    def __init__(self, pairs: DataFrame, directed: bool, per_salt: int = EDGES_PER_SALT):
        spark = pairs.sparkSession
        edges = pairs.select("src", "dst")
        if not directed:
            edges = edges.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        self.hubs = keys_over(edges.select("src"), ["src"], lambda n: n > per_salt)
        self.hubs = cut(self.hubs.select("src", F.ceil(F.col("n_rows") / per_salt).cast("int").alias("n_salts")))
        self.n_hubs = self.hubs.count()
        self.on = ["src"]
        if self.n_hubs:
            self.on = ["src", "salt"]
            edges = lookup_join(edges, self.hubs, "src", "left", small=self.n_hubs <= SMALL_LEVEL)
            hot = edges.where("n_salts is not null").distinct()
            hot = hot.select("src", F.pmod(F.xxhash64("dst"), F.col("n_salts")).cast("int").alias("salt"), "dst")
            edges = edges.where("n_salts is null").select("src", F.lit(0).alias("salt"), "dst").unionByName(hot)
        whole, part = (df.first() for df in measures(pairs))
        self.low, self.high = whole[1] or 0, (whole[2] or 0) + 1
        #: Where a level's nodes are cut into ranges; any numbers will do, these part the edges evenly.
        self.bounds = sorted({*(part[0] or [])} | {*(part[1] or [])})
        n_edges = whole[0] * (1 if directed else 2)
        self.buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_edges // EDGES_PER_BUCKET))
        self.edges = write_bucketed(edges.select(*self.on, "dst"), self.on, self.buckets, GROUP_BYTES, GROUP_ROWS, part[3] < DISTINCT_PART * part[2])

    def near(self, level: Level) -> DataFrame:
        """The edges that a small level can reach, by filters that reach the scan."""
        if level.nodes is not None:
            return self.edges.where(F.col("src").isin(level.nodes))
        return self.edges.where(reduce(Column.__or__, [F.col("src").between(a, b) for a, b in joined_spans(level.ranges, FEW_SPANS)]))

    def neighbours(self, level: Level) -> DataFrame:
        """(node, parent) for every edge that leaves the level; parent is the place of its node."""
        nodes = level.rows.select(F.col("node").alias("src"), "place")
        if level.size <= SMALL_LEVEL:
            reached = self.near(level).join(F.broadcast(nodes), "src")
        else:
            if self.n_hubs:
                nodes = lookup_join(nodes, self.hubs, "src", "left", small=self.n_hubs <= SMALL_LEVEL)
                salts = F.sequence(F.lit(0), F.coalesce(F.col("n_salts"), F.lit(1)) - 1)
                nodes = nodes.select("src", "place", F.explode(salts).alias("salt"))
            # no bucket holds more nodes than edges; sorting the edges again for every level is spared
            reached = self.edges.join(nodes.hint("shuffle_hash"), self.on)
        return reached.select(F.col("dst").alias("node"), F.col("place").alias("parent"))


@dataclass
class Level:
    """A written level: `rows` (node, parent, place), how many, and where its nodes lie.

    `nodes` names them if they are few; `ranges` are at most 2 * RANGES spans that hold them all.
    """

    rows: DataFrame
    size: int
    ranges: list[tuple[int, int]]
    nodes: list[int] | None


class Forest:
    """The levels of a search, each a written folder of (node, parent).

    `place` numbers all nodes in the order they are found: levels one after the
    other, within a level by the place of the parent, then by node.  That is the
    order of the paths as arrays, so the least place of a predecessor gives the
    smallest path, and a node and its parent's place are all that a level carries.
    The places of a small level follow from its rows; a large one is sorted by
    range and numbered from the counts of its partitions.
    """

    def __init__(self, spark: SparkSession, low: int, high: int, bounds: list[int] | None = None):
        self.spark = spark
        # without bounds, spans of equal width
        self.bounds = bounds or sorted({low + (high - low) * i // RANGES for i in range(1, RANGES)})
        self.small, self.large = scratch_path(spark, "levels"), scratch_path(spark, "large-levels")
        self.sizes: list[int] = []
        self.bases: list[int] = []
        self.levels: list[DataFrame] = []

    def add(self, found: DataFrame) -> Level:
        distance, base = len(self.sizes), sum(self.sizes)
        place = f"{self.small}/distance={distance}"
        found.select("node", "parent").write.option("parquet.block.size", GROUP_BYTES).parquet(place)
        rows = self.spark.read.schema("node bigint, parent bigint").parquet(place)
        part = reduce(Column.__add__, [(F.col("node") >= F.lit(b)).cast("int") for b in self.bounds], F.lit(0))
        spans = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("a"), F.max("node").alias("b")).collect()
        size = sum(r["n"] for r in spans)
        self.sizes.append(size)
        self.bases.append(base)
        if size <= SMALL_LEVEL:
            order = Window.partitionBy(F.lit(0)).orderBy("parent", "node")
            ranked = rows.withColumn("place", F.row_number().over(order) + F.lit(base - 1).cast("bigint"))
        else:
            numbered(rows, ["parent", "node"], "place", base).write.parquet(f"{self.large}/distance={distance}")
            ranked = self.spark.read.schema("node bigint, parent bigint, place bigint").parquet(f"{self.large}/distance={distance}")
        self.levels.append(ranked)
        few = [r["node"] for r in rows.select("node").collect()] if 0 < size <= FEW_NODES else None
        return Level(ranked, size, [(r["a"], r["b"]) for r in spans], few)

    def rows(self) -> DataFrame:
        """(node, parent, place, distance) of all levels, from one scan of the small and one of the large."""
        levels = [(d, base, size > SMALL_LEVEL) for d, (base, size) in enumerate(zip(self.bases, self.sizes)) if size]
        fields = "node bigint, parent bigint, distance int"
        if not levels:
            return self.spark.createDataFrame([], "node bigint, parent bigint, place bigint, distance int")
        out = []
        if any(not large for _, _, large in levels):
            bases = self.spark.createDataFrame([(d, b) for d, b, large in levels if not large], "distance int, base bigint")
            small = self.spark.read.schema(fields).parquet(self.small).join(F.broadcast(bases), "distance")
            order = Window.partitionBy("distance").orderBy("parent", "node")
            out.append(small.select("node", "parent", (F.row_number().over(order) - 1 + F.col("base")).alias("place"), "distance"))
        if any(large for _, _, large in levels):
            schema = "node bigint, parent bigint, place bigint, distance int"
            out.append(self.spark.read.schema(schema).parquet(self.large).select("node", "parent", "place", "distance"))
        return union_all(out)


class Visited:
    """The nodes of a directed search in buckets, so that only candidates move to be compared with them."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.parts, self.name = spark, buckets, 0, None

    def append(self, nodes: DataFrame) -> None:
        """Adds the nodes as further files of the buckets; many small ones are written together again."""
        if self.parts and self.parts % COMPACT_EVERY == 0:
            nodes = nodes.unionByName(self.spark.table(self.name))
            self.name = None
        if self.name is None:
            self.name = bucketed_name(self.spark)
        add_bucketed(nodes, self.name, ["node"], self.buckets)
        self.parts += 1

    def without(self, found: DataFrame) -> DataFrame:
        return found.join(self.spark.table(self.name), "node", "left_anti")


def assembled(rows: DataFrame, depth: int, small: Callable[[int], bool]) -> DataFrame:
    """(node, distance, path) from `rows` (place, parent, node, distance) by pointer jumping.

    Every row holds the last nodes of its path and the place before them; a round
    puts the row of that place in front, which doubles what is known, so the
    logarithm of the depth is enough rounds.  Finished rows take no part.
    `small(n)` tells whether rows with n nodes each can be broadcast.
    """
    rows = rows.select("place", F.col("parent").alias("jump"), F.array("node").alias("path"), "node", "distance")
    for done in range(depth.bit_length()):
        rows = cut(rows)
        ahead = rows.select(F.col("place").alias("jump"), F.col("jump").alias("next"), F.col("path").alias("before"))
        moved = lookup_join(rows.where("jump is not null"), ahead, "jump", small=small(1 << done)).select(
            "place", F.col("next").alias("jump"), F.concat("before", "path").alias("path"), "node", "distance"
        )
        rows = rows.where("jump is null").unionByName(moved)
    return rows.select("node", "distance", "path")


def level_paths(forest: Forest, named: Callable[[DataFrame], DataFrame], kind: DataType, small: Callable[[int, int], bool], place: str) -> DataFrame:
    """(node, distance, path), written to `place` level by level.

    A row takes the finished path of its parent, one level before, so every path
    is joined and written once.  `named` replaces the numbers of nodes by their
    names; `small(rows, n)` tells whether that many rows with paths of n nodes
    can be broadcast.
    """
    spark, element = forest.spark, kind.simpleString()
    for distance, (rows, size) in enumerate(zip(forest.levels, forest.sizes)):
        if distance and not size:
            continue
        rows = named(rows)
        if distance:
            before = spark.read.schema(f"place bigint, path array<{element}>").parquet(f"{place}/distance={distance - 1}")
            before = before.select(F.col("place").alias("parent"), F.col("path").alias("before"))
            fits = small(forest.sizes[distance - 1], distance)
            if size <= SMALL_LEVEL and not fits:
                rows = before.join(F.broadcast(rows), "parent")
            else:
                rows = lookup_join(rows, before, "parent", small=fits)
            path = F.array_append("before", F.col("node"))
        else:
            path = F.array("node")
        rows.select("place", "node", path.alias("path")).write.parquet(f"{place}/distance={distance}")
    found = spark.read.schema(f"node {element}, path array<{element}>, distance int").parquet(place)
    return found.select("node", "distance", "path")


def bfs_paths(
    edges: DataFrame,
    seeds: DataFrame,
    max_depth: int | None = None,
    directed: bool = False,
    per_salt: int = EDGES_PER_SALT,
) -> DataFrame:
    """Shortest paths over an edge table (src, dst) from the seeds (node).

    Runs until a level finds nothing new, or for `max_depth` levels.  Returns
    node, distance, path (seed ... node): each reached node once, with the smallest
    of its shortest paths, compared node by node.  Levels work on numbers of the
    nodes and carry no paths; what they wrote is dropped once the result is.
    Short names out of few characters are packed into such numbers in place;
    others are numbered and joined.  `edges` is read twice for that.
    """
    spark = edges.sparkSession
    with scratch_scope(spark) as scope:
        pairs = edges.select("src", "dst").where("src <> dst")
        starts = cut(seeds.select("node").where("node is not null").distinct())
        kind = starts.schema["node"].dataType
        names, width, few_names = None, 8, True
        text = all(f.dataType == StringType() for f in [*pairs.schema, *starts.schema])
        if text and (coded := key_coded(pairs, starts)):
            code, pairs, starts = coded
        elif code := name_code(pairs, starts):
            pairs = cut(pairs.select(code.pack("src").alias("src"), code.pack("dst").alias("dst")))
            starts = starts.select(code.pack("node").alias("node"))
        if code is not None:
            width = code.width
            named = lambda rows: rows.withColumn("node", code.text("node"))
        elif (names := node_numbers(pairs := cut(pairs.distinct()), starts)) is None:
            pairs = pairs.select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"))
            starts = starts.select(F.col("node").cast("bigint").alias("node"))
            named = lambda rows: rows.withColumn("node", F.col("node").cast(kind))
        else:
            measured = names.agg(F.count(F.lit(1)), F.max(F.octet_length(F.col("name").cast("string")))).first()
            width = measured[1] or 0
            few_names = measured[0] * (width + 64) <= BROADCAST_BYTES
            number = lambda df, c: lookup_join(df.withColumnRenamed(c, "name"), names, "name", small=few_names).drop("name").withColumnRenamed("id", c)
            pairs = cut(number(number(pairs, "src"), "dst").select("src", "dst"))
            starts = number(starts, "node")
            named = lambda rows: lookup_join(rows.withColumnRenamed("node", "id"), names, "id", small=few_names).withColumnRenamed("name", "node")
        graph = Adjacency(pairs, directed, per_salt)
        forest = Forest(spark, graph.low, graph.high, graph.bounds)
        levels = [forest.add(starts.select("node", F.lit(None).cast("bigint").alias("parent")))]
        visited = Visited(spark, graph.buckets)
        while levels[-1].size and (max_depth is None or len(forest.sizes) <= max_depth):
            candidates = graph.neighbours(levels[-1])
            if directed:
                visited.append(levels[-1].rows.select("node"))
                found = visited.without(candidates.groupBy("node").agg(F.min("parent").alias("parent")))
            else:
                old = union_all([level.rows.select("node") for level in levels])
                found = dedupe_new(candidates, old, "node", F.min("parent").alias("parent"))
            levels = [levels[-1], forest.add(found)]
        total, depth = sum(forest.sizes), max([d for d, n in enumerate(forest.sizes) if n], default=0)
        small = lambda rows, n: rows * (n * (width + 16) + 64) <= BROADCAST_BYTES
        if depth > FEW_LEVELS:
            return scope.keep(assembled(named(forest.rows()), depth, lambda n: small(total, n)))
        place = scratch_path(spark, "paths")
        found = level_paths(forest, named, kind, small, place)
        scope.release(place)
        return found


def expand_n(edges: DataFrame, seeds: DataFrame, passes: int, directed: bool = False) -> DataFrame:
    """A fixed number of passes: everything within `passes` edges of a seed."""
    return bfs_paths(edges, seeds, passes, directed)
