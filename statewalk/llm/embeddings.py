"""Near duplicates among embeddings by PCA-ordered tiled comparison.

Vectors are turned into the directions of largest spread.  Two unit vectors of
cosine c are sqrt(2 - 2c) apart.  Cells with too many vectors for a tile are cut
along one leading coordinate after the other, and a vector visits those cells
only that are no farther from it than that.  In a tile products are summed from
the leading coordinates on, and a pair of vectors is given up as soon as the
norms of what is left cannot reach the threshold.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statewalk.llm.components import component_roots
from statewalk.operators.joins import lookup_join
from statewalk.sources.store import cut

#: Members of a tile; visitors of one, as a multiple; rows compared at once.
TILE_ROWS = 4096
SLICE_TILES = 4
BLOCK_ROWS = 512
#: Axes along which cells are cut, and how many at a time.
SPLIT_AXES = 24
SPLIT_STEP = 2
#: Coordinates summed before the first bound, and before each further one.
STEP = 16
SLACK = 1e-9
#: Allowed for in squared distances, far above their rounding.
BOX_SLACK = 1e-6


def linkable(vector: str) -> Column:
    """Whether all components are finite and one is not zero."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(wide, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(wide, lambda x: x != 0), F.lit(False))


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, by way of their largest component so that nothing overflows."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def matrix(column: pa.Array) -> np.ndarray:
    """Equally long lists as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def principal_axes(vectors: DataFrame, limit: int) -> dict[int, np.ndarray]:
    """Per length of vector, the axes of a sample of at most `limit`, widest spread first.

    Any orthonormal axes give the same links; better ones give them sooner.
    Lengths that the sample lacks are compared along the given coordinates.
    """
    sample = vectors.orderBy(F.xxhash64("vector"), "vector").limit(limit).select("vector").collect()
    by_length: dict[int, list] = {}
    for row in sample:
        by_length.setdefault(len(row["vector"]), []).append(row["vector"])
    axes = {}
    for n, rows in by_length.items():
        unit = unit_rows(np.array(rows, dtype=np.float64))
        _, found = np.linalg.eigh(unit.T @ unit)
        axes[n] = np.ascontiguousarray(found[:, ::-1])
    return axes


def linked_pairs(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of `a` and `b`, both turned and of length one, whose product reaches `threshold`."""
    dims = a.shape[1]
    first = min(STEP, dims)
    # norms of the coordinates from each step on
    squares_a, squares_b = a * a, b * b
    rest = lambda s, at: np.sqrt(s[:, at:].sum(axis=1))
    sums = a[:, :first] @ b[:, :first].T
    left, right = np.nonzero(sums + np.outer(rest(squares_a, first), rest(squares_b, first)) >= threshold - SLACK)
    at, sums = first, sums[left, right]
    while at < dims and len(left):
        upto = min(at + STEP, dims)
        sums = sums + np.einsum("ij,ij->i", a[left, at:upto], b[right, at:upto])
        at = upto
        bound = sums + rest(squares_a, at)[left] * rest(squares_b, at)[right]
        keep = bound >= threshold - SLACK
        left, right, sums = left[keep], right[keep], sums[keep]
    return left, right


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least row reachable from each of n rows over the links."""
    root = np.arange(n)
    while True:
        before = root.copy()
        least = np.minimum(root[left], root[right])
        np.minimum.at(root, left, least)
        np.minimum.at(root, right, least)
        root = root[root]
        if (root == before).all():
            return root


def apart(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether the boxes around two blocks of turned rows are too far apart for a link."""
    gap = np.maximum(np.maximum(b.min(axis=0) - a.max(axis=0), a.min(axis=0) - b.max(axis=0)), 0)
    return gap @ gap > 2 - 2 * threshold + BOX_SLACK


def compare_tiles(table: pa.Table, threshold: float, axes: dict[int, np.ndarray]) -> pa.Table:
    """For the members and visitors of a tile: each linked row, its links here, a row it is joined to.

    Side 1 are visitors, 2 members that are compared with each other too, 0
    members that another task compares with each other.
    """
    plain = unit_rows(matrix(table.column("vector").combine_chunks()))
    turned = plain @ axes[plain.shape[1]] if plain.shape[1] in axes else plain
    # along the widest axis, so that blocks are flat boxes
    order = np.argsort(turned[:, turned.var(axis=0).argmax()], kind="stable")
    plain, turned = plain[order], turned[order]
    ids = table.column("rid").to_numpy()[order]
    copies = table.column("copies").to_numpy()[order]
    side = table.column("side").to_numpy()[order]

    def blocks(rows: np.ndarray) -> list[np.ndarray]:
        return [rows[i : i + BLOCK_ROWS] for i in range(0, len(rows), BLOCK_ROWS)]

    members, visitors = blocks(np.nonzero(side != 1)[0]), blocks(np.nonzero(side == 1)[0])
    among = members if (side == 2).any() else []
    lefts, rights = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for i, rows in enumerate(members):
        for others in among[i:] + visitors:
            if apart(turned[rows], turned[others], threshold):
                continue
            left, right = linked_pairs(turned[rows], turned[others], threshold)
            left, right = rows[left], others[right]
            # rows of one block meet twice, and themselves
            once = (left < right) | (rows is not others)
            left, right = left[once], right[once]
            exact = np.einsum("ij,ij->i", plain[left], plain[right]) >= threshold
            lefts.append(left[exact])
            rights.append(right[exact])
    left, right = np.concatenate(lefts), np.concatenate(rights)
    links = np.bincount(left, copies[right], len(ids)) + np.bincount(right, copies[left], len(ids))
    root = local_roots(len(ids), left, right)
    linked = np.nonzero(links)[0]
    return pa.table(
        {"rid": pa.array(ids[linked]), "links": pa.array(links[linked].astype(np.int64)), "joined": pa.array(ids[root[linked]])}
    )


def leading(distinct: DataFrame, axes: dict[int, np.ndarray]) -> DataFrame:
    """(rid, n, lead): the length of each vector and its first SPLIT_AXES coordinates along the axes."""

    def turn(batches):
        for batch in batches:
            lists = batch.column("vector")
            lengths = np.asarray(lists.value_lengths())
            lead = np.zeros((batch.num_rows, SPLIT_AXES))
            for n in np.unique(lengths):
                at = np.nonzero(lengths == n)[0]
                unit = unit_rows(matrix(lists.take(pa.array(at))))
                turned = unit @ axes[int(n)][:, :SPLIT_AXES] if int(n) in axes else unit[:, :SPLIT_AXES]
                lead[at, : turned.shape[1]] = turned
            columns = [batch.column("rid"), pa.array(lengths, pa.int32()), pa.array(list(lead), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["rid", "n", "lead"])

    return distinct.select("rid", "vector").mapInArrow(turn, "rid bigint, n int, lead array<double>")


def next_cell(width: float) -> list[Column]:
    """The places of a row along the next axes, in steps of `width`."""
    return [F.floor(F.get("lead", k) / width).cast("int") for k in range(SPLIT_STEP)]


def step_on(visits: DataFrame, width: float) -> DataFrame:
    """Each visit of a cell as visits of the finer cells in it that can hold a link.

    `gap` is the squared distance from the row to the finer cell as far as the
    axes so far tell, which no link exceeds.  From its own cell a row goes to
    later neighbours only, as the earlier ones send theirs.
    """
    near = []
    for offset in product((-1, 0, 1), repeat=SPLIT_STEP):
        gap, stay = F.col("gap"), F.lit(not any(offset))
        for k, (cell, o) in enumerate(zip(next_cell(width), offset)):
            if o:
                away = F.get("lead", k) - (cell + max(o, 0)) * width
                gap = gap + away * away
        code = F.concat("code", F.array(*[cell + o for cell, o in zip(next_cell(width), offset)]))
        from_own = F.lit(offset >= (0,) * SPLIT_STEP)
        fits = (gap <= width * width + BOX_SLACK) & (~F.col("own") | from_own)
        near.append(F.struct(code.alias("code"), gap.alias("gap"), (F.col("own") & stay).alias("own"), fits.alias("fits")))
    found = F.filter(F.array(*near), lambda v: v["fits"])
    left = F.slice("lead", SPLIT_STEP + 1, SPLIT_AXES).alias("lead")
    return visits.select("rid", F.explode(found).alias("v"), left).select("rid", "v.own", "v.code", "v.gap", "lead")


def visits_of_cells(rows: DataFrame, threshold: float, tile_rows: int) -> DataFrame:
    """(rid, own, code, members): each row in its own cell and in those that can hold a link to it.

    A cell is all vectors of one length at first.  One with over `tile_rows`
    members is cut along the next axes, until SPLIT_AXES are used up.  Cells that
    nothing lies in are dropped by the join, so visits follow the data and not
    the number of neighbours a grid has.
    """
    width = float(np.sqrt(2 - 2 * threshold)) + SLACK
    start = F.array(F.col("n")).alias("code")
    visits = cut(rows.select("rid", F.lit(True).alias("own"), start, F.lit(0.0).alias("gap"), "lead"))
    members = visits.select("code")
    done = []
    for used in range(0, SPLIT_AXES + 1, SPLIT_STEP):
        sizes = cut(members.groupBy("code").agg(F.count(F.lit(1)).alias("members")))
        met = cut(lookup_join(visits, sizes, "code"))
        large = (F.col("members") > tile_rows) & F.lit(used < SPLIT_AXES)
        done.append(met.where(~large).select("rid", "own", "code", "members"))
        rest = met.where(large).drop("members")
        if rest.isEmpty():
            break
        members = rest.where("own").select(F.concat("code", F.array(*next_cell(width))).alias("code"))
        visits = step_on(rest, width)
    return reduce(DataFrame.unionByName, done)


def dealt_tiles(visits: DataFrame, tile_rows: int) -> DataFrame:
    """(tile, side, rid): which tiles each row takes part in, and on which side.

    A tile is a part of a cell's members with a slice of its visitors, at most
    about 1 + SLICE_TILES times `tile_rows` rows.  Members of later parts of a
    cell that no axis cuts any further visit the earlier ones.
    """
    guests = cut(visits.where("not own").groupBy("code").agg(F.count(F.lit(1)).alias("guests")))
    visits = lookup_join(visits, guests, "code", "left").withColumn("guests", F.coalesce("guests", F.lit(0)))
    visits = visits.where("members + guests > 1")
    parts = F.ceil(F.col("members") / tile_rows).cast("int")
    slices = F.ceil((F.col("guests") + (parts - 1) * tile_rows) / (SLICE_TILES * tile_rows)).cast("int")
    visits = visits.withColumn("parts", parts).withColumn("slices", F.greatest(F.lit(1), slices))
    visits = visits.withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int"))
    slice_ = F.pmod(F.xxhash64("rid", F.lit(1)), F.col("slices")).cast("int").alias("slice")

    def tile(part: Column, slice_: Column, side: Column) -> Column:
        return F.struct(part.alias("part"), slice_.alias("slice"), side.alias("side"))

    at_home = F.transform(
        F.sequence(F.lit(0), F.col("slices") - 1), lambda s: tile(F.col("part"), s, F.when(s == 0, 2).otherwise(0))
    )
    upto = F.when(F.col("own"), F.col("part")).otherwise(F.col("parts"))
    away = F.transform(
        F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: p < upto), lambda p: tile(p, slice_, F.lit(1))
    )
    taken = F.when(F.col("own"), F.concat(at_home, away)).otherwise(away)
    taken = visits.select("code", "rid", F.explode(taken).alias("t"))
    return taken.select(F.struct("code", "t.part", "t.slice").alias("tile"), "t.side", "rid")


def embedding_groups(
    vectors: DataFrame,
    threshold: float = 0.95,
    id: str = "vec_id",
    vector: str = "embedding",
    sample: int = 10_000,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """Returns the id, n_links, component and kept for each row of `vectors`.

    Rows are linked if the cosine of their vectors, in double precision, is at
    least `threshold`; component is the least id reachable, kept marks the row
    with that id.  A vector that is null, empty, zero or holds null or non-finite
    components links with nothing, nor do vectors of different lengths.  Equal
    vectors are folded into one that counts as many.  Null ids take part and
    name a component only if all its ids are null; an empty table gives an empty
    result; other columns are not looked at.
    """
    rows = vectors.select(F.col(id).alias("id"), F.col(vector).alias("vector"))
    good = rows.where(linkable("vector"))
    distinct = cut(
        good.groupBy("vector").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"))
        .withColumn("rid", F.monotonically_increasing_id())
    )
    axes = principal_axes(distinct, sample)
    visits = visits_of_cells(leading(distinct, axes), threshold, tile_rows)
    dealt = dealt_tiles(visits, tile_rows).join(distinct.select("rid", "copies", "vector"), "rid")

    def compare(table: pa.Table) -> pa.Table:
        return compare_tiles(table, threshold, axes)

    found = cut(dealt.groupBy("tile").applyInArrow(compare, "rid bigint, links bigint, joined bigint"))
    counts = found.groupBy("rid").agg(F.sum("links").alias("links"))
    roots = component_roots(found.select(F.col("rid").alias("a"), F.col("joined").alias("b")))
    known = (
        distinct.join(counts, "rid", "left")
        .join(roots.withColumnRenamed("node", "rid"), "rid", "left")
        .select("vector", "least", "copies", "links", F.coalesce("component", "rid").alias("root"))
    )
    known = cut(known)
    named = known.groupBy("root").agg(F.min("least").alias("component"))
    known = known.join(named, "root").select(
        "vector", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    linked = good.join(known, "vector").select("id", "n_links", "component")
    alone = rows.where(~linkable("vector")).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id), "n_links", "component", F.col("id").eqNullSafe(F.col("component")).alias("kept")
    )
