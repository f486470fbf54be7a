"""Hard negatives by bounds along spanning trees of anchors.

Anchors are packed in blocks, each with the least spanning tree of its
anchors; all other vectors in tiles.  Where a block meets a tile, the root
anchor is scored against every vector.  A child's score differs from its
parent's by no more than the length of the edge times the length of the vector,
so only vectors whose bounds reach into the window in question are scored
again; the others hand their wider bounds on to the next anchor.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statewalk.operators.joins import lookup_join
from statewalk.sources.store import cut

#: Vectors in a tile and anchors in a block, fewer where vectors are long.
TILE_ROWS, BLOCK_ANCHORS = 8192, 512
TILE_BYTES = 4 << 20
#: Bytes of anchors that one pass over the tiles broadcasts.
PASS_BYTES = 64 << 20
#: Integer components are held to this size, so that scores of up to 32,768 of them fit a long.
LIMIT = 1 << 24


def finite(vector: str) -> Column:
    """Whether the vector is there and all its components are finite numbers."""
    inside = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    return F.coalesce(F.forall(F.transform(vector, lambda x: x.cast("double")), inside), F.lit(False))


def scaled(vector: str, scale: int) -> Column:
    """floor(scale * x) of every component."""
    wide = lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-float(LIMIT))), F.lit(float(LIMIT))))
    return F.transform(vector, lambda x: wide(x).cast("int"))


# --- inside a task ----------------------------------------------------------


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge): a walk down the least spanning tree, and each point's parent (-1: root) and distance."""
    n = len(points)
    points = points.astype(np.float64)
    near, parent = np.full(n, np.inf), np.full(n, -1)
    done = np.zeros(n, dtype=bool)
    edge, children = np.zeros(n), [[] for _ in range(n)]
    at = 0
    for _ in range(n):
        done[at] = True
        if parent[at] >= 0:
            edge[at] = near[at]
            children[parent[at]].append(at)
        gaps = np.sqrt(((points - points[at]) ** 2).sum(axis=1))
        closer = ~done & (gaps < near)
        near[closer], parent[closer] = gaps[closer], at
        at = int(np.argmin(np.where(done, np.inf, near)))
    order, held = [], [0] if n else []
    while held:
        order.append(held.pop())
        held.extend(children[order[-1]])
    return np.array(order, dtype=np.int64), parent, edge


class Tile:
    """Vectors with their ids and labels, ready to be scored exactly."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels = ids, labels
        self.whole = vectors
        self.real = vectors.astype(np.float64)
        self.norms = np.sqrt((self.real * self.real).sum(axis=1))
        self.most = float(np.abs(self.real).max(initial=0)) * vectors.shape[1]

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Exact inner products; doubles hold them while they stay under 2^53."""
        few = 2 * len(rows) < len(self.ids)
        if self.most * float(np.abs(anchor).max(initial=0)) < 2.0**53:
            real = anchor.astype(np.float64)
            found = self.real[rows] @ real if few else (self.real @ real)[rows]
            return found.astype(np.int64)
        return self.whole[rows].astype(np.int64) @ anchor.astype(np.int64)


def walk(tile: Tile, block: dict, wanted) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor, rows, scores): for each anchor of a block, the rows of the tile whose bounds reach its windows.

    `wanted(anchor, low, high)` marks them by the bounds of all rows' scores.
    """
    order, parent, edge = spanning_tree(block["vectors"])
    waiting = np.bincount(parent[parent >= 0], minlength=len(order))
    states: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for at in order:
        anchor, above = block["vectors"][at], int(parent[at])
        if above < 0:
            rows = np.arange(len(tile.ids))
            middle, reach = tile.scores(rows, anchor).astype(np.float64), np.zeros(len(rows))
            rows = np.nonzero(wanted(at, middle, middle))[0]
            scores = middle[rows].astype(np.int64) if abs(middle).max(initial=0) < 2.0**53 else tile.scores(rows, anchor)
        else:
            middle, reach = states[above]
            waiting[above] -= 1
            if not waiting[above]:
                del states[above]
            # a little more than the exact bound, for rounding
            wide = (reach + edge[at] * tile.norms) * (1 + 1e-9) + np.abs(middle) * 1e-12
            rows = np.nonzero(wanted(at, middle - wide, middle + wide))[0]
            scores = tile.scores(rows, anchor)
            middle, reach = middle.copy(), wide
            middle[rows], reach[rows] = scores, 0.0
        if waiting[at]:
            states[at] = middle, reach
        yield at, rows, scores


def first(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, of equal ones those with the smallest ids."""
    if len(rows) > k:
        some = np.nonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])[0]
    else:
        some = np.arange(len(rows))
    return some[np.lexsort((ids[rows[some]], -scores[some]))[:k]]


def nth_largest(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


def tile_positives(tile: Tile, block: dict, k: int) -> Iterator[tuple]:
    """(anchor id, ids, scores): the first k rows of an anchor's label in this tile, itself excluded."""
    ids, labels = block["ids"], block["labels"]
    kin = lambda at: (tile.labels == labels[at]) & (tile.ids != ids[at])

    def wanted(at: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        own = kin(at)
        return own & (high >= nth_largest(low[own], k))

    for at, rows, scores in walk(tile, block, wanted):
        best = first(rows, scores, tile.ids, k)
        if len(best):
            yield int(ids[at]), tile.ids[rows[best]], scores[best]


def tile_negatives(tile: Tile, block: dict, k: int, window) -> Iterator[tuple]:
    """(anchor id, positive id, ids, scores): the first k rows of other labels in the window of each positive."""
    ids, labels, positives = block["ids"], block["labels"], block["positives"]

    def wanted(at: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        other, found = tile.labels != labels[at], np.zeros(len(tile.ids), dtype=bool)
        for _, score in positives[at]:
            least, most = window(score)
            sure = other & (low >= least) & (high <= most)
            found |= other & (high >= max(least, nth_largest(low[sure], k))) & (low <= most)
        return found

    for at, rows, scores in walk(tile, block, wanted):
        for positive, score in positives[at]:
            least, most = window(score)
            inside = np.nonzero((scores >= least) & (scores <= most))[0]
            best = inside[first(rows[inside], scores[inside], tile.ids, k)]
            if len(best):
                yield int(ids[at]), positive, tile.ids[rows[best]], scores[best]


# --- on tables --------------------------------------------------------------

PACKED = "n int, part int, ids array<bigint>, labels array<bigint>, data binary"


def packed(rows: DataFrame, most: int) -> DataFrame:
    """PACKED: `rows` (id, label, v) dealt out by a hash of the id into parts of about `most` vectors."""
    counts = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    # long vectors make smaller parts; there are as many counts as lengths of vectors
    each = F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.lit(TILE_BYTES) / (4 * F.greatest("n", F.lit(1))))))
    counts = counts.select("n", F.ceil(F.col("rows") / each).cast("int").alias("parts"))
    dealt = lookup_join(rows.select("id", "label", "v", F.size("v").alias("n")), counts, "n").select(
        "n", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), "id", "label", "v"
    )

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        n, part = (k.as_py() for k in key)
        data = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<i4").tobytes()
        values = [[n], [part], [table.column("id").to_pylist()], [table.column("label").to_pylist()], [data]]
        kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        return pa.table([pa.array(v, k) for v, k in zip(values, kinds)], names=["n", "part", "ids", "labels", "data"])

    return dealt.groupBy("n", "part").applyInArrow(pack, PACKED)


def _vectors(data: bytes, rows: int, n: int) -> np.ndarray:
    return np.frombuffer(data, dtype="<i4").reshape(rows, n)


def against(tiles: DataFrame, blocks: DataFrame, found, schema: str) -> DataFrame:
    """Every tile against every block of anchors of its length, `found(tile, block)` giving rows of `schema`.

    The blocks are broadcast in passes of at most PASS_BYTES, by their measured
    size; the tiles never move.
    """
    spark = tiles.sparkSession
    names = [field.split()[0] for field in schema.split(", ")]
    kinds = [pa.list_(pa.int64()) if "array" in field else pa.int64() for field in schema.split(", ")]
    size = blocks.agg(F.sum(F.octet_length("data") + 16 * F.size("ids"))).first()[0] or 0
    passes = -(-size // PASS_BYTES) or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tile = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                ids = np.array(row["ids"], dtype=np.int64)
                if last != (row["n"], row["part"]):
                    last = row["n"], row["part"]
                    tile = Tile(ids, np.array(row["labels"], dtype=np.int64), _vectors(row["data"], len(ids), row["n"]))
                anchors = np.array(row["a_ids"], dtype=np.int64)
                block = {
                    "ids": anchors,
                    "labels": np.array(row["a_labels"], dtype=np.int64),
                    "vectors": _vectors(row["a_data"], len(anchors), row["n"]),
                }
                if "positives" in row:
                    of = {p["anchor"]: [(q["id"], q["score"]) for q in p["chosen"]] for p in row["positives"]}
                    block["positives"] = [of.get(int(a), []) for a in anchors]
                columns = list(zip(*found(tile, block))) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    parts = []
    for k in range(passes):
        some = blocks.where(F.pmod("part", F.lit(passes)) == k).select(
            "n", *[F.col(c).alias(f"a_{c}") for c in ("ids", "labels", "data")], *[c for c in blocks.columns if c == "positives"]
        )
        parts.append(cut(tiles.join(F.broadcast(some), "n").mapInArrow(run, schema)))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def best_rows(found: DataFrame, group: list[str], k: int) -> DataFrame:
    """(group, id, score, rank): the first k of the arrays `ids` and `scores` of each group."""
    order = Window.partitionBy(*group).orderBy(F.desc("score"), "id")
    rows = found.select(*group, F.inline(F.arrays_zip("ids", "scores"))).withColumnsRenamed({"ids": "id", "scores": "score"})
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def window_of(low: int, high: int):
    """The scores s with low * p <= 100 * s <= high * p, as (least, most); both exact."""
    return lambda p: (-(-low * p // 100), high * p // 100)


def hard_negatives(
    vectors: DataFrame,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
    every: int = 100,
    id: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    tile_rows: int = TILE_ROWS,
    block_anchors: int = BLOCK_ANCHORS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the anchors of `vectors`.

    Anchors are the rows whose id `every` divides.  A score is the inner product
    of the components floor(scale * x).  For each of an anchor's `positives`
    first rows of its label, the `negatives` first rows of other labels with a
    score from `low` to `high` percent of the positive's.  Equal scores go by
    the smaller id.

    Rows with a null id, label or vector or a component that is null or not
    finite take no part; rows that repeat an id are one, the least by label and
    vector; vectors of different lengths have no score; components are held to
    2^24 after scaling; a positive score of 0 or less has the window that the
    formula gives, mostly an empty one; an empty table gives an empty result;
    other columns are not looked at.
    """
    usable = vectors.where(F.col(id).isNotNull() & F.col(label).isNotNull() & finite(vector)).select(
        F.col(id).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), scaled(vector, scale).alias("v")
    )
    # copies of an id are folded before they move
    rows = cut(usable.groupBy("id").agg(F.min(F.struct("label", "v")).alias("row")).select("id", "row.label", "row.v"))
    tiles = cut(packed(rows, tile_rows))
    anchors = rows.where(F.col("id") % every == 0)
    blocks = cut(packed(anchors, block_anchors))

    near = against(tiles, blocks, lambda t, b: tile_positives(t, b, positives), "anchor bigint, ids array<bigint>, scores array<bigint>")
    chosen = cut(best_rows(near, ["anchor"], positives).select("anchor", "id", "score"))

    # the positives of a block's anchors, by their place: one row per block
    place = blocks.select("n", "part", F.explode("ids").alias("anchor"))
    of = lookup_join(chosen, place, "anchor").groupBy("n", "part", "anchor").agg(F.collect_list(F.struct("id", "score")).alias("chosen"))
    of = of.groupBy("n", "part").agg(F.collect_list(F.struct("anchor", "chosen")).alias("positives"))
    inside = window_of(low, high)
    far = against(
        tiles,
        cut(blocks.join(of, ["n", "part"])),
        lambda t, b: tile_negatives(t, b, negatives, inside),
        "anchor bigint, positive bigint, ids array<bigint>, scores array<bigint>",
    )
    mined = best_rows(far, ["anchor", "positive"], negatives)
    named = chosen.select("anchor", F.col("id").alias("positive"), F.col("score").alias("positive_score"))
    return mined.join(named, ["anchor", "positive"]).select(
        F.col("anchor").alias("anchor_id"),
        F.col("positive").alias("positive_id"),
        F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
