"""The four stages: token sets, seeds, successor rules and their path tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statewalk.functions.algebra import TOKENS
from statewalk.functions.keys import canonical
from statewalk.functions.successors import OrbitKeys, PackedKeys
from statewalk.operators.search import bfs_states
from statewalk.sources.fixed import STAGE_BARRED, STAGE_DEPTH, STAGE_SEEDS
from statewalk.sources.store import path_texts, publish, published, shared_folder

LAYOUTS = {
    1: [("edge", "ori")],
    2: [("corner", "ori"), ("edge", "pos")],
    3: [("corner", "pos"), ("edge", "pos")],
    4: [("corner", "pos"), ("edge", "pos")],
}


def stage_tokens(number: int) -> list[str]:
    return [t for t in TOKENS if t not in STAGE_BARRED[number]]


#: All four fit a bigint: digits of one bit, digits of three and two bits, and places within orbits.
KEYS = {
    1: PackedKeys(LAYOUTS[1]),
    2: PackedKeys(LAYOUTS[2]),
    3: PackedKeys(LAYOUTS[3], {"corner": 3, "edge": 2}),
    4: OrbitKeys(LAYOUTS[4], stage_tokens(4)),
}
_EDGE_BITS = 24


def _next_canonical(rows: DataFrame) -> DataFrame:
    """Stage 3 keeps one representative per class of corner arrangements."""
    rows = KEYS[3].successor(rows)
    corners = F.lpad(F.conv(F.shiftright("state", _EDGE_BITS).cast("string"), 10, 8), 8, "0")
    rows = rows.withColumn("_corners", corners)
    chosen = F.shiftleft(F.conv(canonical(F.col("_corners")), 8, 10).cast("bigint"), _EDGE_BITS)
    edges = F.col("state").bitwiseAND(F.lit((1 << _EDGE_BITS) - 1))
    return rows.withColumn("state", chosen.bitwiseOR(edges)).drop("_corners")


def build_stage(spark: SparkSession, number: int, max_depth: int | None = None) -> DataFrame:
    """state, distance, path of one stage, searched from its seeds."""
    keys = KEYS[number]
    seeds = spark.createDataFrame(
        [(keys.pack(text),) for text in STAGE_SEEDS[number]], f"state {keys.type}"
    )
    found = bfs_states(
        seeds,
        keys,
        stage_tokens(number),
        STAGE_DEPTH[number] if max_depth is None else max_depth,
        next_state=_next_canonical if number == 3 else None,
    )
    return found.withColumn("state", keys.text(F.col("state")))


_locations: dict[tuple[str, int], str] = {}


def stage_table(spark: SparkSession, number: int, location: str | None = None) -> DataFrame:
    """Stored path table of a stage: state, path_text.

    Built where nothing is published at `location` yet, and read back after
    that; a table that is torn or of another stage is refused.  Without a
    location it is kept in the shared folder for the session.  The four tables
    hold 2,048 / 1,082,565 / 176,400 / 663,552 rows whatever the data.
    """
    place = (spark.sparkContext.applicationId, number)
    if location is None:
        location = _locations.setdefault(place, f"{shared_folder(spark).rstrip('/')}/stage{number}-{uuid.uuid4().hex}")
    content = f"paths of stage {number} by {' '.join(stage_tokens(number))}"
    found = published(spark, location, content)
    return publish(path_texts(build_stage(spark, number)), location, content) if found is None else found
