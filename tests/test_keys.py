from itertools import permutations

from plain import fold
from pyspark.sql import functions as F

from statewalk.functions.algebra import STATE_FIELDS
from statewalk.functions.keys import canonical
from statewalk.operators.keyed import class_sizes, key_states


def test_canonical_classes(spark):
    texts = [("".join(map(str, p)),) for p in permutations(range(8))]
    rows = spark.createDataFrame(texts, "corners string")
    sizes = class_sizes(rows, "corners").collect()
    assert len(sizes) == 2520
    assert {r["n_keys"] for r in sizes} == {16}
    again = rows.select(canonical(F.col("corners")).alias("c")).distinct()
    assert again.where(canonical(F.col("c")) != F.col("c")).count() == 0


def test_canonical_null(spark):
    rows = spark.createDataFrame([(None,), ("41203567",)], "c string")
    got = [r[0] for r in rows.select(canonical(F.col("c"))).collect()]
    assert got[0] is None
    # 0-3 appear as 1,2,0,3: 0 is third, so they become 0,3,1,2; 4 is first already
    assert got[1] == "40312567"


def test_schemes(spark):
    state, _ = fold("L2 d U F2 U F2 D B f D f l B2 f R2 F2 r F D2 l U L R2 f D2 F d".split())
    rows = spark.createDataFrame(
        [(*state["pos"].values(), *state["ori"].values())],
        ", ".join(f"{f} array<int>" for f in STATE_FIELDS),
    )
    key = {s: key_states(rows, s).first()["state"] for s in ("digits", "flags", "buckets", "hex")}
    edges = state["pos"]["edge"]
    assert state["pos"]["corner"] == [0, 1, 5, 7, 2, 4, 3, 6]
    assert key["digits"] == "010001010100"
    assert key["flags"] == "10112211" + "".join(str(int(e >= 8)) for e in edges)
    assert key["buckets"][8:] == "".join(str(e // 4) for e in edges)
    assert key["hex"] == "01572436" + "".join(f"{e:X}" for e in edges)
