"""SimHash fingerprints and their near duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statewalk.llm.common import whole
from statewalk.llm.components import component_roots
from statewalk.operators.joins import fits_broadcast, lookup_join
from statewalk.sources.store import cut

BITS = 64
SEED = 42
#: A table bucket with more fingerprints than this is looked up by finer keys.
WIDE_BUCKET = 256


def simhash(text: bytes, shingle: int, seed: int = SEED) -> int:
    """64 bits, each set if it is set in over half of the shingles' hashes."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(b" ".join(words[i : i + shingle]), seed) for i in range(n)), dtype="<u8", count=n
    )
    counts = np.zeros(BITS, dtype=np.int64)
    for start in range(0, n, 65536):
        bits = np.unpackbits(hashes[start : start + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp) with fp as a bigint of the same 64 bits."""
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([simhash(t.as_py(), shingle) for t in batch.column("t")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id).alias("id"), whole(text).cast("binary").alias("t")).mapInArrow(
        run, f"id {kind}, fp bigint"
    )


# --- multi-index hashing ----------------------------------------------------


def segments(bits: tuple[int, ...], fp: str = "fp") -> list[Column]:
    """The fingerprint cut into segments of these widths, highest first."""
    found, low = [], sum(bits)
    for width in bits:
        low -= width
        found.append(F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1)))
    return found


def ball(value: Column, width: int) -> Column:
    """The value and those that have one of its zero bits set.

    Of two values one bit apart, one has the other in this list, so each such
    pair meets once.
    """
    flips = F.array(*[F.lit(1 << i) for i in range(width)])
    up = F.filter(flips, lambda m: value.bitwiseAND(m) == 0)
    return F.concat(F.array(value), F.transform(up, lambda m: value.bitwiseOR(m)))


def distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def table_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links (a, b) between fingerprints `fp`, at most `max_bits` (0, 1 or 2) bits apart.

    With two halves, a pair two bits apart has at most one bit in the first half
    or none in the second.  So the tables are: the first half, probed with a ball
    of radius one, and the second half, probed exactly.  A bucket of a table that
    holds over WIDE_BUCKET fingerprints would cost its square; there, the same
    argument is applied to the other half, whose quarters join the key.  Such a
    key fixes 48 bits, so the fingerprints on it are at most 65,536.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("the tables are laid out for at most two differing bits")
    first, second = segments((32, 32))
    exact = lambda value: F.array(value)
    layout = [(0, first, second, ball(first, 32)), (1, second, first, exact(second))]
    links = []
    for number, value, other, probes in layout:
        rows = fps.select("fp", value.alias("value"), other.alias("other"))
        probing = fps.select("fp", F.explode(probes).alias("value"), other.alias("other"))
        wide = cut(rows.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > WIDE_BUCKET).select("value"))
        if not wide.isEmpty():
            marked = wide.withColumn("wide", F.lit(True))
            fine = [
                part.join(marked, "value", "left").where("wide").drop("wide") for part in (rows, probing)
            ]
            rows, probing = (part.join(wide, "value", "left_anti") for part in (rows, probing))
            high, low = segments((16, 16), "other")
            table = F.array(F.struct(F.lit(0).alias("t"), high.alias("q")), F.struct(F.lit(1).alias("t"), low.alias("q")))
            probe = F.concat(
                F.transform(ball(high, 16), lambda q: F.struct(F.lit(0).alias("t"), q.alias("q"))),
                F.array(F.struct(F.lit(1).alias("t"), low.alias("q"))),
            )
            links.append(
                verified(
                    fine[0].select("fp", "value", F.inline(table)),
                    fine[1].select("fp", "value", F.inline(probe)),
                    ["value", "t", "q"],
                    max_bits,
                )
            )
        links.append(verified(rows.select("fp", "value"), probing.select("fp", "value"), ["value"], max_bits))
    found = links[0]
    for more in links[1:]:
        found = found.unionByName(more)
    return found.distinct()


def verified(table: DataFrame, probes: DataFrame, on: list[str], max_bits: int) -> DataFrame:
    """Table matches whose whole distance is small enough."""
    probes = probes.withColumnRenamed("fp", "probe")
    found = table.join(probes, on).where(
        (F.col("fp") != F.col("probe")) & (distance("fp", "probe") <= max_bits)
    )
    return found.select(F.least("fp", "probe").alias("a"), F.greatest("fp", "probe").alias("b"))


def simhash_groups(
    docs: DataFrame, shingle: int = 3, max_bits: int = 2, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Returns the id, fp (bigint), component (least id reachable) for each row of `docs`.

    Texts are lower-cased (A-Z) and cut at ASCII white space; a text of fewer
    words than a shingle is one shingle; one without words, null included, has
    fingerprint zero and is linked like any other.  Rows are linked if their
    fingerprints differ in at most `max_bits` bits.  Copies share a fingerprint
    and are folded into it before any link is sought.  Null ids take part, but
    never name a component unless all its ids are null.  An empty table gives
    an empty result.  Other columns are not looked at.
    """
    marked, placed = fingerprint_groups(docs, shingle, max_bits, id, text)
    named = placed.groupBy("root").agg(F.min("least").alias("component"))
    by_fp = cut(placed.join(named, "root").select("fp", "component"))
    return lookup_join(marked, by_fp, "fp").select(F.col("id").alias(id), "fp", "component")


def fingerprint_groups(docs: DataFrame, shingle: int, max_bits: int, id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(id, fp) of every row, and (fp, least, root): the least id of a fingerprint and its group."""
    marked = cut(fingerprints(docs, shingle, id, text))
    distinct = cut(marked.groupBy("fp").agg(F.min("id").alias("least")))
    roots = component_roots(table_links(distinct.select("fp"), max_bits))
    placed = distinct.join(roots.select(F.col("node").alias("fp"), "component"), "fp", "left")
    return marked, cut(placed.select("fp", "least", F.coalesce("component", "fp").alias("root")))


def first_of_groups(docs: DataFrame, shingle: int = 3, max_bits: int = 2, id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one row of each group of near duplicates: the one with the least id.

    Groups are told apart by their fingerprints, so rows that repeat an id with
    another text stand for themselves; of rows alike in id and fingerprint one
    stays, and a group without any id keeps one row.  All columns of `docs` stay.
    """
    marked, placed = fingerprint_groups(docs, shingle, max_bits, id, text)
    least = F.min(F.struct(F.col("least").isNull().alias("nameless"), "least", "fp")).alias("first")
    firsts = cut(placed.groupBy("root").agg(least).select(F.col("first.least").alias("id"), "first.fp"))
    repeated = cut(marked.where("id is not null").groupBy("id").count().where("count > 1").select("id"))
    gone = marked.where("id is not null").join(firsts, ["id", "fp"], "left_anti").select("id").unionByName(repeated).distinct()
    gone = cut(gone.withColumnRenamed("id", id))
    named = docs.where(F.col(id).isNotNull())
    chosen = named.join(F.broadcast(gone) if fits_broadcast(gone) else gone, id, "left_anti")
    if repeated.isEmpty() and marked.where("id is null").isEmpty():
        return chosen
    # an id does not tell these rows apart: their fingerprints are looked at again
    odd = docs.where(F.col(id).isNull()).unionByName(named.join(repeated.withColumnRenamed("id", id), id, "left_semi").select(*docs.columns))
    rows = odd.select(F.struct("*").alias("row"), F.col(id).alias("_id"), fingerprint(text, shingle).alias("_fp"))
    kept = rows.join(firsts, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_fp") == F.col("fp")))
    one = kept.groupBy("_id", "_fp").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return chosen.unionByName(one.select("row.*"))


def fingerprint(text: str, shingle: int) -> Column:
    """The fingerprint of the column's text as a bigint."""

    @F.arrow_udf("bigint")
    def of(texts: pa.Array) -> pa.Array:
        found = np.array([simhash(t, shingle) for t in texts.to_pylist()], dtype=np.uint64)
        return pa.array(found.view(np.int64))

    return of(whole(text).cast("binary"))
