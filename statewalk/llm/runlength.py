"""Removal of long repeated byte strings by run-length indexes.

A string of LENGTH bytes has one anchor: the least hash of a gram in it, the
leftmost if there are several.  Equal strings have equal anchors, so only
stretches of text whose anchor occurs again can hold a repeated string.  These
stretches are dealt out by anchor; each task builds the Burrows-Wheeler
transform of its stretches, keeps it as runs with samples at run ends, and
streams matching statistics: for each place, the longest match that starts
anywhere else.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statewalk.llm.common import whole
from statewalk.sources.store import cut

GRAM = 32
#: Bytes that a task indexes at once; groups of one anchor are kept together.
CHUNK_BYTES = 1 << 19
#: An anchor with more stretches than this is indexed in chunks, and the rest dealt by further anchors.
HOT_STRETCHES = 2048
FURTHER_ANCHORS = 8
#: Strings after which a stretch ends at the next place of its anchor.
STRETCH_STRINGS = 1024
SEPARATOR = 0xFF  # no byte of UTF-8

_MIX = np.uint64(0x9E3779B97F4A7C15)
_LEFT, _RIGHT, _SHIFT = np.uint64(0x100000001B3), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(29)


def gram_hashes(data: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """64-bit hash of every `length` successive bytes, by doubling."""
    if len(data) < length:
        return np.zeros(0, dtype=np.uint64)
    power = (data.astype(np.uint64) + np.uint64(seed + 1)) * _MIX
    found, done, width = None, 0, 1
    while True:
        if length & width:
            n = len(data) - done - width + 1
            found = power if found is None else _join(found[:n], power[done : done + n])
            done += width
        width *= 2
        if width > length:
            return found[: len(data) - length + 1]
        power = _join(power[: -(width // 2)], power[width // 2 :])


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    mixed = (left * _LEFT) ^ (right * _RIGHT)
    mixed ^= mixed >> _SHIFT
    return mixed * _MIX


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` successive values, from running minima in blocks."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(values)] = values
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def stretches(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, start, count, places): successive strings of `length` bytes with one anchor.

    Two equal strings have their anchor at two places, so a stretch with an
    anchor at one place holds no string twice.  A periodic text gives few long
    stretches with many places, not one stretch for each place.
    """
    if len(text) < length:
        return (np.zeros(0, dtype=np.int64),) * 4
    hashes = gram_hashes(np.frombuffer(text, dtype=np.uint8), min(GRAM, length))
    places = np.arange(len(hashes), dtype=np.uint64)
    # upper half of the hash, then the place: the leftmost of equal ones is least
    ranked = (hashes & np.uint64(0xFFFFFFFF00000000)) | places
    least = sliding_least(ranked, length - min(GRAM, length) + 1)
    starts = np.nonzero(np.concatenate([[True], least[1:] != least[:-1]]))[0]
    anchors = hashes[(least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)].view(np.int64)
    other = np.concatenate([[True], anchors[1:] != anchors[:-1]])
    begin = np.maximum.accumulate(np.where(other, starts, 0))
    piece = (starts - begin) // STRETCH_STRINGS
    first = np.nonzero(other | np.concatenate([[True], piece[1:] != piece[:-1]]))[0]
    counts = np.diff(np.append(starts[first], len(least)))
    return anchors[first], starts[first], counts, np.diff(np.append(first, len(starts)))


# --- the index --------------------------------------------------------------


class RunLengthIndex:
    """The BWT of a text as runs, with samples at run ends.

    A sample is the length of the match between a suffix and its neighbour in
    suffix order: the one before at the first row of a run, the one after at the
    last row.  Inside a run a suffix and its neighbour follow the same byte, so
    their match is that of their left neighbours less one and need not be kept.
    Order and matches are exact up to `depth` bytes.
    """

    def __init__(self, text: np.ndarray, depth: int, length: int = 8):
        self.n, self.depth, self.length = len(text), depth, length
        self.words = _packed(text)
        self.known = 8 << max(0, (length // 8).bit_length() - 1)
        order, self.ranks = _suffix_order(self.words, self.n, depth, self.known)
        # a stretch begins a run of its own, so no sample is carried over from the one before
        before = text[order - 1].astype(np.int64)
        before = np.where((order == 0) | (before == SEPARATOR), -1 - order, before)
        change = before[1:] != before[:-1]
        first = np.concatenate([[True], change])
        last = np.concatenate([change, [True]])
        above = np.concatenate([[-1], order[:-1]])
        below = np.concatenate([order[1:], [-1]])
        self.heads, self.tails = order[first], order[last]
        self.head_match = self._match(self.heads, above[first])
        self.tail_match = self._match(self.tails, below[last])

    def _match(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common bytes of the suffixes at a and b, up to about `depth`; none where b is -1."""
        found = np.zeros(len(a), dtype=np.int64)
        active = np.nonzero(b >= 0)[0]
        at = 0
        while len(active) and at < self.depth:
            x, y = a[active] + at, b[active] + at
            inside = np.maximum(x, y) < self.n
            active, x, y = active[inside], x[inside], y[inside]
            differ = self.words[x] ^ self.words[y]
            found[active] = at + np.where(differ == 0, 8, _leading_zero_bytes(differ))
            active = active[differ == 0]
            at += 8
        return found

    def matching_statistics(self) -> np.ndarray:
        """For every place the longest match that starts elsewhere, streamed left to right."""
        return np.maximum(self._stream(self.heads, self.head_match), self._stream(self.tails, self.tail_match))

    def classes(self, at: np.ndarray) -> np.ndarray:
        """Numbers of the strings of `length` bytes at these places: equal for equal strings."""
        if self.length < 8:
            keys = self.words[at] >> np.uint64(64 - 8 * self.length)
        else:  # the first and the last bytes, which overlap
            keys = self.ranks[at].astype(np.int64) * (self.n + 2) + self.ranks[at + self.length - self.known]
        return np.unique(keys, return_inverse=True)[1]

    def _stream(self, rows: np.ndarray, match: np.ndarray) -> np.ndarray:
        places = np.arange(self.n)
        sample = np.zeros(self.n, dtype=np.int64)
        known = np.full(self.n, -1, dtype=np.int64)
        sample[rows], known[rows] = match, rows
        latest = np.maximum.accumulate(known)
        return sample[latest] - (places - latest)


def _leading_zero_bytes(words: np.ndarray) -> np.ndarray:
    found = np.zeros(len(words), dtype=np.int64)
    for i in range(1, 8):
        found += words < np.uint64(1 << (64 - 8 * i))
    return found


def _suffix_order(words: np.ndarray, n: int, depth: int, ranks_at: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of their suffixes, exact up to `depth` bytes, by doubling.

    Rounds after the first only touch suffixes that are still tied.  The second
    array ranks the places by their first `ranks_at` bytes, eight times a power
    of two: equal ranks are equal bytes.
    """
    ranks = None
    small = np.int32 if n < 1 << 30 else np.int64  # half the memory to walk at random
    order = np.argsort(words[:n], kind="stable").astype(small)
    rank = np.empty(n + 1, dtype=small)
    rank[n] = -1
    tied = np.arange(n, dtype=small)
    keys = words[order]
    width = 8
    while True:
        new = np.concatenate([[True], (keys[1:] != keys[:-1])])
        group = np.maximum.accumulate(np.where(new, tied, 0))
        rank[order[tied]] = group
        more = ~new | np.concatenate([~new[1:], [False]])
        tied = tied[more]
        if ranks is None and (width >= ranks_at or not len(tied)):
            ranks = rank.copy()
        if width >= depth or not len(tied):
            return order, ranks
        places = order[tied]
        keys = rank[places].astype(np.int64) * (n + 2) + rank[np.minimum(places + width, n)] + 1
        by = np.argsort(keys, kind="stable")
        order[tied] = places[by]
        keys = keys[by]
        width *= 2


def _packed(text: np.ndarray) -> np.ndarray:
    """Eight bytes from every place on as one big-endian number, zeros past the end."""
    padded = np.concatenate([text, np.zeros(1032, dtype=np.uint8)]).astype(np.uint64)
    n = len(padded) - 8
    words = np.zeros(n, dtype=np.uint64)
    for i in range(8):
        words = (words << np.uint64(8)) | padded[i : i + n]
    return words


def index_of(parts: list[bytes], length: int) -> tuple[RunLengthIndex, list[int]]:
    """One index over stretches, and where each starts in it."""
    separator = bytes([SEPARATOR])
    text = np.frombuffer(separator.join(parts) + separator, dtype=np.uint8)
    begins = np.cumsum([0, *[len(p) + 1 for p in parts[:-1]]]).tolist()
    return RunLengthIndex(text, max(map(len, parts)) + 1, length), begins


def repeated_strings(parts: list[bytes], counts: list[int], length: int) -> list[np.ndarray]:
    """For each stretch, which of its strings of `length` bytes start anywhere else among the stretches."""
    index, begins = index_of(parts, length)
    long = index.matching_statistics() >= length
    return [long[at : at + count] for at, count in zip(begins, counts)]


def spans_of(repeated: np.ndarray, start: int, length: int) -> list[tuple[int, int]]:
    """The bytes covered by the repeated strings of a stretch, as (begin, end)."""
    at = np.nonzero(repeated)[0]
    if not len(at):
        return []
    cuts = np.nonzero(np.diff(at) > length)[0]
    firsts, lasts = at[np.concatenate([[0], cuts + 1])], at[np.concatenate([cuts, [len(at) - 1]])]
    return [(start + int(a), start + int(b) + length) for a, b in zip(firsts, lasts)]


# --- on tables --------------------------------------------------------------

def text_keys(text: Column) -> list[Column]:
    """120 bits of the MD5 of a text, as two numbers: equal texts are one."""
    digest = F.md5(text)
    return [F.conv(F.substring(digest, at, 15), 16, 10).cast("bigint").alias(k) for at, k in ((1, "k1"), (17, "k2"))]


def anchors_of(texts: DataFrame, length: int) -> DataFrame:
    """(k1, k2, anchor, start, n, m) for the stretches of every text (k1, k2, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = batch.column("k1"), batch.column("k2")
            for at, text in enumerate(batch.column("text")):
                found = stretches(text.as_py(), length)
                if len(found[0]):
                    same = pa.array(np.full(len(found[0]), at))
                    yield pa.RecordBatch.from_arrays(
                        [k1.take(same), k2.take(same), *[pa.array(x.astype(np.int64)) for x in found]],
                        ["k1", "k2", "anchor", "start", "n", "m"],
                    )

    return texts.mapInArrow(gathered(run), "k1 bigint, k2 bigint, anchor bigint, start bigint, n bigint, m bigint")


def gathered(run, rows: int = 20_000):
    """Joins the small batches that `run` gives into larger ones."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in run(batches):
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return joined


def stretch_texts(suspects: DataFrame, length: int) -> DataFrame:
    """(k1, k2, anchor, start, n, c, part): the bytes of each stretch in `suspects` (text, places)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                text = batch.column("text")[row].as_py()
                places = batch.column("places")[row].as_py()
                k1, k2 = batch.column("k1")[row].as_py(), batch.column("k2")[row].as_py()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k1] * len(places), pa.int64()),
                        pa.array([k2] * len(places), pa.int64()),
                        *[pa.array([p[name] for p in places], pa.int64()) for name in ("anchor", "start", "n", "c")],
                        pa.array([text[p["start"] : p["start"] + p["n"] - 1 + length] for p in places], pa.binary()),
                    ],
                    ["k1", "k2", "anchor", "start", "n", "c", "part"],
                )

    return suspects.mapInArrow(
        gathered(run, 2_000), "k1 bigint, k2 bigint, anchor bigint, start bigint, n bigint, c bigint, part binary"
    )


COVERED = "k1 bigint, k2 bigint, begin bigint, end bigint"
STRETCH = "anchor bigint, k1 bigint, k2 bigint, start bigint, n bigint, part binary"
#: Rows of a chunk of a hot anchor: spans, stretches of strings alone in it, one of each of the others, grams.
SPAN, ALONE, SHOWN, GRAMS = range(4)
CHUNK = f"kind int, salt int, grams array<bigint>, end bigint, {STRETCH}"


def held_parts(rows: list[tuple]) -> dict[bytes, list[tuple]]:
    """Rows (k1, k2, start, n, part) by their part: equal parts enter an index once."""
    owners: dict[bytes, list[tuple]] = {}
    for row in rows:
        owners.setdefault(row[-1], []).append(row)
    return owners


def chunk_rows(held: list[tuple], length: int) -> pa.RecordBatch:
    """COVERED for stretches (k1, k2, start, n, part) that one index takes; all strings of equal parts are repeated."""
    owners = held_parts(held)
    marks = repeated_strings(list(owners), [rows[0][3] for rows in owners.values()], length)
    spans = []
    for rows, mark in zip(owners.values(), marks):
        if len(rows) > 1:
            mark = np.ones(len(mark), dtype=bool)
        for k1, k2, start, _, _ in rows:
            spans.extend((k1, k2, a, b) for a, b in spans_of(mark, start, length))
    columns = list(zip(*spans)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["k1", "k2", "begin", "end"])


def indexed(parts: DataFrame, length: int) -> DataFrame:
    """COVERED by run-length indexes over the stretches of whole anchors, several to an index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for anchor, *row in zip(*[batch.column(c).to_pylist() for c in ("anchor", "k1", "k2", "start", "n", "part")]):
                if anchor != last and size >= CHUNK_BYTES:
                    yield chunk_rows(held, length)
                    held, size = [], 0
                last = anchor
                held.append(tuple(row))
                size += len(row[-1])
        if held:
            yield chunk_rows(held, length)

    return parts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, COVERED)


# --- anchors with too many stretches for one index --------------------------


def string_keys(data: np.ndarray, length: int, seed: int = 0, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each string of `length` bytes the hash of its least gram, of those allowed, and whether it has one."""
    hashes = gram_hashes(data, min(GRAM, length), seed)
    ranked = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    none = np.iinfo(np.uint64).max
    if allowed is not None:
        ranked = np.where(allowed, ranked, none)
    least = sliding_least(ranked, length - min(GRAM, length) + 1)
    has = least != none
    return np.where(has, hashes[np.where(has, least & np.uint64(0xFFFFFFFF), 0).astype(np.int64)], 0), has


def further(anchor: int, keys: np.ndarray, seed: int) -> np.ndarray:
    """An anchor and a further one as one number."""
    both = _join(np.full(len(keys), anchor, dtype=np.int64).view(np.uint64) + np.uint64(seed), keys)
    return both.view(np.int64)


def sub_stretches(part: bytes, start: int, chosen: np.ndarray, anchors: np.ndarray, length: int) -> Iterator[tuple]:
    """(anchor, start, n, part) for the successive chosen strings with one anchor."""
    new = np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (chosen[1:] != chosen[:-1])])
    first = np.nonzero(new)[0]
    for a, b in zip(first, np.append(first[1:], len(chosen))):
        if chosen[a]:
            yield int(anchors[a]), start + int(a), int(b - a), part[a : b - 1 + length]


def chunk_of_hot(parts: DataFrame, length: int, seed: int) -> DataFrame:
    """CHUNK: hot anchors indexed in chunks of HOT_STRETCHES stretches.

    Strings found twice in a chunk are done, and one of each goes on to meet its
    like in other chunks; strings alone in it go on as stretches, not one by one.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        anchor, salt = (k.as_py() for k in key)
        owners = held_parts(list(zip(*[table.column(c).to_pylist() for c in ("k1", "k2", "start", "n", "part")])))
        index, begins = index_of(list(owners), length)
        long = index.matching_statistics() >= length
        rows, grams, shown = [], [], []
        for (part, own), at in zip(owners.items(), begins):
            n = own[0][3]
            mark = long[at : at + n] | (len(own) > 1)
            for k1, k2, start, _, _ in own:
                rows.extend((SPAN, salt, None, b, anchor, k1, k2, a, None, None) for a, b in spans_of(mark, start, length))
            k1, k2, start, _, _ = own[0]
            alone = sub_stretches(part, start, ~mark, np.zeros(n, dtype=np.int64), length)
            rows.extend((ALONE, salt, None, None, anchor, k1, k2, a, m, piece) for _, a, m, piece in alone)
            shown.append(at + np.nonzero(mark)[0])
            hashes = gram_hashes(np.frombuffer(part, dtype=np.uint8), min(GRAM, length)).view(np.int64)
            grams.append(np.repeat(hashes, 2) if len(own) > 1 else hashes)
        # the first of each class of equal strings stands for it
        places = np.concatenate(shown)
        firsts = np.zeros(index.n, dtype=bool)
        firsts[places[np.unique(index.classes(places), return_index=True)[1]]] = True
        for (part, own), at in zip(owners.items(), begins):
            k1, k2, start, n, _ = own[0]
            chosen = firsts[at : at + n]
            if chosen.any():
                keys, _ = string_keys(np.frombuffer(part, dtype=np.uint8), length, seed)
                found = sub_stretches(part, start, chosen, further(anchor, keys, seed), length)
                rows.extend((SHOWN, salt, None, None, x, k1, k2, a, m, piece) for x, a, m, piece in found)
        values, often = np.unique(np.concatenate(grams), return_counts=True)
        rows.append((GRAMS, salt, values[often > 1].tolist(), None, anchor, None, None, None, None, None))
        return _table(rows, CHUNK)

    salts = F.ceil(F.col("c") / F.lit(HOT_STRETCHES))
    salt = F.pmod(F.xxhash64("k1", "k2", "start", F.lit(seed)), salts).cast("int").alias("salt")
    return parts.select("anchor", salt, "k1", "k2", "start", "n", "part").groupBy("anchor", "salt").applyInArrow(run, CHUNK)


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    fields = [field.split() for field in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.table([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)], names=[name for name, _ in fields])


def dealt_further(chunks: DataFrame, length: int, seed: int) -> DataFrame:
    """STRETCH for what the chunks could not settle, under further anchors; equal strings still have equal ones.

    A string with a gram that no chunk holds twice goes by the least such gram,
    which stands at most once in each chunk; that parts near copies, whose
    common grams are many.  Any other goes by the least gram of another hash,
    like the strings that stand for those found twice: these hold no such gram.
    """
    grams = chunks.where(F.col("kind") == GRAMS)
    often = grams.select("anchor", F.explode("grams").alias("gram")).groupBy("anchor").agg(F.collect_set("gram").alias("grams"))
    right = grams.select("anchor", "salt").join(often, "anchor", "left").select(*[F.col(c).alias(c) for c in ("anchor", "salt", "grams")])
    left = chunks.where(F.col("kind") == ALONE).select("anchor", "salt", "k1", "k2", "start", "n", "part")

    def run(key: tuple, alone: pa.Table, known: pa.Table) -> pa.Table:
        anchor = key[0].as_py()
        common = np.sort(np.array(known.column("grams").to_pylist()[0] or [0], dtype=np.int64))
        rows = []
        for k1, k2, start, _, part in zip(*[alone.column(c).to_pylist() for c in ("k1", "k2", "start", "n", "part")]):
            data = np.frombuffer(part, dtype=np.uint8)
            hashes = gram_hashes(data, min(GRAM, length)).view(np.int64)
            at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
            rare, has = string_keys(data, length, allowed=common[at] != hashes)
            anchors = further(anchor, rare, 0)
            if not has.all():
                anchors = np.where(has, anchors, further(anchor, string_keys(data, length, seed)[0], seed))
            rows.extend((x, k1, k2, a, m, piece) for x, a, m, piece in sub_stretches(part, start, np.ones(len(has), dtype=bool), anchors, length))
        return _table(rows, STRETCH)

    dealt = left.groupBy("anchor", "salt").cogroup(right.groupBy("anchor", "salt")).applyInArrow(run, STRETCH)
    shown = chunks.where(F.col("kind") == SHOWN).select("anchor", "k1", "k2", "start", "n", "part")
    return dealt.unionByName(shown)


def equal_strings(parts: DataFrame, length: int) -> DataFrame:
    """COVERED by comparing whole strings, one row each: for what no further anchor parts."""
    each = parts.select("k1", "k2", "start", "part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("i"))
    each = each.select("k1", "k2", (F.col("start") + F.col("i")).alias("begin"), F.expr(f"substring(part, cast(i as int) + 1, {length})").alias("bytes"))
    each = cut(each.distinct())
    again = each.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bytes")
    return each.join(again, "bytes").select("k1", "k2", "begin", (F.col("begin") + length).alias("end"))


def hot_spans(parts: DataFrame, length: int, rounds: int = FURTHER_ANCHORS) -> DataFrame:
    """COVERED for stretches (STRETCH and c, the stretches of the anchor) of hot anchors.

    Each round indexes chunks of a hot anchor and deals what is left by a further
    anchor; a group that fits one index is then indexed whole.
    """
    hot, spans = cut(parts), []
    for seed in range(1, rounds + 1):
        if hot.isEmpty():
            return reduce(DataFrame.unionByName, spans)
        chunks = cut(chunk_of_hot(hot, length, seed))
        spans.append(chunks.where(F.col("kind") == SPAN).select("k1", "k2", F.col("start").alias("begin"), "end"))
        left = cut(dealt_further(chunks, length, seed))
        counts = left.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        left = cut(left.join(counts, "anchor"))
        spans.append(cut(indexed(left.where(F.col("c") <= HOT_STRETCHES), length)))
        hot = left.where(F.col("c") > HOT_STRETCHES)
    return reduce(DataFrame.unionByName, [*spans, equal_strings(hot, length)])


def covered_spans(suspects: DataFrame, length: int, any_hot: bool) -> DataFrame:
    """COVERED for the stretches `places` of the texts in `suspects`."""

    def of(hot: bool) -> DataFrame:
        some = F.filter("places", lambda p: (p["c"] > HOT_STRETCHES) == F.lit(hot))
        return stretch_texts(suspects.withColumn("places", some).where(F.size("places") > 0), length)

    cold = indexed(of(False), length)
    return cold.unionByName(hot_spans(of(True), length)) if any_hot else cold


def removed(texts: DataFrame) -> DataFrame:
    """(k1, k2, n_removed, n_spans, kept) from the texts and their covered `spans`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, copies, spans in zip(*[batch.column(c).to_pylist() for c in ("text", "copies", "spans")]):
                spans = [(0, len(text))] if copies > 1 else sorted((s["begin"], s["end"]) for s in spans)
                merged: list[list[int]] = []
                for begin, end in spans:
                    if merged and begin <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], end)
                    else:
                        merged.append([begin, end])
                edges = [0, *[x for span in merged for x in span], len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                rows.append((len(text) - len(kept), len(merged), kept))
            n_removed, n_spans, kept = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("k1"), batch.column("k2"), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())],
                ["k1", "k2", "n_removed", "n_spans", "kept"],
            )

    return texts.mapInArrow(run, "k1 bigint, k2 bigint, n_removed bigint, n_spans bigint, kept binary")


def without_repeats(docs: DataFrame, length: int = 400, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) for each row of `docs`, and the kept bytes of changed texts.

    Every byte that lies in a string of `length` bytes which also starts
    anywhere else, in another row or the same, goes; strings are those of the
    input.  Null text is empty; shorter texts stay; of equal rows all copies go,
    if they are long enough; ids do not matter; an empty table gives an empty
    result; other columns are not looked at.  See `changed_texts` for the bytes.
    """
    keyed = docs.select(F.col(id).alias("id"), *text_keys(whole(text)), whole(text).cast("binary").alias("text"))
    found = cut(changed_texts(docs, length, text).select("k1", "k2", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha")))
    slim = keyed.select("id", "k1", "k2", F.length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("own"))
    none = F.lit(0).cast("bigint")
    return slim.join(found, ["k1", "k2"], "left").select(
        F.col("id").alias(id),
        "n_bytes",
        F.coalesce("n_removed", none).alias("n_removed"),
        F.coalesce("n_spans", none).alias("n_spans"),
        F.coalesce("sha", "own").alias("kept_sha256"),
    )


def changed_texts(docs: DataFrame, length: int = 400, text: str = "text") -> DataFrame:
    """(k1, k2, n_removed, n_spans, kept): one row per distinct text that loses bytes."""
    keyed = docs.select(*text_keys(whole(text)), whole(text).cast("binary").alias("text"))
    anchors = cut(anchors_of(keyed, length))
    again = cut(anchors.groupBy("anchor").agg(F.sum("m").alias("c")).where("c > 1"))
    # the count of its anchor comes along with each stretch and tells how it is dealt
    places = (
        anchors.join(again, "anchor")
        .groupBy("k1", "k2")
        .agg(F.collect_set(F.struct("anchor", "start", "n", "c")).alias("places"))
    )
    # copies are folded before they move; what is left of a text is one row
    texts = keyed.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"), F.max("text").alias("text"))
    suspects = cut(texts.join(places, ["k1", "k2"]))
    any_hot = not again.where(F.col("c") > HOT_STRETCHES).isEmpty()
    spans = covered_spans(suspects, length, any_hot)
    spans = spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    empty = F.array().cast("array<struct<begin:bigint,end:bigint>>")
    marked = suspects.select("k1", "k2", "copies", "text").join(spans, ["k1", "k2"], "left")
    changed = marked.where("copies > 1 or spans is not null").withColumn("spans", F.coalesce("spans", empty))
    return removed(changed)
