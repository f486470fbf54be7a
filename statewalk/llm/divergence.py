"""Divergence of sources: single-pass in-memory indexing of terms.

Each task reads its documents once and gathers postings, term by term for each
language and source, until a block is full; the block is spilled as a run in
the order of terms, cut into hash shards of the terms.  The runs of a shard are
merged by a heap into frequencies.  Shares of two sources are compared from a
base that holds for terms which neither has, and terms that one of them has
stream by as corrections.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, groupby, repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statewalk.llm.common import whole
from statewalk.operators.joins import lookup_join
from statewalk.sources.store import cut

#: Bytes of text whose postings a task holds before it spills them as a run; a longer text makes a block alone.
BLOCK_BYTES = 16 << 20
#: Bytes of text for each hash shard of the terms.
SHARD_BYTES = 16 << 20
#: Runs that one merge takes; more are merged in several rounds.
FAN_IN = 512
#: Bytes of a text that are cut into terms at once.
PIECE_BYTES = 1 << 20
#: Rows that a task takes out of a batch at once.
SLICE_ROWS = 500
#: Kept terms whose corrections one task sums, and sources on each side of its sums.
CHUNK_TERMS, SOURCE_BLOCK = 10_000, 512
SCALE = 1_000_000_000

#: A-Z to lower case; every ASCII byte that is no letter ends a term and becomes zero.
_TO_TERMS = np.array([b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0 for b in range(256)], dtype=np.uint8)
_WEIGHTS = np.random.default_rng(13).integers(1, 1 << 62, 64, dtype=np.uint64) | np.uint64(1)

#: A row is a slice of a run: terms in order, the documents of each, and in `ends` where its
#: postings (place in `names`, n) end.
RUNS = (
    "shard int, run bigint, lang string, terms array<binary>, docs array<bigint>, ends array<bigint>, "
    "names array<string>, sources array<bigint>, n array<bigint>"
)
TERMS = "lang string, term binary, total bigint, docs bigint, sources array<string>, n array<bigint>"
_LISTS = {"terms": pa.binary(), "docs": pa.int64(), "ends": pa.int64(), "names": pa.string(), "sources": pa.int64(), "n": pa.int64()}


# --- building runs ----------------------------------------------------------


def cut_terms(data: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of texts that lie end to end in `data` from `starts` on, and the text of each."""
    clean = _TO_TERMS[data]
    inside = clean != 0
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    begun = starts[starts < len(data)]
    opens[begun] = inside[begun]
    first = np.nonzero(opens)[0]
    kept = clean[inside]
    offsets = np.append(np.cumsum(inside)[first] - 1, len(kept)).astype(np.int32) if len(first) else np.zeros(1, dtype=np.int32)
    terms = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
    return terms, np.searchsorted(starts, first, side="right") - 1


def cut_texts(texts: list[bytes], piece: int = PIECE_BYTES) -> tuple[pa.ChunkedArray, np.ndarray]:
    """The terms of whole texts and the text of each, some bytes at a time; long texts are cut between terms."""
    terms, owners, held, ids, size = [], [], [], [], 0

    def take():
        nonlocal held, ids, size
        starts = np.cumsum([0, *map(len, held[:-1])]) if held else np.zeros(0, dtype=np.int64)
        found, owner = cut_terms(np.frombuffer(b"".join(held), dtype=np.uint8), starts)
        terms.append(found)
        owners.append(np.array(ids, dtype=np.int32)[owner])
        held, ids, size = [], [], 0

    for i, text in enumerate(texts):
        at = 0
        while len(text) - at > piece:
            end = text.find(b" ", at + piece)
            if end < 0:
                break
            held.append(text[at:end])
            ids.append(i)
            take()
            at = end
        held.append(text[at:] if at else text)
        ids.append(i)
        size += len(held[-1])
        if size >= piece:
            take()
    take()
    return pa.chunked_array(terms, pa.binary()), np.concatenate(owners)


def term_shards(terms: pa.Array, shards: int) -> np.ndarray:
    """The hash shard of each term: the same in every run."""
    offsets = np.frombuffer(terms.buffers()[1], dtype=np.int32)[terms.offset : terms.offset + len(terms) + 1].astype(np.int64)
    data = np.frombuffer(terms.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64)
    starts = offsets[:-1] - offsets[0]
    place = np.arange(len(data)) - np.repeat(starts, np.diff(offsets))
    mixed = np.add.reduceat(data * _WEIGHTS[place & 63], starts)
    mixed ^= mixed >> np.uint64(31)
    return ((mixed * _WEIGHTS[0] >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)


def runs_of(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts in a sorted array."""
    return np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0] if len(keys) else np.zeros(0, dtype=np.int64)


def run_batch(rows: list[dict]) -> pa.RecordBatch:
    """RUNS for slices given as dicts of arrays."""
    columns = [pa.array([r["shard"] for r in rows], pa.int32()), pa.array([r["run"] for r in rows], pa.int64()), pa.array([r["lang"] for r in rows], pa.string())]
    for name, kind in _LISTS.items():
        parts = [pa.array(r[name], kind) for r in rows]
        offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
        columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.concat_arrays(parts) if parts else pa.array([], kind)))
    return pa.RecordBatch.from_arrays(columns, ["shard", "run", "lang", *_LISTS])


def spilled(texts: list[bytes], groups: list[tuple[str, str]], shards: int, run: int) -> pa.RecordBatch | None:
    """The postings of a block of texts, each of a group (lang, source), as one run in the order of terms."""
    cut_up, owner = cut_texts(texts)
    if not len(cut_up):
        return None
    encoded = cut_up.dictionary_encode().unify_dictionaries()
    del cut_up
    terms, codes = encoded.chunk(0).dictionary, np.concatenate([c.indices.to_numpy() for c in encoded.chunks])
    del encoded
    shard = term_shards(terms, shards)
    ranks = np.empty(len(terms), dtype=np.int64)
    ranks[pc.array_sort_indices(terms).to_numpy()] = np.arange(len(terms))
    order = np.lexsort((ranks, shard))
    place = np.empty(len(terms), dtype=np.int64)
    place[order] = np.arange(len(terms))

    # how often each document has each term, then each group; what is done with goes, as there is one row per term of the block
    pairs = owner.astype(np.int64)
    pairs *= len(terms)
    pairs += place[codes]
    del owner, codes
    pairs.sort()
    first = runs_of(pairs)
    often = np.diff(np.append(first, len(pairs)))
    pairs = pairs[first]
    doc = pairs // len(terms)
    pairs -= doc * len(terms)
    langs = sorted({lang for lang, _ in groups})
    names = sorted({source for _, source in groups})
    lang_of = np.array([langs.index(lang) for lang, _ in groups])
    known = {name: i for i, name in enumerate(names)}
    source_of = np.array([known[source] for _, source in groups])
    keys = lang_of[doc]
    keys *= len(terms)
    keys += pairs
    keys *= len(names)
    keys += source_of[doc]
    del pairs, doc, first
    by = np.argsort(keys, kind="stable")
    keys, often = keys[by], often[by]
    del by
    first = runs_of(keys)
    n, docs = np.add.reduceat(often, first), np.diff(np.append(first, len(keys)))
    term_keys, source = np.divmod(keys[first], len(names))
    first = runs_of(term_keys)
    ends, seen = np.append(first[1:], len(term_keys)), np.add.reduceat(docs, first)
    lang, term = np.divmod(term_keys[first], len(terms))

    rows = []
    sliced = np.append(runs_of(lang * shards + shard[order[term]]), len(term))
    for a, b in zip(sliced[:-1], sliced[1:]):
        low, high = first[a], ends[b - 1]
        used, codes = np.unique(source[low:high], return_inverse=True)
        rows.append(
            {
                "shard": int(shard[order[term[a]]]), "run": run, "lang": langs[lang[a]],
                "terms": terms.take(pa.array(order[term[a:b]])), "docs": seen[a:b], "ends": ends[a:b] - low,
                "names": [names[i] for i in used], "sources": codes, "n": n[low:high],
            }
        )
    return run_batch(rows)


def index_runs(docs: DataFrame, shards: int, block: int = BLOCK_BYTES) -> DataFrame:
    """Sorted runs of the postings of `docs` (lang, source, text), one for each full block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, groups, size, number = [], [], 0, TaskContext.get().partitionId() << 24
        for part in (batch.slice(at, SLICE_ROWS) for batch in batches for at in range(0, batch.num_rows, SLICE_ROWS)):
            for lang, source, text in zip(*[part.column(c).to_pylist() for c in ("lang", "source", "text")]):
                texts.append(text)
                groups.append((lang, source))
                size += len(text)
                if size >= block:
                    found = spilled(texts, groups, shards, number)
                    texts, groups, size, number = [], [], 0, number + 1
                    pa.default_memory_pool().release_unused()
                    if found is not None:
                        yield found
        if texts and (found := spilled(texts, groups, shards, number)) is not None:
            yield found

    return docs.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(run, RUNS)


# --- merging runs -----------------------------------------------------------


def merged(slices: list[dict], least: int) -> dict:
    """Sorted slices of one language and shard merged by a heap; only terms in `least` documents or more stay.

    Returned in the form of a slice.
    """
    heads = [zip(s["terms"], s["docs"], repeat(r), count()) for r, s in enumerate(slices)]
    terms, docs, run, at, number = [], [], [], [], []
    for term, same in groupby(heapq.merge(*heads), key=itemgetter(0)):
        same = list(same)
        seen = sum(e[1] for e in same)
        if seen >= least:
            for _, _, r, i in same:
                run.append(r)
                at.append(i)
                number.append(len(terms))
            terms.append(term)
            docs.append(seen)
    names = sorted({name for s in slices for name in s["names"]})
    known = {name: i for i, name in enumerate(names)}
    source = np.concatenate([np.array([known[x] for x in s["names"]], dtype=np.int64)[s["sources"]] for s in slices])
    n = np.concatenate([s["n"] for s in slices])
    base = np.cumsum([0, *[len(s["terms"]) for s in slices]])
    shift = np.cumsum([0, *[len(s["n"]) for s in slices]])
    ends = np.concatenate([s["ends"] + shift[r] for r, s in enumerate(slices)])
    # the postings of all kept entries, entry by entry
    entry = base[np.array(run, dtype=np.int64)] + np.array(at, dtype=np.int64)
    begins = np.append(0, ends)[entry]
    lengths = ends[entry] - begins
    which = np.repeat(begins - np.append(0, np.cumsum(lengths)[:-1]) if len(lengths) else begins, lengths) + np.arange(lengths.sum())
    keys = np.repeat(np.array(number, dtype=np.int64), lengths) * max(len(names), 1) + source[which]
    by = np.argsort(keys, kind="stable")
    keys, n = keys[by], n[which][by]
    first = runs_of(keys)
    owner, source = np.divmod(keys[first], max(len(names), 1))
    n = np.add.reduceat(n, first) if len(first) else n
    return {
        "terms": terms, "docs": docs, "ends": np.searchsorted(owner, np.arange(len(terms)), side="right"),
        "names": names, "sources": source, "n": n,
    }


def _slices(table: pa.Table) -> dict[str, list[dict]]:
    """By language, the slices of a shard: terms, documents and names as lists, the others as arrays."""
    columns = {}
    for name in _LISTS:
        lists = table.column(name).combine_chunks()
        values = lists.flatten()
        edges = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
        columns[name] = edges, values if name in ("terms", "docs", "names") else values.to_numpy(zero_copy_only=False)
    found = defaultdict(list)
    for i, lang in enumerate(table.column("lang").to_pylist()):
        part = {name: values[edges[i] : edges[i + 1]] for name, (edges, values) in columns.items()}
        found[lang].append({name: x.to_pylist() if isinstance(x, pa.Array) else x for name, x in part.items()})
    return found


def merge_round(runs: DataFrame, parts: int) -> DataFrame:
    """Runs of each shard merged into one run for each of `parts` parts of the runs."""

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        shard, part = (k.as_py() for k in key)
        return pa.Table.from_batches([run_batch([merged(own, 0) | {"shard": shard, "run": part, "lang": lang} for lang, own in _slices(table).items()])])

    dealt = runs.withColumn("part", F.pmod(F.xxhash64("run"), F.lit(parts)))
    return dealt.groupBy("shard", "part").applyInArrow(merge, RUNS)


def term_frequencies(docs: DataFrame, min_docs: int, block: int = BLOCK_BYTES, fan_in: int = FAN_IN) -> DataFrame:
    """TERMS: the terms in at least `min_docs` documents of a language, with their count in each source.

    `docs` has lang, source and text without nulls.  A term is in one shard, so
    its documents are known where its runs are merged.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    runs = cut(index_runs(docs, -(-size // SHARD_BYTES) or 1, block))
    n_runs = runs.select("run").distinct().count()
    while n_runs > fan_in:
        parts = -(-n_runs // fan_in)
        runs = cut(merge_round(runs, parts))
        n_runs = parts

    def merge(table: pa.Table) -> pa.Table:
        rows = []
        for lang, own in _slices(table).items():
            kept = merged(own, min_docs)
            begin = 0
            for term, seen, end in zip(kept["terms"], kept["docs"], kept["ends"].tolist()):
                n = kept["n"][begin:end]
                rows.append((lang, term, int(n.sum()), seen, [kept["names"][i] for i in kept["sources"][begin:end]], n.tolist()))
                begin = end
        kinds = [pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64())]
        columns = list(zip(*rows)) or [()] * 6
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "term", "total", "docs", "sources", "n"])

    return runs.groupBy("shard").applyInArrow(merge, TERMS)


# --- exact shares and distances ---------------------------------------------


def share(count: str, below: str) -> Column:
    """1 + floor(SCALE * count / below), by long division in steps of a thousand so that nothing overflows."""
    left, out = f"({count}) % ({below})", f"1 + {SCALE} * (({count}) div ({below}))"
    for unit in (1_000_000, 1_000, 1):
        out = f"{out} + {unit} * ((({left}) * 1000) div ({below}))"
        left = f"(({left}) * 1000) % ({below})"
    return F.expr(out)


def distance(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def shares(count: np.ndarray, below: np.ndarray) -> np.ndarray:
    """`share` on arrays."""
    out, left = 1 + SCALE * (count // below), count % below
    for unit in (1_000_000, 1_000, 1):
        left = left * 1000
        out = out + unit * (left // below)
        left = left % below
    return out


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def corrections(counts: np.ndarray, below: np.ndarray, own: np.ndarray, others: np.ndarray):
    """Sums for sources `own` against `others` over terms with `counts` (terms x sources).

    The first has every term of the source itself, the second those that the
    other lacks: with the second of the other way round, each term that either
    has counts once.  Both are what such a term adds beyond one neither has.
    """
    p = shares(counts + 2, below)
    zero = shares(np.full(len(below), 2), below)
    every, lacking = np.zeros((2, len(own), len(others)), dtype=np.int64)
    for i, g in enumerate(own):
        rows = np.nonzero(counts[:, g])[0]
        more = distances(p[rows, g][:, None], p[rows][:, others]) - distances(zero[g], zero[others])
        every[i] = more.sum(axis=0)
        lacking[i] = np.where(counts[rows][:, others] == 0, more, 0).sum(axis=0)
    return every, lacking


def pair_corrections(terms: DataFrame, groups: DataFrame, chunk: int = CHUNK_TERMS, block: int = SOURCE_BLOCK) -> DataFrame:
    """(lang, source, item, more): what the terms of either source add to the base of the pair.

    `groups` has lang, source, below and v, the number of kept terms of the
    language.  A task takes one chunk of the terms of a language against one
    block of sources on each side.
    """
    langs = groups.groupBy("lang").agg(
        F.ceil(F.max("v") / chunk).cast("int").alias("chunks"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")
    )
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    langs = langs.where("chunks > 0")
    again = langs.select(*[F.col(c).alias(c) for c in langs.columns])  # columns of its own for the other side
    on = ["lang", "chunk", "own", "other"]
    dealt = (
        lookup_join(terms.select("lang", "term", "sources", "n"), langs, "lang")
        .select("lang", "sources", "n", "blocks", F.pmod(F.xxhash64("term"), "chunks").cast("int").alias("chunk"))
        .withColumn("own", upto("blocks"))
        .withColumn("other", upto("blocks"))
    )
    sides = (
        lookup_join(groups.select(*[F.col(c).alias(c) for c in ("lang", "source", "below")]), again, "lang")
        .withColumn("block", F.pmod(F.xxhash64("source"), "blocks").cast("int"))
        .withColumn("chunk", upto("chunks"))
        .withColumn("own", upto("blocks"))
        .withColumn("other", upto("blocks"))
        .where("block = own or block = other")
    )

    def compare(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        lang, _, own, other = (k.as_py() for k in key)
        names = right.column("source").to_pylist()
        below = right.column("below").to_numpy()
        in_block = right.column("block").to_numpy()
        place = {name: i for i, name in enumerate(names)}
        counts = np.zeros((left.num_rows, len(names)), dtype=np.int64)
        for row, (sources, n) in enumerate(zip(left.column("sources").to_pylist(), left.column("n").to_pylist())):
            for source, k in zip(sources, n):
                if source in place:
                    counts[row, place[source]] = k
        first, second = np.nonzero(in_block == own)[0], np.nonzero(in_block == other)[0]
        every, lacking = corrections(counts, below, first, second)
        g, h = np.repeat(first, len(second)), np.tile(second, len(first))
        apart = g != h
        g, h = g[apart], h[apart]
        name = lambda at: pa.array([names[i] for i in at], pa.string())
        return pa.table(
            {
                "lang": pa.array([lang] * (2 * len(g)), pa.string()),
                "source": pa.concat_arrays([name(g), name(h)]),
                "item": pa.concat_arrays([name(h), name(g)]),
                "more": pa.array(np.concatenate([every.ravel()[apart], lacking.ravel()[apart]])),
            }
        )

    sums = dealt.groupBy(*on).cogroup(sides.groupBy(*on)).applyInArrow(compare, "lang string, source string, item string, more bigint")
    return sums.groupBy("lang", "source", "item").agg(F.sum("more").alias("more"))


def ranked(rows: DataFrame, limit: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rows = rows.withColumn("rank", F.row_number().over(order))
    return rows if limit is None else rows.where(F.col("rank") <= limit)


def source_divergence(
    docs: DataFrame,
    min_docs: int = 10,
    top: int = 10,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    block: int = BLOCK_BYTES,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """(lang, source, part, item, value, rank): how the sources of each language differ in their terms.

    Part `pair` has every other source of the language with the summed distance
    of their shares of the kept terms, largest first; part `term` the `top` kept
    terms that a source uses more than its language, by that distance.

    Null text, language or source is empty; an empty text makes its group occur
    without terms; repeated rows count as often as they stand there; equal
    values rank by item in the order of UTF-8 bytes; a language without kept
    terms has pairs of value 0; an empty table gives an empty result; other
    columns are not looked at.
    """
    named = docs.select(whole(lang).alias("lang"), whole(source).alias("source"), whole(text).alias("text"))
    terms = cut(term_frequencies(named, min_docs, block, fan_in))
    none = F.lit(0).cast("bigint")
    postings = terms.select("lang", "term", "total", F.inline(F.arrays_zip("sources", "n"))).withColumnRenamed("sources", "source")
    used = postings.groupBy("lang", "source").agg(F.sum("n").alias("used"))
    langs = cut(terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), (F.sum("total") + 2 * F.count(F.lit(1))).alias("lang_below")))
    groups = (
        named.select("lang", "source").distinct().join(used, ["lang", "source"], "left").join(langs, "lang", "left")
        .select("lang", "source", F.coalesce("v", none).alias("v"), "lang_below",
                (F.coalesce("used", none) + 2 * F.coalesce("v", none)).alias("below"))
    )
    groups = cut(groups)

    own = lookup_join(postings, groups, ["lang", "source"])
    own = own.withColumn("p", share("n + 2", "below")).withColumn("q", share("total + 2", "lang_below")).where("p > q")
    by_term = ranked(own.select("lang", "source", F.col("term").cast("string").alias("item"), distance("p", "q").alias("value")), top)

    # a share of 0 only stands where no term is kept and no distance is taken
    empty = groups.select("lang", "source", "v", F.when(F.col("v") > 0, share("2", "below")).otherwise(0).alias("p"))
    others = empty.select("lang", F.col("source").alias("item"), F.col("p").alias("q"))
    more = pair_corrections(terms, groups)
    pairs = (
        empty.join(others, "lang").where("source <> item").join(more, ["lang", "source", "item"], "left")
        .withColumn("value", F.when(F.col("v") > 0, F.col("v") * distance("p", "q")).otherwise(none) + F.coalesce("more", none))
    )
    by_pair = ranked(pairs.select("lang", "source", "item", "value"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return (
        by_pair.withColumn("part", F.lit("pair")).select(*columns)
        .unionByName(by_term.withColumn("part", F.lit("term")).select(*columns))
    )
