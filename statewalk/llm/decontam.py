"""Benchmark decontamination by winnowing.

Of the hashes of successive k-word grams, the least in each sliding window is
kept as a fingerprint.  Two texts that share WINDOW successive words share all
hashes in there, hence the least one: with k + window - 1 = WINDOW every shared
span of that length is found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statewalk.llm.common import lower_ascii, row_key, whole
from statewalk.operators.joins import fits_broadcast, lookup_join
from statewalk.sources.store import cut

# fixed value: words are runs of 0-9, a-z and everything beyond ASCII
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# the same runs in a text that still has its capitals
ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
NOTHING = "array<bigint>"


def words_of(text: str) -> Column:
    return F.regexp_extract_all(lower_ascii(whole(text)), F.lit(WORDS), F.lit(0))


def word_count(text: str) -> Column:
    """The number of `words_of`, for which no letter has to be replaced."""
    return F.size(F.regexp_extract_all(whole(text), F.lit(ANY_CASE), F.lit(0))).cast("bigint")


def run_of(array: str, at: Column, n: int) -> list[Column]:
    """`n` successive entries; `slice` within a lambda would copy the whole array each time."""
    return [F.get(array, at + j) for j in range(n)]


def gram_hashes(words: str, k: int) -> Column:
    """Hash of every k successive words of the column `words`; empty if there are fewer."""
    last = F.size(words) - k
    grams = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.xxhash64(F.lit(k), *run_of(words, i, k)),
    )
    return F.when(last >= 0, grams).otherwise(F.array().cast(NOTHING))


def least_in_windows(hashes: str, window: int) -> Column:
    """The least hash of each `window` successive ones."""
    last = F.size(hashes) - window
    least = F.transform(F.sequence(F.lit(0), last), lambda i: F.least(*run_of(hashes, i, window)))
    return F.when(last >= 0, least).otherwise(F.array().cast(NOTHING))


def with_fingerprints(rows: DataFrame, size: int, k: int, short: list[int]) -> DataFrame:
    """Adds `least` (by window start) and `fps`, the distinct fingerprints of `words`.

    Items shorter than a window cannot be winnowed: for each such length, every
    gram of that length is a fingerprint.
    """
    rows = rows.withColumn("grams", gram_hashes("words", k)).withColumn(
        "least", least_in_windows("grams", size - k + 1)
    )
    whole_grams = [gram_hashes("words", n) for n in short]
    return rows.drop("grams").withColumn("fps", F.array_distinct(F.concat(F.col("least"), *whole_grams)))


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """(item, words): every window of every item; a shorter item is one window."""
    last = F.size("words") - size
    windows = F.when(
        last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.array(*run_of("words", i, size)))
    ).when(F.size("words") > 0, F.array("words"))
    windows = items.select("item", F.explode_outer(windows).alias("words"))
    return windows.where("words is not null").distinct()


def document_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = 10,
    k: int = 5,
    id: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """What the benchmark hits: (key, start, n_words, window) and (window, item)."""
    items = benchmark.select(
        F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), words_of(item_text).alias("words")
    )
    windows = cut(
        item_windows(items, size).select(
            "item", "words", F.size("words").alias("n"), F.array_join("words", " ").alias("window")
        )
    )
    short = sorted(r.n for r in windows.where(F.col("n") < size).select("n").distinct().collect())
    distinct = cut(windows.select("window", "words").distinct())
    # a whole window has one least hash, a short item its own gram
    known = cut(with_fingerprints(distinct, size, k, short).select(F.explode("fps").alias("fp")).distinct())
    small = fits_broadcast(known)

    keyed = docs.select(row_key(id, text).alias("key"), F.col(text).alias("text"))
    found = with_fingerprints(keyed.select("key", words_of("text").alias("words")), size, k, short)
    # the outer forms keep Spark from testing for empty arrays below, where it would compute them again
    exploded = found.select("key", F.explode_outer("fps").alias("fp"))
    shared = exploded.join(F.broadcast(known) if small else known, "fp", "left_semi")
    shared = cut(shared.groupBy("key").agg(F.collect_set("fp").alias("shared")))

    # a hit is extended to the windows it is the least hash of, and these are compared as texts
    near = with_fingerprints(
        lookup_join(keyed, shared, "key").select("key", "shared", words_of("text").alias("words")), size, k, []
    )
    starts = F.transform(
        F.filter(
            F.transform("least", lambda h, i: F.struct(i.alias("start"), h.alias("h"))),
            lambda s: F.array_contains("shared", s["h"]),
        ),
        lambda s: F.struct(s["start"].alias("start"), F.lit(size).alias("n")),
    )
    for n in short:
        every = F.transform(gram_hashes("words", n), lambda h, i: F.struct(i.alias("start"), h.alias("h")))
        starts = F.concat(
            starts,
            F.transform(
                F.filter(every, lambda s: F.array_contains("shared", s["h"])),
                lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("n")),
            ),
        )

    def window_text(start: Column, n: Column) -> Column:
        return F.concat_ws(" ", *[F.when(n > j, word) for j, word in enumerate(run_of("words", start, size))])

    texts = F.transform(
        starts,
        lambda s: F.struct(
            s["start"].alias("start"),
            s["n"].alias("n_words"),
            window_text(s["start"], s["n"]).alias("window"),
        ),
    )
    spans = near.select("key", F.inline_outer(texts)).where("window is not null").distinct()
    known_texts = distinct.select("window")
    hits = cut(spans.join(F.broadcast(known_texts) if fits_broadcast(known_texts) else known_texts, "window", "left_semi"))
    return hits, windows.select("window", "item").distinct()


def contamination(
    docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", **options
) -> DataFrame:
    """The id, n_words, n_hit, n_items, items (sorted texts) for each row of `docs`.

    A window is `size` successive words of an item, or a whole shorter item that
    has words; a document word is hit if it lies in an occurrence of a window,
    and an item is listed if one of its windows occurs.  Null and empty texts
    have no words and no hits; items without words hit nothing; a null item id
    is listed as the empty text; equal rows get equal results; other columns are
    not looked at; an empty table on either side gives no hits.
    """
    hits, owners = document_hits(docs, benchmark, id=id, text=text, **options)
    # the spans of one document, no more than its words times the window lengths
    covered = F.aggregate(
        F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("n_words")).alias("end")))),
        F.struct(F.lit(0).alias("upto"), F.lit(0).cast("bigint").alias("n")),
        lambda a, s: F.struct(
            F.greatest(a["upto"], s["end"]).alias("upto"),
            (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["upto"], s["start"]))).alias("n"),
        ),
    )["n"]
    n_hit = hits.groupBy("key").agg(covered.alias("n_hit"))
    small = fits_broadcast(owners)
    pairs = hits.select("key", "window").distinct().join(F.broadcast(owners) if small else owners, "window")
    named = pairs.groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    per_key = cut(n_hit.join(named, "key"))
    rows = docs.select(
        F.col(id).alias("id"),
        row_key(id, text).alias("key"),
        word_count(text).alias("n_words"),
    )
    none = F.array().cast("array<string>")
    return lookup_join(rows, per_key, "key", "left").select(
        F.col("id").alias(id),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("bigint").alias("n_items"),
        F.coalesce("items", none).alias("items"),
    )


def without_contaminated(
    docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", **options
) -> DataFrame:
    """The rows of `docs` in which no benchmark window occurs; all columns stay."""
    hits, _ = document_hits(docs, benchmark, id=id, text=text, **options)
    keys = cut(hits.select("key").distinct().withColumn("hit", F.lit(True)))
    rows = docs.select(F.struct("*").alias("row"), row_key(id, text).alias("key"))
    return lookup_join(rows, keys, "key", "left").where("hit is null").select("row.*")
