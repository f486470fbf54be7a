"""Quality classifier: boosted trees over statistics of a document's text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statewalk.llm.common import whole
from statewalk.llm.trees import Forest, fit

FEATURES = [
    "log_bytes",
    "log_words",
    "word_bytes",
    "upper",
    "lower",
    "digits",
    "space",
    "newlines",
    "beyond_ascii",
    "stops",
    "commas",
    "symbols",
    "marks",
    "brackets",
    "words_with_symbol",
    "words_upper",
    "distinct_words",
    "top_word",
    "distinct_pairs",
    "top_pair",
    "lines_repeated",
    "line_bytes",
    "short_words",
    "long_words",
    "stop_words",
    "vowels",
    "distinct_bytes",
    "entropy",
    "distinct_in_blocks",
]

# fixed values: very frequent short words of the four languages
STOP_WORDS = frozenset(
    "the of and to in is it that for on with as was are be this by at or from "
    "le la les de des un une et en du que qui dans est pour par sur au avec "
    "der die das und ist von zu mit dem den ein eine auf für im nicht sich als "
    "el los las y del se por con para su al lo como más".encode().split()
)

_CLASS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digits": b"0123456789",
    "space": b" \t\r\n\x0b\x0c",
    "newlines": b"\n",
    "stops": b".!?",
    "commas": b",;:",
    "symbols": b"#$%&*@^~|\\=+<>/_",
    "marks": b"!?",
    "brackets": b"()[]{}\"'",
    "vowels": b"aeiouAEIOU",
}
_MEMBERS = np.zeros((256, len(_CLASS)))
for _i, _bytes in enumerate(_CLASS.values()):
    _MEMBERS[list(_bytes), _i] = 1.0
_SYMBOLS = bytes(_CLASS["symbols"])
_NO_SYMBOLS = bytes.maketrans(_SYMBOLS, b"#" * len(_SYMBOLS))


def statistics(text: bytes) -> list[float]:
    """The features of one whole text, in the order of FEATURES."""
    n = len(text)
    words = text.split()
    n_words = len(words)
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256).astype(float)
    shares = counts / max(n, 1)
    of = dict(zip(_CLASS, shares @ _MEMBERS))
    seen = shares[shares > 0]
    each = max(n_words, 1)
    tally = Counter(words)
    pairs = Counter(zip(words, words[1:]))
    lines = [line for line in text.split(b"\n") if line.strip()]
    n_lines = max(len(lines), 1)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=n_words)
    marked = text.translate(_NO_SYMBOLS).split()
    return [
        np.log1p(n),
        np.log1p(n_words),
        sizes.mean() if n_words else 0.0,
        of["upper"],
        of["lower"],
        of["digits"],
        of["space"],
        of["newlines"],
        shares[128:].sum(),
        of["stops"],
        of["commas"],
        of["symbols"],
        of["marks"],
        of["brackets"],
        sum(b"#" in w for w in marked) / each,
        sum(map(bytes.isupper, words)) / each,
        len(tally) / each,
        max(tally.values(), default=0) / each,
        len(pairs) / each,
        max(pairs.values(), default=0) / each,
        1.0 - len(set(lines)) / n_lines if lines else 0.0,
        n / n_lines,
        float((sizes <= 2).sum()) / each,
        float((sizes >= 12).sum()) / each,
        sum(tally[w] for w in STOP_WORDS if w in tally) / each,
        of["vowels"],
        float(len(seen)),
        float(-(seen * np.log(seen)).sum()) if n else 0.0,
        distinct_in_blocks(words),
    ]


def distinct_in_blocks(words: list[bytes], block: int = 200) -> float:
    """The mean share of distinct words over all blocks of successive words, which length does not bear on."""
    shares = [len(set(part)) / len(part) for at in range(0, len(words), block) if (part := words[at : at + block])]
    return sum(shares) / max(len(shares), 1)


def feature_rows(texts) -> np.ndarray:
    found = [statistics(t or b"") for t in texts]
    return np.array(found, dtype=np.float64).reshape(len(found), len(FEATURES))


def training_sample(docs: DataFrame, labels: DataFrame, limit: int, id: str, text: str, label: str) -> DataFrame:
    """At most `limit` labelled rows (text, label), first in the order of a hash of the id."""
    chosen = (
        labels.where(F.col(id).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(id).alias("id"))
        .agg(F.max(label).alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(limit)
    )
    texts = docs.select(F.col(id).alias("id"), whole(text).cast("binary").alias("text"))
    # one text per id, so that a repeated id does not bring more rows than the limit
    return texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    limit: int = 20_000,
    id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    **options,
) -> Forest:
    """Learns the label from a sample of at most `limit` labelled documents.

    The statistics of the sample are computed on the executors; the driver gets
    `limit` rows of numbers, about 5 MB by default, whatever the size of the
    corpus.  Rows without an id or label teach nothing; of repeated labels of an
    id the largest holds.  Without labelled rows, or with one label only, every
    score is the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = feature_rows(t.as_py() for t in batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").cast(pa.string()), batch.column("label").cast(pa.float64()), pa.array(list(rows), pa.list_(pa.float64()))],
                ["id", "label", "x"],
            )

    sample = training_sample(docs, labels, limit, id, text, label).mapInArrow(run, "id string, label double, x array<double>")
    got = sorted(sample.collect(), key=lambda r: r["id"])
    if not got:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    return fit(np.array([r["x"] for r in got]), np.array([r["label"] for r in got]), **options)


def quality_score(text: str, forest: Forest) -> Column:
    """Probability that the text of the column is good; null counts as empty."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(forest.score(feature_rows(t.as_py() for t in texts)))

    return score(whole(text).cast("binary"))


def classify_quality(
    docs: DataFrame, forest: Forest, threshold: float = 0.3, text: str = "text", score: str = "score", predicted: str = "predicted"
) -> DataFrame:
    """All columns of `docs` with `score` (0 to 1) and `predicted` (1 from `threshold` on), or as they are named.

    Only the text counts; null is scored as the empty text.  Equal texts get
    equal scores; columns of `docs` with those two names are replaced; an empty
    table gives an empty result.
    """
    kept = [c for c in docs.columns if c.lower() not in (score.lower(), predicted.lower())]
    scored = docs.select(*kept).withColumn(score, quality_score(text, forest))
    return scored.withColumn(predicted, (F.col(score) >= threshold).cast("int"))
