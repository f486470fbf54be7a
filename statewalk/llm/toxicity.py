"""Toxicity by weak supervision.

Many voters look at a text: word lists, patterns, and lists mined from one half
of the sample that vote on the other half.  A generative model of their votes,
a hidden class and a tree of dependencies among the voters, estimates how
accurate each is and which go together.  Its posterior labels train a linear
classifier over words and beginnings of words, which scores every document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statewalk.llm.common import whole
from statewalk.llm.quality import training_sample
from statewalk.sources.store import cut

#: Lengths of the beginnings of words that are terms beside whole words.
PREFIXES = range(3, 9)
#: Characters of a text that are cut into words at once.
PIECE_CHARS = 1 << 20
#: Terms that a task holds before it hands its counts on, and words it remembers while scoring.
HELD_TERMS = 200_000
#: Terms of each mined list and half, by their z-score, and what makes one strong.
LIST_TERMS, STRONG, WEAK = 1000, 8.0, 3.0

_WORD = re.compile(r"[^\W\d_]+")

# fixed values: word lists of the voters
LEXICONS = {
    "stupidity": "idiot idiots moron morons stupid dumb imbecile fool fools clown clowns",
    "contempt": "pathetic worthless disgusting scum trash loser losers garbage vermin filth filthy",
    "profanity": "fuck fucking shit bullshit bitch bastard asshole crap damn",
    "violence": "kill murder destroy hang shoot beat burn",
    "german": "idiot dummkopf arschloch scheiße abschaum wertlos dreck versager",
    "french": "idiot imbécile connard salaud merde ordure crétin débile",
    "spanish": "idiota imbécil estúpido basura mierda cabrón asqueroso inútil",
}

# fixed values: patterns of the voters, searched in the lower-cased text unless they name capitals
PATTERNS = {
    "addressed": r"\byou(?: are|'re)? (?:an? |such an? |all )?(?:\w+ )?(?:idiots?|morons?|losers?|clowns?|scum|trash|stupid|pathetic)\b",
    "dismissal": r"\b(?:shut up|go away|get lost|hate you|go to hell)\b",
    "shouting": r"(?:\b[A-Z]{3,}\b\W+){4}",
    "exclamation": r"!!!|\?!",
    "masked": r"\b[a-z]+[*@#$]{2,}[a-z]*",
}


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """A whole text in pieces of about `size` characters, cut before white space."""
    at = 0
    while at < len(text):
        end = len(text) if len(text) - at <= size else text.find(" ", at + size)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def word_counts(text: str) -> Counter:
    found: Counter = Counter()
    for piece in pieces(text):
        found.update(_WORD.findall(piece.lower()))
    return found


def terms_of(word: str) -> list[str]:
    """The word itself and its beginnings."""
    return [word + "$", *["^" + word[:k] for k in PREFIXES if len(word) > k]]


def term_counts(words: Counter) -> Counter:
    found: Counter = Counter()
    for word, n in words.items():
        for term in terms_of(word):
            found[term] += n
    return found


def kind_of(term: str) -> str:
    """The mined list that a term belongs to, but for its strength."""
    if term[-1] == "$":
        return "words"
    return "short" if len(term) <= 5 else "middle" if len(term) <= 7 else "long"


MINED = [f"{kind}_{strength}" for kind in ("words", "short", "middle", "long") for strength in ("strong", "weak")]
VOTERS = ["marked", *LEXICONS, *PATTERNS, *MINED]


def fixed_votes() -> Callable[[str, Counter], list[bool]]:
    """The votes of the word lists and patterns on a text and its words."""
    lists = [frozenset(words.split()) for words in LEXICONS.values()]
    compiled = [(re.compile(p), "[A-Z]" in p) for p in PATTERNS.values()]

    def vote(text: str, words: Counter) -> list[bool]:
        lower = text.lower()
        return [
            *[not words.keys().isdisjoint(some) for some in lists],
            *[p.search(text if capitals else lower) is not None for p, capitals in compiled],
        ]

    return vote


# --- the label model --------------------------------------------------------


@dataclass(frozen=True)
class LabelModel:
    """What the votes say: `fires` by class and voter, `parent` and `given` of the tree, `prior` of class 1.

    fires[c, j] is the chance that voter j fires in class c; given[c, a, j] the
    same where its parent's vote is a; correlation[j] that of j and its parent
    within the classes.
    """

    prior: float
    fires: np.ndarray
    parent: np.ndarray
    given: np.ndarray
    correlation: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Chance of class 1 for each row of votes."""
        above = np.where(self.parent >= 0, votes[:, self.parent], 0)
        each = np.arange(votes.shape[1])
        logs = []
        for c, share in enumerate((1 - self.prior, self.prior)):
            p = self.given[c, above, each]
            logs.append(np.log(share) + np.log(np.where(votes == 1, p, 1 - p)).sum(axis=1))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def estimate(votes: np.ndarray, weight: np.ndarray, smooth: float = 0.5, trust: float = 0.0) -> LabelModel:
    """The model that fits `votes` (0 or 1) if row i is of class 1 with chance weight[i].

    Voter 0, the given label, stands beside the tree of the others: within a
    class its mistakes have nothing to do with their votes.  `trust` is how many
    rows' worth the belief is that it is right.
    """
    n, m = votes.shape
    x = votes.astype(np.float64)
    fires, given = np.zeros((2, m)), np.zeros((2, 2, m))
    both, totals = np.zeros((2, m, m)), np.zeros(2)
    for c, w in enumerate((1 - weight, weight)):
        both[c], totals[c] = (x * w[:, None]).T @ x, w.sum()
        fires[c] = (np.diag(both[c]) + smooth) / (totals[c] + 2 * smooth)
        fires[c, 0] = (both[c, 0, 0] + smooth + trust * (0.002, 0.99)[c]) / (totals[c] + 2 * smooth + trust)
    information = np.zeros((m, m))
    for c in range(2):
        one = np.diag(both[c])
        cells = [both[c], one[:, None] - both[c], one[None, :] - both[c], totals[c] - one[:, None] - one[None, :] + both[c]]
        p, q = fires[c][:, None], fires[c][None, :]
        alone = [p * q, p * (1 - q), (1 - p) * q, (1 - p) * (1 - q)]
        for cell, free in zip(cells, alone):
            share = np.maximum(cell, 0) / max(totals[c], 1e-9)
            information += totals[c] / n * np.where(share > 0, share * np.log(np.maximum(share, 1e-300) / free), 0)
    # the tree that keeps the most information between voters within the classes
    parent, best, link = np.full(m, -1), np.full(m, -np.inf), np.full(m, -1)
    inside = np.arange(m) == 0
    at = 1
    for _ in range(m - 1):
        inside[at] = True
        parent[at] = link[at]
        better = ~inside & (information[at] > best)
        best[better], link[better] = information[at][better], at
        at = int(np.argmax(np.where(inside, -np.inf, best)))
    correlation = np.zeros(m)
    for c in range(2):
        one = np.diag(both[c])
        for j in range(m):
            k = parent[j]
            if k < 0:
                given[c, :, j] = fires[c, j]
                continue
            fired = both[c][k, j]
            given[c, 1, j] = (fired + smooth * fires[c, j]) / (one[k] + smooth)
            given[c, 0, j] = (one[j] - fired + smooth * fires[c, j]) / (totals[c] - one[k] + smooth)
            spread = fires[c, j] * (1 - fires[c, j]) * fires[c, k] * (1 - fires[c, k])
            correlation[j] += totals[c] / n * (fired / max(totals[c], 1e-9) - fires[c, j] * fires[c, k]) / np.sqrt(spread)
    given = np.clip(given, 1e-4, 1 - 1e-4)
    return LabelModel(float(np.clip(weight.mean(), 1e-3, 1 - 1e-3)), fires, parent, given, correlation)


def telling(votes: np.ndarray, weight: np.ndarray, ratio: float = 3.0, least: int = 3) -> np.ndarray:
    """Which voters to hear: voter 0 and those that fire often enough and far more in one class."""
    fires = estimate(votes, weight).fires
    far = np.maximum(fires[0] / fires[1], fires[1] / fires[0]) >= ratio
    far &= votes.sum(axis=0) >= least
    far[0] = True
    return np.nonzero(far)[0]


def fit_label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 25, trust: float = 0.0) -> tuple[LabelModel, np.ndarray]:
    """Expectation and maximisation in turn, from the chances `start`; the model and its posteriors."""
    weight = start.astype(np.float64)
    for _ in range(rounds):
        model = estimate(votes, weight, trust=trust)
        new = model.posterior(votes)
        if np.abs(new - weight).max(initial=0) < 1e-6:
            break
        weight = new
    return model, new


# --- the linear classifier --------------------------------------------------


@dataclass(frozen=True)
class Toxicity:
    """Weights of terms; a text scores by log(1 + count) of each."""

    terms: dict[str, float]
    start: float
    voters: tuple[str, ...] = ()
    model: LabelModel | None = None

    def scorer(self) -> Callable[[str], float]:
        known: dict[str, list[str]] = {}

        def score(text: str) -> float:
            hits: Counter = Counter()
            if len(known) > HELD_TERMS:
                known.clear()
            for word, n in word_counts(text).items():
                found = known.get(word)
                if found is None:
                    found = known[word] = [t for t in terms_of(word) if t in self.terms]
                for term in found:
                    hits[term] += n
            total = self.start + sum(self.terms[t] * np.log1p(n) for t, n in sorted(hits.items()))
            return float(1 / (1 + np.exp(-np.clip(total, -700, 700))))

        return score


def fit_linear(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, target: np.ndarray, n_columns: int, ridge: float = 1.0, rounds: int = 300):
    """Logistic weights for sparse rows and soft labels, by adaptive gradient steps."""
    mean = float(np.clip(target.mean(), 1e-3, 1 - 1e-3))
    weights, start = np.zeros(n_columns), float(np.log(mean / (1 - mean)))
    seen, seen_start = np.full(n_columns, 1e-8), 1e-8
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(start + np.bincount(rows, values * weights[columns], len(target)))))
        off = p - target
        slope = np.bincount(columns, values * off[rows], n_columns) + ridge * weights
        seen += slope**2
        seen_start += off.sum() ** 2
        weights -= 0.5 * slope / np.sqrt(seen)
        start -= 0.5 * off.sum() / np.sqrt(seen_start)
    return weights, start


# --- on tables --------------------------------------------------------------


def term_statistics(sample: DataFrame, weight: dict[str, float] | None = None) -> DataFrame:
    """(half, term, toxic, clean): documents of the sample with each term, by half, or all as half 0 by `weight`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[float]] = {}

        def out():
            keys = list(held)
            columns = [[k[0] for k in keys], [k[1] for k in keys], [held[k][0] for k in keys], [held[k][1] for k in keys]]
            kinds = [pa.int32(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["half", "term", "toxic", "clean"])

        for batch in batches:
            for id, half, label, text in zip(*[batch.column(c).to_pylist() for c in ("id", "half", "label", "text")]):
                share = float(label) if weight is None else weight[id]
                for term in term_counts(word_counts(text)):
                    entry = held.setdefault((half if weight is None else 0, term), [0.0, 0.0])
                    entry[0] += share
                    entry[1] += 1.0 - share
                if len(held) >= HELD_TERMS:
                    yield out()
                    held.clear()
        yield out()

    counted = sample.mapInArrow(run, "half int, term string, toxic double, clean double")
    return counted.groupBy("half", "term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def with_scores(stats: DataFrame, totals: DataFrame) -> DataFrame:
    """`stats` with z, how many deviations a term stands out in the toxic documents of its half."""
    share = (F.col("toxic") + F.col("clean")) / (F.col("n_toxic") + F.col("n_clean"))
    spread = share * (1 - share) * (1 / F.col("n_toxic") + 1 / F.col("n_clean")) + 1e-9
    z = (F.col("toxic") / F.col("n_toxic") - F.col("clean") / F.col("n_clean")) / F.sqrt(spread)
    return stats.join(F.broadcast(totals), "half").where("toxic >= 1.5 and n_clean > 0").withColumn("z", z)


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    limit: int = 10_000,
    vocabulary: int = 2048,
    id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
) -> Toxicity:
    """Learns from a sample of at most `limit` labelled documents, whole texts.

    Counts and votes are computed on the executors; the driver gets `limit` rows
    of votes, at most 2 x 8 x 1000 terms of mined lists, `vocabulary` terms and
    the sample's counts of those, whatever the size of the corpus.  The given
    label is one voter among the others.  Rows without an id or label teach
    nothing; of repeated labels of an id the largest holds.  Without labelled
    rows, or with one label only, every score is the same.
    """
    spark = docs.sparkSession
    sample = cut(
        training_sample(docs, labels, limit, id, text, label).select(
            F.col("id").cast("string").alias("id"), F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(2)).cast("int").alias("half"),
            F.least(F.greatest(F.col("label").cast("double"), F.lit(0.0)), F.lit(1.0)).alias("label"), F.col("text").cast("string").alias("text"),
        )
    )
    totals = sample.groupBy("half").agg(F.sum("label").alias("n_toxic"), F.sum(1 - F.col("label")).alias("n_clean"))
    marks = sample.agg(F.count("label"), F.sum("label")).first()
    n, toxic = marks[0], marks[1] or 0.0
    if not 0 < toxic < n:
        mean = (toxic + 0.5) / (n + 1.0)
        return Toxicity({}, float(np.log(mean / (1 - mean))))

    # lists mined in one half vote on the other
    strength = F.when(F.col("z") >= STRONG, "strong").otherwise("weak")
    size = F.length("term")
    kind = F.when(F.col("term").endswith("$"), "words").when(size <= 5, "short").when(size <= 7, "middle").otherwise("long")
    scored = with_scores(term_statistics(sample), totals.where("n_toxic > 0")).where(F.col("z") >= WEAK)
    scored = cut(scored.select("half", F.concat_ws("_", kind, strength).alias("voter"), "term", "z"))
    mined: dict[tuple, set] = {}
    for half in (0, 1):
        for voter in MINED:
            best = scored.where((F.col("half") == half) & (F.col("voter") == voter)).orderBy(F.desc("z"), "term").limit(LIST_TERMS)
            mined[half, voter] = {r["term"] for r in best.select("term").collect()}

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixed = fixed_votes()
        for batch in batches:
            rows = []
            for half, mark, content in zip(*[batch.column(c).to_pylist() for c in ("half", "label", "text")]):
                words = word_counts(content)
                terms = term_counts(words).keys()
                said = [not terms.isdisjoint(mined[1 - half, voter]) for voter in MINED]
                rows.append([int(mark >= 0.5), *map(int, fixed(content, words)), *map(int, said)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, pa.list_(pa.int8()))], ["id", "votes"])

    got = sorted(sample.mapInArrow(votes, "id string, votes array<tinyint>").collect(), key=lambda r: r["id"])
    table = np.array([r["votes"] for r in got], dtype=np.int64)
    chances = np.where(table[:, 0] == 1, 0.99, 0.01)
    heard = telling(table, chances)
    model, posterior = fit_label_model(table[:, heard], chances, trust=len(table) / 4)
    weight = {r["id"]: float(p) for r, p in zip(got, posterior)}

    both = spark.range(1).select(
        F.lit(0).alias("half"), F.lit(float(posterior.sum())).alias("n_toxic"), F.lit(float((1 - posterior).sum())).alias("n_clean")
    )
    known = with_scores(term_statistics(sample, weight), both).where(F.col("z") >= WEAK)
    terms = [r["term"] for r in known.orderBy(F.desc("z"), "term").limit(vocabulary).collect()]
    place = {term: i for i, term in enumerate(terms)}

    def design(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{place[t]: n for t, n in term_counts(word_counts(x)).items() if t in place} for x in batch.column("text").to_pylist()]
            columns = [batch.column("id"), pa.array([list(r) for r in rows], pa.list_(pa.int16())), pa.array([list(r.values()) for r in rows], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "at", "n"])

    design_rows = sorted(sample.mapInArrow(design, "id string, at array<smallint>, n array<int>").collect(), key=lambda r: r["id"])
    counts = [len(r["at"]) for r in design_rows]
    rows = np.repeat(np.arange(len(design_rows)), counts)
    columns = np.array([c for r in design_rows for c in r["at"]], dtype=np.int64)
    values = np.log1p(np.array([c for r in design_rows for c in r["n"]], dtype=np.float64))
    target = np.array([weight[r["id"]] for r in design_rows])
    weights, start = fit_linear(rows, columns, values, target, len(terms))
    return Toxicity({t: float(w) for t, w in zip(terms, weights) if w}, float(start), tuple(VOTERS[j] for j in heard), model)


def toxicity_score(text: str, classifier: Toxicity) -> Column:
    """Probability that the text of the column is toxic; null counts as empty."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        of = classifier.scorer()
        return pa.array([of(t or "") for t in texts.to_pylist()], pa.float64())

    return score(whole(text))


def classify_toxicity(docs: DataFrame, classifier: Toxicity, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """All columns of `docs` with `score` (0 to 1) and `predicted` (1 from `threshold` on).

    Only the text counts; null is scored as the empty text.  Equal texts get
    equal scores; columns of `docs` with those two names are replaced; an empty
    table gives an empty result.
    """
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    scored = docs.select(*kept).withColumn("score", toxicity_score(text, classifier))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
