"""Secret scans through a trigram index over the texts.

Every rule's pattern is turned into a Boolean query over trigrams that each of
its matches must contain.  The index holds a posting list (trigram, document) for
each trigram that some query names, or for all, and is written once; the queries
are answered by intersecting lists from the rarest on, and only candidates are
searched with the pattern.  A rule whose
matches share no trigram is searched in every text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as ops
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statewalk.llm.common import fresh, row_key, running_greatest, running_starts, whole
from statewalk.operators.joins import lookup_join
from statewalk.sources.store import cut


@dataclass(frozen=True)
class Rule:
    """A secret of one kind; `min_chars` applies to `group` of the pattern."""

    kind: str
    pattern: str
    group: int = 0
    min_chars: int = 0
    base: bool = False


# fixed values: the three base rules, in the order in which ties are listed
BASE_RULES = [
    Rule(
        "assign",
        r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        group=2,
        min_chars=12,
        base=True,
    ),
    # a whole run of one class is long enough or not, so these two say their length themselves
    Rule("access", r"AKIA[A-Z0-9]{14,}", base=True),
    Rule("hex", r"[0-9a-f]{16,}", base=True),
]

# fixed values: public prefixes of well-known tokens
MORE_RULES = [
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
]

RULES = BASE_RULES + MORE_RULES

MAX_STRINGS = 64
#: Pieces of a text that are cut out of it together.
PIECES = 128


# --- Boolean trigram queries ------------------------------------------------


def _literals(node) -> set[str] | None:
    """All strings a part of a pattern can match, in lower case; None if too many."""
    op, arg = node
    if op is ops.LITERAL:
        return {chr(arg).lower()}
    if op is ops.IN:
        found = set()
        for kind, value in arg:
            if kind is ops.LITERAL:
                found.add(chr(value).lower())
            elif kind is ops.RANGE and value[1] - value[0] < MAX_STRINGS:
                found.update(chr(c).lower() for c in range(value[0], value[1] + 1))
            else:
                return None
        return found if len(found) <= MAX_STRINGS else None
    return None


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _clause(strings: set[str]) -> list[frozenset[frozenset[str]]]:
    """Clauses that hold wherever one of `strings` occurs: OR of ANDs of trigrams."""
    if not strings or any(len(s) < 3 for s in strings):
        return []
    sets = {_trigrams(s) for s in strings}
    # a set that holds another asks for more than the other and can go
    return [frozenset(s for s in sets if not any(t < s for t in sets))]


def _walk(nodes, exact: set[str], clauses: list) -> set[str]:
    """Run over the parts of a sequence with the strings that may stand before it.

    Strings grow by literals, small classes, groups and optional parts; anything
    wider ends them, and what was gathered becomes a clause.
    """
    for op, arg in nodes:
        choices = _literals((op, arg))
        if op is ops.SUBPATTERN:
            exact = _walk(arg[3], exact, clauses)
            continue
        if op is ops.BRANCH:
            choices = set()
            for branch in arg[1]:
                inner: list = []
                ends = _walk(branch, {""}, inner)
                choices = None if choices is None or inner or ends == {""} else choices | ends
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT):
            low, high, part = arg
            once = _literals(part[0]) if len(part) == 1 else None
            if high == 1 and once is not None:
                choices = once | {""}
            elif once is not None and len(once) == 1 and low == high and low <= 16:
                choices = {next(iter(once)) * low}
        elif op is ops.AT:
            continue
        if choices is None or len(exact) * len(choices) > MAX_STRINGS:
            clauses.extend(_clause(exact))
            exact = {""}
        else:
            exact = {a + b for a, b in product(exact, choices)}
    return exact


def trigram_query(pattern: str) -> list[frozenset[frozenset[str]]]:
    """AND of clauses; a clause is an OR of sets of trigrams that occur together.

    Trigrams are in lower case, for an index over lower-cased texts.  An empty
    list means that no trigram is mandatory.
    """
    clauses: list = []
    clauses.extend(_clause(_walk(parser.parse(pattern), {""}, clauses)))
    return list(dict.fromkeys(clauses))


def answers(query, has) -> Column:
    """The query as a condition; `has` tells whether a trigram has a posting."""

    def both(a, b):
        return a & b

    def either(a, b):
        return a | b

    return reduce(
        both,
        [reduce(either, [reduce(both, [has(t) for t in sorted(s)]) for s in clause]) for clause in query],
    )


def trigrams_of(queries: dict[str, list]) -> list[str]:
    """All trigrams that the queries name."""
    return sorted({t for q in queries.values() for clause in q for s in clause for t in s})


def postings(docs: DataFrame, key: Column, text: str, trigrams: list[str] | None = None) -> DataFrame:
    """The inverted index: (trigram, key), one row per trigram that a lower-cased text holds.

    Only for the trigrams asked for, or for all there are.  Rows are sorted by
    trigram in each task, so in a written index each file holds every posting
    list in one piece, and a reader that names trigrams skips the others.
    """
    lowered = docs.select(key.alias("key"), F.lower(whole(text)).alias("text"))
    if trigrams is None:
        split = lowered.select("key", F.split("text", "").alias("chars"))
        last = F.size("chars") - 3
        every = F.transform(F.sequence(F.lit(0), last), lambda i: F.concat(*[F.get("chars", i + j) for j in range(3)]))
        held = split.select("key", F.explode_outer(F.when(last >= 0, F.array_distinct(every))).alias("trigram"))
        held = held.where("trigram is not null")
    else:
        names = F.array(*[F.lit(t) for t in trigrams])
        held = lowered.select("key", F.explode(F.filter(names, lambda t: F.contains(F.col("text"), t))).alias("trigram"))
    return held.select("trigram", "key").sortWithinPartitions("trigram")


def write_postings(
    docs: DataFrame,
    location: str,
    rules: list[Rule] | None = None,
    id: str = "doc_id",
    text: str = "text",
) -> None:
    """Keep the index of `docs` at `location`, for any scans of the same rows later.

    With `rules` it holds the trigrams of their queries and serves those rules
    only; without, it holds every trigram and serves all.  Null texts have no
    trigrams; equal rows share their postings; an empty table gives an empty index.
    """
    named = None if rules is None else trigrams_of({r.kind: trigram_query(r.pattern) for r in rules})
    postings(docs, row_key(id, text), text, named).write.parquet(location)


def rarest(query: list, sizes: dict[str, int]) -> set[str]:
    """The shortest posting lists that together hold every document that answers `query`.

    One list, the shortest, of each set of the clause for which these are fewest rows.
    """
    starts = [{min(sorted(s), key=lambda t: sizes.get(t, 0)) for s in clause} for clause in query]
    return min(starts, key=lambda ts: sum(sizes.get(t, 0) for t in ts))


def candidates(index: DataFrame, queries: dict[str, list]) -> DataFrame:
    """(key, kinds): documents whose postings answer the query of some kind.

    The intersection begins with the rarest lists; of the longer ones only the
    postings of documents in those move on.  The postings of a document are
    joined to a set before the shuffle; it holds no more than the trigrams of the
    queries.  The driver learns the lengths of the lists that the queries name.
    """
    lists = index.where(F.col("trigram").isin(trigrams_of(queries)))
    sizes = {r["trigram"]: r["n"] for r in lists.groupBy("trigram").agg(F.count(F.lit(1)).alias("n")).collect()}
    first = sorted(set().union(*[rarest(q, sizes) for q in queries.values()]))
    begun = cut(lists.where(F.col("trigram").isin(first)).select("key").distinct())
    held = lookup_join(lists, begun, "key").groupBy("key").agg(F.collect_set("trigram").alias("held"))
    kinds = [
        F.when(answers(q, lambda t: F.array_contains("held", t)), F.lit(kind)) for kind, q in queries.items()
    ]
    return held.select("key", F.array_compact(F.array(*kinds)).alias("kinds")).where(F.size("kinds") > 0)


# --- verification -----------------------------------------------------------


def matches(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, order, kind, end>>: leftmost matches that do not overlap.

    Spark has no function for positions, but the pieces between the matches and
    the matches alternate, so their lengths give them.
    """
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    part = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    gaps = F.split(text, rule.pattern, -1)
    steps = F.zip_with(
        F.slice(gaps, 1, F.size(found)), found, lambda gap, hit: F.length(gap) + F.length(hit)
    )
    spans = F.transform(
        F.arrays_zip(running_starts(steps).alias("at"), F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("hit"), part.alias("part")),
        lambda x: F.struct(
            (x["at"] + F.length(x["gap"])).alias("start"),
            F.lit(order).alias("order"),
            F.lit(rule.kind).alias("kind"),
            (x["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("end"),
            F.length(x["part"]).alias("chars"),
        ),
    )
    long_enough = F.filter(spans, lambda s: s["chars"] >= rule.min_chars)
    return F.transform(long_enough, lambda s: s.dropFields("chars"))


SPANS = "array<struct<start:bigint,order:int,kind:string,end:bigint>>"


def scan_secrets(
    docs: DataFrame,
    rules: list[Rule] | None = None,
    id: str = "doc_id",
    text: str = "text",
    name: str = "spans",
    index: DataFrame | None = None,
) -> DataFrame:
    """All columns of `docs` and `spans`, or as `name` says: array of (start, order, kind, end).

    Spans are places in code points from 0, end exclusive, sorted by start and
    then by the order of the rules.  Null and empty texts have none; equal rows
    get equal spans; null ids do no harm; an empty table gives an empty result.
    A column of `docs` of that name is replaced.  `index` is one that
    `write_postings` kept of the same rows; else one is written for this scan.
    """
    rules = RULES if rules is None else rules
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    rows = docs.select(F.struct(*kept).alias("row"), whole(text).alias("text"), row_key(id, text).alias("key"))
    if queries:
        if index is None:
            index = cut(postings(docs, row_key(id, text), text, trigrams_of(queries)))
        rows = lookup_join(rows, cut(candidates(index, queries)), "key", "left")
    none = F.array().cast(SPANS)
    found = []
    for order, rule in enumerate(rules):
        spans = matches(F.col("text"), rule, order).cast(SPANS)
        if rule.kind in queries:
            spans = F.when(F.array_contains("kinds", rule.kind), spans)
        found.append(F.coalesce(spans, none))
    return rows.select("row.*", F.array_sort(F.concat(*found)).alias(name))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def redact_secrets(
    docs: DataFrame, mark: str = "[SECRET]", id: str = "doc_id", text: str = "text", **options
) -> DataFrame:
    """`docs` with every span replaced by `mark`; overlapping spans become one.

    Texts without a span stay as they are, null included.  All columns stay, one
    named `spans` too; repeated rows are treated alike; an empty table gives an
    empty result.
    """
    columns, name, before = docs.columns, fresh(docs, "spans"), fresh(docs, "pieces")
    scanned = scan_secrets(docs, id=id, text=text, name=name, **options)
    # a piece of text lies before each span that begins behind all earlier ones, and one at the end
    ends = F.transform(name, lambda s: s["end"])
    spans = scanned.withColumn(before, running_greatest(ends))
    opens = F.filter(
        F.zip_with(
            name,
            before,
            lambda s, b: F.struct(F.greatest(b, F.lit(0)).alias("begin"), s["start"].alias("end"), (s["start"] > b).alias("opens")),
        ),
        lambda p: p["opens"],
    )
    spans = spans.withColumn(before, opens)

    def part(whole_text: Column, begin: Column, end: Column) -> Column:
        return F.substring(whole_text, (begin + 1).cast("int"), (end - begin).cast("int"))

    # a block of pieces is cut out of the text first, since `substring` walks there from the front
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(before) - 1) / PIECES).cast("int")),
        lambda b: F.slice(before, b * PIECES + 1, PIECES),
    )
    pieces = F.flatten(
        F.transform(
            F.transform(
                blocks,
                lambda ps: F.struct(
                    ps.alias("ps"), part(F.col(text), F.get(ps, 0)["begin"], F.element_at(ps, -1)["end"]).alias("text")
                ),
            ),
            lambda b: F.transform(
                b["ps"], lambda p: part(b["text"], p["begin"] - F.get(b["ps"], 0)["begin"], p["end"] - F.get(b["ps"], 0)["begin"])
            ),
        )
    )
    length = F.length(text).cast("bigint")
    pieces = F.concat(pieces, F.array(part(F.col(text), F.array_max(ends), length)))
    clean = F.when(F.size(name) > 0, F.array_join(pieces, mark)).otherwise(F.col(text))
    return spans.select(*[clean.alias(c) if c == text else F.col(c) for c in columns])
