"""Toxicity, hard negatives and source divergence against plain Python."""

import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from statewalk.llm.catalog import QUERIES
from statewalk.llm.divergence import cut_texts, source_divergence, spilled
from statewalk.llm.hardneg import hard_negatives, spanning_tree
from statewalk.llm.toxicity import classify_toxicity, estimate, fit_label_model, fit_toxicity, pieces

PLACE = "/root/testdata/sf0.1"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- source divergence ------------------------------------------------------


def divergence(rows, min_docs, top=10):
    """{(lang, source, part, item): (value, rank)} for rows (text, lang, source)."""
    seen, counts, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        sources[lang].add(source)
        seen[lang].update(set(words))
        counts[lang, source].update(words)
    out = {}
    for lang, own in sources.items():
        kept = [t for t, n in seen[lang].items() if n >= min_docs]
        v = len(kept)

        def shares(count):
            below = sum(count[t] for t in kept) + 2 * v
            return {t: 1 + 1_000_000_000 * (count[t] + 2) // below for t in kept}

        p = {s: shares(counts[lang, s]) for s in own}
        q = shares(sum((counts[lang, s] for s in own), Counter()))
        far = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pairs = [(-sum(far(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in own if o != s]
            terms = [(-far(p[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                for rank, (value, _, item) in enumerate(found, 1):
                    out[lang, s, part, item] = (-value, rank)
    return out


def test_a_block_is_indexed_in_little_memory():
    rng = random.Random(3)
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}x" for i in range(5000)]
    texts = [" ".join(rng.choices(words, k=300)).encode() for _ in range(2000)]
    tracemalloc.start()
    try:
        spilled(texts, [(f"l{i % 2}", f"s{i % 5}") for i in range(2000)], 4, 0)
        assert tracemalloc.get_traced_memory()[1] < 20 * sum(map(len, texts))
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("block,fan_in", [(1 << 24, 512), (120, 2)])
def test_divergence(spark, block, fan_in):
    rng = random.Random(8)
    words = ["Alpha", "beta", "été", "漢字", "ÉTÉ", "x1y", "don't", "zz", "a"]
    rows = [
        (" ".join(rng.choices(words, weights=range(1, 10), k=rng.randint(0, 12))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "é", None]))
        for _ in range(150)
    ]
    rows += [("same text again", "en", "s1")] * 40 + [(None, "en", "silent"), ("", "fr", "only"), ("rare", "fr", None), (None, None, None)]
    rows += [("word " * 30_000 + "-" * 5000, "en", "s2")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "1 as term", "2 as n", "3 as below", "4 as item")
    got = source_divergence(docs.repartition(5), min_docs=6, block=block, fan_in=fan_in).collect()
    want = divergence(rows, 6)
    assert want and len(got) == len(want)
    assert {(r["lang"], r["source"], r["part"], r["item"]): (r["value"], r["rank"]) for r in got} == want
    assert source_divergence(docs.limit(0)).count() == 0


def test_long_texts_are_cut_between_terms():
    texts = [b"", b"one TWO-three" * 50, b"x" * 400 + b" y", b" ", "é ü".encode() * 9]
    whole, owner = cut_texts(texts)
    parts, again = cut_texts(texts, piece=16)
    assert whole.to_pylist() == parts.to_pylist() and owner.tolist() == again.tolist()
    assert "".join(pieces("ab cd ef " * 9, 5)) == "ab cd ef " * 9


# --- hard negatives ---------------------------------------------------------


def negatives(rows, every):
    rows = {i: (label, [max(-(1 << 24), min(1 << 24, int(np.floor(256 * x)))) for x in v]) for i, label, v in rows}
    score = lambda a, b: sum(x * y for x, y in zip(rows[a][1], rows[b][1]))
    out = set()
    for a in rows:
        if a % every:
            continue
        near = [b for b in rows if len(rows[b][1]) == len(rows[a][1])]
        ranked = sorted((-score(a, b), b) for b in near if b != a)
        for minus, p in [x for x in ranked if rows[x[1]][0] == rows[a][0]][:5]:
            found = [(m, b) for m, b in ranked if rows[b][0] != rows[a][0] and 30 * -minus <= 100 * -m <= 90 * -minus]
            out.update((a, p, rank, b, -minus, -m) for rank, (m, b) in enumerate(found[:10], 1))
    return out


@pytest.mark.parametrize("tile_rows,block_anchors", [(8192, 512), (9, 4)])
def test_hard_negatives(spark, tile_rows, block_anchors):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8)) * 2
    good = [(i, int(rng.integers(3)), (centres[i % 6] + rng.normal(scale=0.3, size=8)).tolist()) for i in range(160)]
    good += [(200 + i, i % 2, [1.0, 0.5] * 4) for i in range(40)]  # ties
    good += [(300 + i, i % 3, [float(i), -1.0, 2.0]) for i in range(12)]  # another length
    good += [(400 + 5 * i, i % 2, [1e30, -(1e9), 3.0 + i, 1e7] * 2) for i in range(4)]  # held to 2^24
    good += [(500, 1, []), (505, 1, [])]
    bad = [(601, None, [1.0] * 8), (605, 1, None), (610, 1, [float("nan")] * 8), (615, 1, [None] * 8), (620, 1, [float("inf")] * 8), (None, 1, [1.0] * 8)]
    df = spark.createDataFrame(good + bad + good[:30], "vec_id bigint, label int, embedding array<double>").selectExpr("*", "1 as id", "2 as n", "3 as v", "4 as anchor")
    got = hard_negatives(df.repartition(4), every=5, tile_rows=tile_rows, block_anchors=block_anchors)
    want = negatives(good, 5)
    assert len(want) > 500
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(want)
    assert hard_negatives(df.limit(0)).count() == 0


def test_spanning_tree_is_least():
    rng = np.random.default_rng(5)
    points = rng.integers(-50, 50, size=(30, 3))
    order, parent, edge = spanning_tree(points)
    assert sorted(order) == list(range(30)) and (parent < 0).sum() == 1
    place = {int(p): i for i, p in enumerate(order)}
    assert all(place[int(parent[i])] < place[i] for i in range(30) if parent[i] >= 0)
    root, total = list(range(30)), 0.0
    find = lambda i: i if root[i] == i else find(root[i])
    for gap, a, b in sorted((float(np.linalg.norm(points[a] - points[b])), a, b) for a in range(30) for b in range(a)):
        if find(a) != find(b):
            root[find(a)] = find(b)
            total += gap
    assert edge.sum() == pytest.approx(total)


# --- toxicity ---------------------------------------------------------------


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(1)
    truth = rng.random(6000) < 0.3
    fire = lambda on, off: np.where(truth, rng.random(6000) < on, rng.random(6000) < off)
    marked, first, third, fourth = fire(0.95, 0.02), fire(0.7, 0.1), fire(0.6, 0.05), fire(0.5, 0.5)
    second = np.where(rng.random(6000) < 0.9, first, ~first)  # follows the first
    votes = np.stack([marked, first, second, third, fourth], axis=1).astype(int)
    model, posterior = fit_label_model(votes, np.where(marked, 0.9, 0.1))
    assert ((posterior > 0.5) == truth).mean() > 0.97
    assert model.fires[1, 1] == pytest.approx(0.7, abs=0.05) and model.fires[0, 1] == pytest.approx(0.1, abs=0.05)
    assert {int(model.parent[1]), int(model.parent[2])} & {1, 2} and max(model.correlation[[1, 2]]) > 0.5
    # the pair that goes together counts about once: the other voters decide as in the true model
    alone = estimate(votes, truth.astype(float)).posterior(votes)
    assert np.abs(alone - posterior).mean() < 0.03


def test_toxicity_on_held_out_labels(spark):
    got = QUERIES["op11_toxicity"](spark, PLACE)
    assert got.count() == spark.read.parquet(f"{PLACE}/documents.parquet").count()
    rows = got.join(spark.read.parquet(f"{PLACE}/labels.parquet"), "doc_id").where("held_out and toxic is not null").collect()
    toxic = [r for r in rows if r["toxic"]]
    clean = [r for r in rows if not r["toxic"]]
    assert sum(r["predicted"] for r in toxic) >= 0.85 * len(toxic)
    assert sum(r["predicted"] for r in clean) <= 0.005 * len(clean)


def test_toxicity_on_odd_rows(spark):
    texts = ["you are a moron and a clown", "a plain and pleasant sentence", "", None, "word " * 300_000]
    rows = [(i, texts[i % len(texts)], i) for i in range(100)] + [(None, texts[0], 1), (7, texts[2], 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score bigint").selectExpr("*", "1 as half", "2 as term", "'x' as id")
    labels = spark.createDataFrame(
        [(i, int(i % 5 == 0)) for i in range(100)] + [(3, None), (None, 1), (200, 1), (4, 0)], "doc_id bigint, toxic int"
    )
    classifier = fit_toxicity(docs, labels)
    got = classify_toxicity(docs, classifier)
    assert got.columns == ["doc_id", "text", "half", "term", "id", "score", "predicted"]
    by_text = defaultdict(set)
    for r in got.collect():
        by_text[r["text"]].add((r["score"], r["predicted"]))
        assert 0 <= r["score"] <= 1
    assert len(by_text) == 5 and all(len(x) == 1 for x in by_text.values())
    assert {t for t in texts if by_text[t].pop()[1]} == {texts[0]}
    for nothing in (labels.limit(0), labels.where("toxic = 1")):
        same = classify_toxicity(docs, fit_toxicity(docs, nothing)).select(F.col("score")).distinct().count()
        assert same == 1
    assert classify_toxicity(docs.limit(0), classifier).count() == 0
