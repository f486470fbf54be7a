import base64
import hashlib
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from statewalk.llm import embeddings
from statewalk.llm.chat import format_chats, loss_text, parse
from statewalk.llm.embeddings import embedding_groups
from statewalk.llm.html_text import extract_main_text, fit_extractor
from statewalk.llm.warc import LoserTree, read_index, write_archives
from statewalk.sources.store import scratch_path

PLACE = "/root/testdata/sf0.01"


@pytest.mark.parametrize("tile_rows", [4096, 8])
def test_embeddings(spark, tile_rows):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    rows = [(centres[i % 12] + rng.normal(scale=0.12, size=16)).tolist() for i in range(150)]
    rows += [rows[0]] * 20 + [None, [0.0] * 16, [float("nan")] * 16, [None] * 16, [], [1.0, 2.0], rows[3] + [0.5]]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id bigint, embedding array<double>").selectExpr("*", "1 as rid", "2 as id", "3 as vector")
    fit = {i: np.array(r) for i, r in enumerate(rows) if r and None not in r and np.isfinite(r).all() and any(r)}
    links = [
        (a, b) for a in fit for b in fit
        if a < b and len(fit[a]) == len(fit[b])
        and fit[a] @ fit[b] / np.linalg.norm(fit[a]) / np.linalg.norm(fit[b]) >= 0.95
    ]
    want = brute.components(range(len(rows)), links)
    degree = [sum(i in pair for pair in links) for i in range(len(rows))]
    got = {r["vec_id"]: r for r in embedding_groups(df, tile_rows=tile_rows).collect()}
    assert links and {i: r["component"] for i, r in got.items()} == want
    assert [got[i]["n_links"] for i in range(len(rows))] == degree
    assert all(r["kept"] == (i == want[i]) for i, r in got.items())
    assert embedding_groups(df.limit(0)).count() == 0


def test_tiles_meet_each_near_pair_once(spark):
    """Cells cut at several depths, one dense beyond all axes: near pairs share one tile, and tiles stay small."""
    rng = np.random.default_rng(7)
    rows = np.concatenate([rng.normal(size=(300, 6)), np.array([1.0, 2, 3, 4, 5, 6]) + rng.normal(scale=0.01, size=(90, 6))])
    unit = embeddings.unit_rows(rows)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "rid bigint, vector array<double>")
    visits = embeddings.visits_of_cells(embeddings.leading(df, {}), 0.95, 16)
    assert visits.where("own").count() == len(rows) and visits.where("own").select(F.size("code")).distinct().count() > 2
    tiles = {}
    for r in embeddings.dealt_tiles(visits, 16).collect():
        tiles.setdefault((tuple(r["tile"]["code"]), r["tile"]["part"], r["tile"]["slice"]), []).append((r["rid"], r["side"]))
    met = {}
    for held in tiles.values():
        for i, (a, s) in enumerate(held):
            for b, t in held[i + 1 :]:
                if (s == 1) != (t == 1) or s == t == 2:
                    met[min(a, b), max(a, b)] = met.get((min(a, b), max(a, b)), 0) + 1
    near = {(a, b) for a, b in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.95, 1)))}
    assert len(near) > 4000 and near <= set(met) and set(met.values()) == {1}
    assert len(met) < len(rows) * (len(rows) - 1) / 2
    assert max(len(held) for held in tiles.values()) <= 2 * (1 + embeddings.SLICE_TILES) * 16


HARD = ["", None, "<|im_end|>", "<|im_start|>assistant ok", "a\nb<|nl|>", "\\<|im_end|>\\\\", "<|", "|>", "漢字 🙂", "x" * 50_000]


def test_chats_read_back(spark):
    rng = random.Random(2)
    rows = [
        (c, t if t % 4 else None, rng.choice(["user", "assistant", "assistant\n", None, "<|im_end|>"]), "".join(x or "" for x in rng.choices(HARD[:-1], k=3)))
        for c in range(40) for t in range(6)
    ]
    rows += [(None, None, None, None), (50, 0, "user", HARD[-1]), (51, 0, "assistant", "same"), (51, 0, "assistant", "same")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 as conv", "2 as safe_text", "3 as last")
    chats = format_chats(turns).select("conv_id", parse(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("loss"))
    source = {}
    for conv, turn, role, text in rows:
        source.setdefault(conv, []).append((turn is None, turn or 0, role or "", text or ""))
    got = {r["conv_id"]: r for r in chats.collect()}
    assert got.keys() == source.keys()
    for conv, said in source.items():
        said = [x[2:] for x in sorted(said)]
        assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == said
        assert got[conv]["loss"] == "".join(text for role, text in said if role == "assistant")
    assert format_chats(turns.limit(0)).count() == 0


def test_archives_read_back(spark):
    payloads = ["<p>a</p>", "<p>a</p>", "", None, "é漢\r\n\r\nWARC/1.1\r\n", "x" * 300_000, "<p>a</p>", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc"]
    urls = ["http://b.org/1", None, "", "https://www.a.com/x?y#z", "not a url", "http://a.com/\r\nx", "http://b.org/1", "http://c.net"]
    rows = list(zip(range(1, 9), urls, payloads))
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as digest", "2 as first", "3 as id", "4 as payload")
    place = scratch_path(spark, "warc-test")
    write_archives(pages, place)
    index = read_index(spark, place).collect()
    assert [(r["url_key"], r["captured"]) for r in index] == sorted((r["url_key"], r["captured"]) for r in index)
    got = {r["id"]: r for r in index}
    assert len(index) == len(rows)
    for id, _, html in rows:
        data = (html or "").encode()
        first = min(i for i, _, h in rows if (h or "") == (html or ""))
        r = got[id]
        assert r["payload_bytes"] == len(data)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first == id else ("revisit", first))
    nothing = scratch_path(spark, "warc-empty")
    write_archives(pages.limit(0), nothing)
    assert read_index(spark, nothing).count() == 0


def test_loser_tree_merges():
    rng = random.Random(4)
    for k in (0, 1, 2, 5, 9):
        runs = [sorted((rng.choice("abc"), str(rng.randint(0, 9)), "", i) for i in range(rng.randint(0, 6))) for _ in range(k)]
        assert [e[:3] for e in LoserTree(runs)] == sorted(e[:3] for run in runs for e in run)


def test_main_text(spark):
    pages = spark.read.parquet(f"{PLACE}/pages.parquet")
    forest = fit_extractor(pages)
    story = ["A headline of the day", "The first paragraph of the story has many plain words & some more, as stories do.", "The second one says what the first left out, at similar length, so that it reads as text."]
    page = (
        "<html><head><title>t</title><style>p{}</style></head><body><nav><a href=x>home</a> <a href=y>news</a></nav>"
        f"<article><h1>{story[0]}</h1><p>{story[1].replace('&', '&amp;')}</p><p>{story[2]}</p></article>"
        "<div class='sidebar'><ul><li><a href=z>more</a></li></ul></div><footer>Copyright</footer><script>var a=1</script></body></html>"
    )
    rows = [(1, None, page), (2, "u", None), (3, "u", ""), (3, "u", ""), (None, None, "<<<>&#xFFFFFFFF;<p"), (5, "u", "<div>" * 3000 + "x")]
    hard = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("old")).withColumn("id", F.lit(1))
    got = extract_main_text(hard, forest).collect()
    assert len(got) == len(rows)
    assert next(r["text"] for r in got if r["page_id"] == 1) == "\n\n".join(story)
    assert all(r["text"] == "" for r in got if r["page_id"] in (2, 3))
    assert extract_main_text(hard.limit(0), forest).count() == 0
