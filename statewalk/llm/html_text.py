"""Main text of web pages: boosted trees over DOM nodes, decoded top down.

Every block node gets a probability that its subtree belongs to the article.
A decoder then chooses for each node whether its whole subtree stays, goes, or
is left to its children, so a kept node never stands in a dropped one.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewalk.llm.trees import Forest, fit

# fixed values: names of HTML elements by what a parser or reader does with them
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset(
    "head script style template noscript title svg math iframe object canvas select option button textarea datalist audio video".split()
)
BLOCK = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption address header footer nav aside form fieldset details summary dialog center menu hgroup search".split()
)
HEAD = frozenset("title style script link meta base noscript template".split())
CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "thead", "tbody", "tfoot", "caption"}
SAME_LEVEL = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}

# fixed values: groups of tags and of words in ids, classes and roles
TAG_GROUPS = [
    {"nav", "menu"}, {"header"}, {"footer"}, {"aside"}, {"form", "fieldset", "search", "dialog"}, {"article"}, {"main"},
    {"section"}, {"div", "center"}, {"p"}, {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}, {"ul", "ol", "dl"}, {"li", "dt", "dd"},
    {"table", "thead", "tbody", "tfoot", "tr"}, {"td", "th", "caption"}, {"blockquote", "pre"}, {"figure", "figcaption"},
]
TOKEN_GROUPS = [
    "article content post entry story text body main page blog news read prose".split(),
    "nav navigation navbar menu menubar breadcrumb breadcrumbs toc tabs pagination pager topnav links skip".split(),
    "header masthead top branding logo banner site hero toolbar".split(),
    "footer foot bottom copyright legal colophon contentinfo credits".split(),
    "sidebar side aside widget complementary right left column rail related popular trending recommended more recent".split(),
    "cookie consent gdpr notice alert notification popup modal overlay newsletter subscribe subscription paywall privacy promo signup warning message".split(),
    "ad ads advert advertisement adsense sponsor sponsored promoted banner-ad dfp commercial adbox adslot advertorial".split(),
    "comment comments commentlist respond reply replies disqus discussion reader feedback reviews thread guestbook".split(),
    "share social sharing tags meta byline author follow print tools actions".split(),
    "form search login contact input field".split(),
]
SURE_TAGS = [{"nav", "menu"}, {"header", "footer"}, {"aside"}, {"form", "dialog"}, {"article", "main"}]
MARK = "data-main"


class Tree(HTMLParser):
    """A forgiving DOM: parallel lists over nodes, and text blocks in page order."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.depth, self.words, self.mark = ["#"], [-1], [0], [()], [""]
        self.open, self.silent = [0], 0
        self.block_node: list[int] = []
        self.block_text: list[list[str]] = []
        self.block_link: list[int] = []
        self.fresh, self.links = True, 0
        self.hidden = [False]
        self.feed(html)
        self.close()
        self.texts = [" ".join("".join(parts).split()) for parts in self.block_text]

    def push(self, tag: str, attrs) -> None:
        named = dict(attrs)
        words = re.findall(r"[a-z]+", " ".join(f"{named.get(k) or ''}" for k in ("id", "class", "role", "aria-label", "itemprop")).lower())
        style = (named.get("style") or "").replace(" ", "").lower()
        hidden = "hidden" in named or named.get("aria-hidden") == "true" or "display:none" in style
        self.tag.append(tag)
        self.parent.append(self.open[-1])
        self.depth.append(len(self.open))
        self.words.append(tuple(words))
        self.mark.append(named.get(MARK) or "")
        self.hidden.append(hidden)
        self.open.append(len(self.tag) - 1)
        self.silent += tag in SILENT or hidden
        self.links += tag == "a"

    def pop(self) -> None:
        node = self.open.pop()
        self.silent -= self.tag[node] in SILENT or self.hidden[node]
        self.links -= self.tag[node] == "a"

    def close_upto(self, tags, stop) -> None:
        """Closes the nearest open element named in `tags`, unless one in `stop` comes first."""
        for at in range(len(self.open) - 1, 0, -1):
            name = self.tag[self.open[at]]
            if name in tags:
                while len(self.open) > at:
                    self.pop()
                return
            if name in stop:
                return

    def leave_head(self) -> None:
        """A head ends at the first thing that cannot stand in it, with or without its end tag."""
        if self.tag[self.open[-1]] == "head":
            self.pop()

    def handle_starttag(self, tag, attrs):
        if tag not in HEAD:
            self.leave_head()
        if tag in BLOCK:
            self.fresh = True
        if tag in CLOSES_P:
            self.close_upto({"p"}, {"td", "th", "table", "button"})
        if tag in SAME_LEVEL:
            self.close_upto(*SAME_LEVEL[tag])
        if tag == "br":
            self.handle_data(" ")
        elif tag == "body" and not any(self.tag[n] == "body" for n in self.open):
            self.close_upto({"head"}, ())
            self.push(tag, attrs)
        elif tag == "a" and self.links:
            self.close_upto({"a"}, BLOCK)
            self.push(tag, attrs)
        elif tag not in VOID:
            self.push(tag, attrs)
        elif tag == "hr":
            self.fresh = True

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # HTML ignores the slash

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.fresh = True
        if tag == "br":
            self.handle_data(" ")
        elif tag not in VOID:
            stop = () if tag in BLOCK or tag in SILENT else BLOCK
            self.close_upto({tag}, stop)

    def handle_data(self, data):
        if data.strip():
            self.leave_head()
        if self.silent:
            return
        node = self.open[-1]
        while self.tag[node] not in BLOCK and self.parent[node] > 0:
            node = self.parent[node]
        if self.fresh or not self.block_node or self.block_node[-1] != node:
            if not data.strip():
                return
            self.block_node.append(node)
            self.block_text.append([])
            self.block_link.append(0)
            self.fresh = False
        self.block_text[-1].append(data)
        if self.links:
            self.block_link[-1] += len(data)


_GROUP_OF = {w: i for i, group in enumerate(TOKEN_GROUPS) for w in group}
_TAG_OF = {t: i for i, group in enumerate(TAG_GROUPS) for t in group}


class Nodes:
    """The block nodes of a page that hold text, parents first, and their features."""

    def __init__(self, tree: Tree):
        self.tree = tree
        n = len(tree.tag)
        own = [[0.0] * 7 for _ in range(n)]  # chars, link chars, blocks, words, stops, longest, paragraphs
        for node, text, link in zip(tree.block_node, tree.texts, tree.block_link):
            o = own[node]
            o[0] += len(text)
            o[1] += min(link, len(text))
            o[2] += 1
            o[3] += text.count(" ") + 1
            o[4] += text.count(".") + text.count(",")
            o[5] = max(o[5], len(text))
            o[6] += len(text) >= 80
        first = [0.0] * n
        at = 0.0
        for node, text in zip(tree.block_node, tree.texts):
            while node > 0 and not first[node]:
                first[node] = at + 1
                node = tree.parent[node]
            at += len(text)
        self.page_chars = max(at, 1.0)
        size = [1] * n
        for i in range(n - 1, 0, -1):
            p = tree.parent[i]
            o, q = own[i], own[p]
            for k in (0, 1, 2, 3, 4, 6):
                q[k] += o[k]
            q[5] = max(q[5], o[5])
            size[p] += size[i]
        kept = [i for i in range(1, n) if tree.tag[i] in BLOCK and own[i][0] > 0]
        self.kept, self.own, self.size, self.first = kept, own, size, first
        self.children: dict[int, list[int]] = {i: [] for i in kept}
        self.children[0] = []
        self.above = {}
        for i in kept:
            p = tree.parent[i]
            while p > 0 and p not in self.children:
                p = tree.parent[p]
            self.children[p].append(i)
            self.above[i] = p

    def features(self) -> list[list[float]]:
        tree, own, rows = self.tree, self.own, []
        places = {c: at for siblings in self.children.values() for at, c in enumerate(siblings)}
        alike = {up: Counter(tree.tag[c] for c in siblings) for up, siblings in self.children.items()}
        inherited: dict[int, list[float]] = {0: [0.0] * (len(TOKEN_GROUPS) + len(SURE_TAGS))}
        for i in self.kept:
            up = self.above[i]
            o, total = own[i], own[i][0]
            tokens = [0.0] * len(TOKEN_GROUPS)
            for w in tree.words[i]:
                if w in _GROUP_OF:
                    tokens[_GROUP_OF[w]] += 1.0
            tags = [0.0] * len(TAG_GROUPS)
            if tree.tag[i] in _TAG_OF:
                tags[_TAG_OF[tree.tag[i]]] = 1.0
            sure = [float(tree.tag[i] in group) for group in SURE_TAGS]
            from_above = inherited[up]
            inherited[i] = [max(a, b) for a, b in zip(from_above, [min(t, 1.0) for t in tokens] + sure)]
            siblings = self.children[up]
            place = places[i]
            around = own[up][0] if up else self.page_chars
            rows.append(
                [
                    np.log1p(total),
                    o[1] / total,
                    o[2],
                    np.log1p(o[5]),
                    o[4] / max(o[3], 1.0),
                    total / max(o[2], 1.0),
                    total / self.size[i],
                    np.log1p(self.size[i]),
                    o[6],
                    total / self.page_chars,
                    total / max(around, 1.0),
                    self.first[i] / self.page_chars,
                    float(tree.depth[i]),
                    place / max(len(siblings), 1),
                    float(len(siblings)),
                    alike[up][tree.tag[i]] / max(len(siblings), 1),
                    float(len(self.children[i])),
                    *tags,
                    *tokens,
                    *from_above,
                ]
            )
        return rows

    def labels(self) -> list[int | None]:
        """For pages with marks: 1 and 0 for nodes wholly in or out, None for mixed ones."""
        tree, found, inside = self.tree, {}, {0: ""}
        for i in range(1, len(tree.tag)):
            inside[i] = tree.mark[i] or inside[tree.parent[i]]
        for node in tree.block_node:
            value = inside[node]
            while node > 0:
                found.setdefault(node, set()).add(value == "1")
                node = tree.parent[node]
        return [None if len(found[i]) > 1 else int(found[i] == {True}) for i in self.kept]

    def decode(self, p: np.ndarray, split_cost: float, drop_cost: float) -> set[int]:
        """The nodes whose own text stays.

        For every subtree: the best of all in, all out, or each child for itself
        (its own text then as the node's probability says) at the price of a
        split, which the page as a whole has for nothing; out of a node that
        stays itself a child only goes at a price.
        """
        odds = np.log(np.clip(p, 1e-4, 1 - 1e-4)) - np.log1p(-np.clip(p, 1e-4, 1 - 1e-4))
        place = {i: k for k, i in enumerate(self.kept)}
        weight = {i: 1.0 for i in self.kept}
        all_in: dict[int, float] = {}
        best: dict[int, tuple[float, str]] = {}
        best_in_kept: dict[int, tuple[float, str]] = {}
        for i in reversed(self.kept):
            own = float(odds[place[i]]) * weight[i]
            below = self.children[i]
            whole = own + sum(all_in[c] for c in below)
            all_in[i] = whole
            chosen = best_in_kept if own > 0 else best
            price = 0.0 if self.tree.tag[i] in ("html", "body") else split_cost
            free = max(own, 0.0) + sum(chosen[c][0] for c in below) - price if below else -np.inf
            best[i] = max((whole, "in"), (0.0, "out"), (free, "split"), key=lambda x: x[0])
            best_in_kept[i] = max((whole, "in"), (-drop_cost, "out"), (free, "split"), key=lambda x: x[0])
        kept: set[int] = set()
        todo = [(c, best[c][1]) for c in self.children[0]]
        while todo:
            i, choice = todo.pop()
            own = odds[place[i]] > 0
            if choice == "in" or (choice == "split" and own):
                kept.add(i)
            chosen = best_in_kept if own else best
            if choice != "out":
                todo.extend((c, "in" if choice == "in" else chosen[c][1]) for c in self.children[i])
        return kept


def main_texts(pages: list[str], forest: Forest, split_cost: float, drop_cost: float) -> list[str]:
    """The main text of each page."""
    parsed = [Nodes(Tree(html)) for html in pages]
    rows = [row for nodes in parsed for row in nodes.features()]
    scores = forest.score(np.array(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for nodes in parsed:
        n = len(nodes.kept)
        kept = nodes.decode(scores[at : at + n], split_cost, drop_cost)
        at += n
        tree = nodes.tree
        out.append("\n\n".join(t for node, t in zip(tree.block_node, tree.texts) if node in kept and t))
    return out


# --- training ---------------------------------------------------------------

# fixed values: how a layout may name its parts
MAIN_PARTS = [
    "article", "main", "section#content", "div.content", "div.post", "div.entry-content", "div.article-body", "div#main-content",
    "div.story", "div.page-text", "article.post", "div", "section.article", "td", "div.blog-post",
]
OTHER_PARTS = {
    "menu": ["nav", "div.menu", "ul#nav", "div.navbar", "div.breadcrumbs", "nav.pagination", "div.topnav"],
    "header": ["header", "div.site-header", "div#header", "div.masthead", "header.top"],
    "footer": ["footer", "div.footer", "div#footer", "div.site-footer", "div.copyright", "footer.bottom"],
    "sidebar": ["aside", "div.sidebar", "div.widget", "div#right-column", "div.related", "aside.popular", "section.recommended"],
    "notice": ["div.cookie-notice", "div#consent", "div.newsletter", "div.alert", "div.gdpr-banner", "section.subscribe", "div.modal"],
    "advert": ["div.ad", "div.ads", "div.advert", "div.sponsored", "aside.advertisement", "div.promo", "div#ad-slot", "ins.adsense"],
    "form": ["form", "form.search", "div.login-form", "form#contact"],
    "comments": ["section#comments", "div.comments", "ol.commentlist", "div.reader-comments", "div#disqus", "section.discussion", "div.replies"],
    "share": ["div.share", "div.social", "ul.tags"],
}
TEXT_PARTS = ["p", "p", "p", "p", "div", "li", "h2", "h3", "blockquote", "pre", "br"]


def _part(name: str, inner: str, mark: str = "") -> str:
    tag, kind, value = re.fullmatch(r"(\w+)([.#]?)(.*)", name).groups()
    attribute = {".": f' class="{value}"', "#": f' id="{value}"', "": ""}[kind]
    marked = f' {MARK}="{mark}"' if mark else ""
    return f"<{tag}{attribute}{marked}>{inner}</{tag}>"


def _other(rng: random.Random, kind: str, snippets: list[str], paragraphs: list[str]) -> str:
    short = lambda: escape(" ".join(rng.choice(snippets).split()[: rng.randint(1, 6)]) or "more")
    long = lambda: escape(rng.choice(paragraphs))
    link = lambda: f'<a href="/x">{short()}</a>'
    some = range(rng.randint(1, 6))
    if kind in ("menu", "share"):
        inner = "".join(f"<li>{link()}</li>" for _ in some)
        inner = inner if rng.random() < 0.5 else f"<ul>{inner}</ul>"
    elif kind == "header":
        inner = rng.choice([f"<h1>{short()}</h1>", f"<a href='/'>{short()}</a>", f"<p>{short()}</p>{link()}"])
    elif kind == "footer":
        inner = rng.choice([f"&copy; {short()} &middot; {long()[:200]}", f"<p>{short()}</p>" + "".join(link() for _ in some)])
    elif kind == "sidebar":
        inner = f"<h3>{short()}</h3>" + "".join(rng.choice([f"<p>{long()}</p>", f"<li>{link()}</li>"]) for _ in some)
    elif kind == "comments":
        inner = f"<h3>{short()}</h3>" * rng.randint(0, 1) + "".join(
            _part(rng.choice(["div.comment", "li", "p", "article.comment"]), f"<p>{long()}</p>") for _ in some
        )
    elif kind == "form":
        inner = f"<label>{short()}</label><input><p>{short()}</p>"
    else:
        inner = rng.choice([short(), long(), f"<p>{long()}</p>", f"<p>{short()}</p>{link()}"])
    return _part(rng.choice(OTHER_PARTS[kind]), inner, "0")


def _small(rng: random.Random, text: str) -> str:
    """A short block that belongs to an article: a heading, a line, a list, a table, a caption."""
    words = text.split() or ["more"]
    some = lambda most: escape(" ".join(words[at : at + rng.randint(1, most)]) if (at := rng.randrange(len(words))) >= 0 else "")
    kind = rng.choice(["h2", "h3", "p", "ul", "ol", "table", "dl", "figure", "blockquote"])
    rows = range(rng.randint(2, 6))
    if kind in ("ul", "ol"):
        return f"<{kind}>" + "".join(f"<li>{some(rng.choice([3, 12]))}</li>" for _ in rows) + f"</{kind}>"
    if kind == "table":
        cell = lambda tag: f"<{tag}>{some(3)}</{tag}>"
        head = f"<tr>{cell('th')}{cell('th')}</tr>" if rng.random() < 0.5 else ""
        return f"<table>{head}" + "".join(f"<tr>{cell('td')}{cell('td')}</tr>" for _ in rows) + "</table>"
    if kind == "dl":
        return "<dl>" + "".join(f"<dt>{some(2)}</dt><dd>{some(8)}</dd>" for _ in rows) + "</dl>"
    if kind == "figure":
        return f"<figure><img src='x.png'><figcaption>{some(6)}</figcaption></figure>"
    return f"<{kind}>{some(rng.choice([1, 3, 8]))}</{kind}>"


def layout(rng: random.Random, title: str, paragraphs: list[str], snippets: list[str], strangers: list[str]) -> str:
    """One marked training page: an article's blocks set in a random layout."""
    title = " ".join(title.split()[: rng.choice([1, 2, 99])]) or "A title"
    rich, terse = rng.random() < 0.5, rng.random() < 0.3
    blocks = [f"<h1>{escape(title)}</h1>"] if rng.random() < (0.5 if terse else 0.8) else []
    if terse:  # an article of a few lines
        paragraphs = [" ".join(text.split()[: rng.randint(2, 9)]) or "Some words." for text in paragraphs[: rng.randint(1, 3)]]
    for text in paragraphs:
        if rich and rng.random() < 0.4:
            blocks.append(_small(rng, text))
        kind = rng.choice(TEXT_PARTS) if rng.random() < 0.4 else "p"
        blocks.append(f"<p>{escape(text)}<br>" if kind == "br" else _part(kind, escape(text)))
        if rng.random() < (0.0 if terse else 0.12):
            blocks.append(_other(rng, rng.choice(["advert", "notice", "share", "sidebar"]), snippets, strangers))
    if rng.random() < 0.25:
        blocks.append(_other(rng, rng.choice(["comments", "share", "form"]), snippets, strangers))
    main = _part(rng.choice(MAIN_PARTS), "".join(blocks), "1")
    before = [_other(rng, k, snippets, strangers) for k in ("menu", "header", "advert", "notice") if rng.random() < 0.6]
    after = [
        _other(rng, k, snippets, strangers)
        for k in ("comments", "sidebar", "share", "form", "advert", "notice", "footer")
        if rng.random() < 0.45
    ]
    rng.shuffle(before)
    body = "".join([*before, main, *after])
    if rng.random() < 0.4:
        body = _part(rng.choice(["div.wrapper", "div#page", "div.container", "main", "div.site-content"]), body)
    return f"<html><body>{body}</body></html>"


def fit_extractor(pages: DataFrame, limit: int = 300, layouts: int = 1000, html: str = "html", id: str = "page_id", max_chars: int = 50_000) -> Forest:
    """Learns to tell article nodes from the rest.

    The blocks of at most `limit` pages of up to `max_chars` characters, first by
    a hash of id and page, teach what stands in an article or main element.
    Their words also fill `layouts` more training pages: blocks of articles are
    set as such in random layouts, the others as menus, notices, comments and so
    on.  With the defaults the driver holds 30 MB at
    most.  Without pages a few stock words stand in, so a forest always results.
    """
    rows = (
        pages.where(F.length(html) <= max_chars)
        .select(F.xxhash64(id, html).alias("h"), F.col(html).alias("html"))
        .orderBy("h", "html")
        .limit(limit)
        .collect()
    )
    articles, snippets, x, y = [], [], [], []

    def learn(tree: Tree) -> None:
        nodes = Nodes(tree)
        for row, label in zip(nodes.features(), nodes.labels()):
            if label is not None:
                x.append(row)
                y.append(label)

    for row in rows:
        tree = Tree(row["html"])
        inside = [False]
        for i in range(1, len(tree.tag)):
            inside.append(inside[tree.parent[i]] or tree.tag[i] in ("article", "main"))
        own = [t for node, t in zip(tree.block_node, tree.texts) if inside[node] and t]
        snippets += [t for node, t in zip(tree.block_node, tree.texts) if not inside[node] and t]
        if own:
            articles.append(own)
            tree.mark = ["1" if tag in ("article", "main") else "" for tag in tree.tag]
            learn(tree)
    articles = articles or [["A title", "Some words of a paragraph, and some more of them. " * 3]]
    snippets = snippets or ["home", "about us", "all rights reserved"]
    rng = random.Random(11)
    for _ in range(layouts):
        own = rng.choice(articles)
        few = own[1 : 1 + rng.randint(1, rng.choice([4, 12, 60]))] or own
        learn(Tree(layout(rng, own[0][:80], few, snippets, rng.choice(articles))))
    return fit(np.array(x), np.array(y, dtype=float), trees=80, depth=6)


def extract_main_text(
    pages: DataFrame,
    forest: Forest,
    html: str = "html",
    id: str = "page_id",
    url: str = "url",
    split_cost: float = 3.0,
    drop_cost: float = 4.0,
) -> DataFrame:
    """The id, url and `text`, the main text, of each row of `pages`.

    Blocks are joined by an empty line; white space inside a block is one
    space.  Null and empty pages, and pages without an article, give the empty
    text; elements may be left open, and a head ends where its elements do; ids
    and urls may be null or repeated, equal pages get equal texts; other columns
    are not looked at; an empty table gives an empty result.
    """
    ids = pages.select(F.col(id).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = main_texts(batch.column("html").to_pylist(), forest, split_cost, drop_cost)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("url"), pa.array(texts, pa.string())], ["id", "url", "text"]
                )

    found = ids.mapInArrow(run, f"id {pages.schema[id].dataType.simpleString()}, url string, text string")
    return found.select(F.col("id").alias(id), F.col("url").alias(url), "text")
