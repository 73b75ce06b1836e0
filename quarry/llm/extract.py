"""Main text of web pages: boosted trees over DOM-node features, decoded along the tree.

A page is read once into a tree of blocks; inline markup stays inside its block and
scripts, styles, comments and controls are left out.  Each block has features: text and
tag density of its subtree, link density, tokens of its class, id and role, depth, place
on the page, and how it compares with its siblings.  Gradient-boosted trees give each
block log-odds of belonging to the article.  Decoding is hierarchical: a block can be
kept only if its parent is, and the choice with the highest summed log-odds wins, so
choices along a path never contradict each other.

The trees are fitted on ``TRAIN_PAGES`` synthetic pages whose article blocks are known.

Scale: one pass, no shuffle; a page is held once, with its blocks.

Defined results: a null or empty page, or one where nothing is kept, gives the empty
text; unclosed and stray tags are repaired as browsers do for paragraphs and lists;
repeated rows are handled alike; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import boost
from quarry.llm.common import chunks, read_table

TRAIN_PAGES = 360
TREES, DEPTH = 24, 4

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>|<[!?][^>]*+>?", re.S
)
_ATTR = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_SPLIT = re.compile(r"(?<=[a-z])(?=[A-Z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math select textarea button title canvas audio video".split())
BLOCKS = frozenset(
    "html body div article section main nav header footer aside form p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption fieldset details summary address center hgroup menu dialog".split()
)
#: A tag that opens closes these, up to the nearest of the tags that hold it.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])

#: Words of class, id and role that speak for or against the article.
FOR = frozenset("article content main post entry body story text blog page prose".split())
AGAINST = frozenset(
    "nav navbar navigation menu header masthead banner footer foot sidebar side aside ad ads advert advertisement adverts promo promotion sponsor sponsored "
    "cookie cookies notice consent gdpr alert popup modal overlay newsletter subscribe signup share sharing social comment comments reply replies respond "
    "discussion form login search related recommended recommendations breadcrumb breadcrumbs widget toolbar legal copyright pagination pager tags meta "
    "complementary contentinfo dialog disclaimer warning".split()
)
_TAG_GROUP = {}
for _i, _names in enumerate(["nav header footer aside form menu dialog address", "article main", "p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption", "ul ol li dl dt dd", "table thead tbody tr td th caption"]):
    _TAG_GROUP |= dict.fromkeys(_names.split(), _i)


class Node:
    __slots__ = ("against", "children", "controls", "depth", "fors", "link", "links", "parent", "punct", "runs", "start", "tag", "tags", "text", "words")

    def __init__(self, tag: str, parent: int, depth: int, attrs: str, start: int):
        self.tag, self.parent, self.depth, self.start = tag, parent, depth, start
        self.children: list[int] = []
        self.runs: list[str] = []  # the text of a leaf, as it stands
        self.text = self.link = self.links = self.tags = self.controls = self.punct = self.words = 0
        self.fors = self.against = 0
        if attrs:
            for m in _ATTR.finditer(attrs):
                for w in _WORD.findall(_SPLIT.sub(" ", m[1] or m[2] or m[3] or "").lower()):
                    self.fors += w in FOR
                    self.against += w in AGAINST


def blocks(page: str) -> list[Node]:
    """The page's blocks in page order, parents first; every run of text is in a leaf of its own."""
    nodes = [Node("#page", -1, 0, "", 0)]
    stack: list[tuple[str, int]] = [("#page", 0)]  # open tags, and the block each is in
    current, leaf, in_link, at, size, seen = 0, -1, 0, 0, len(page), 0
    unclosed: set[str] = set()

    def add(text: str) -> None:
        nonlocal leaf, seen
        if leaf < 0:
            if not text.strip():
                return
            leaf = len(nodes)
            nodes[current].children.append(leaf)
            nodes.append(Node("#text", current, nodes[current].depth + 1, "", seen))
        n = len(text)
        seen += n
        node = nodes[leaf]
        node.runs.append(text)
        if in_link:
            node.link += n

    def close(i: int) -> None:
        nonlocal current, leaf, in_link
        for name, _ in stack[i:]:
            in_link -= name == "a"
            if name in BLOCKS:
                leaf = -1
        del stack[i:]
        current = stack[-1][1]

    while at < size:
        m = _TAG.search(page, at)
        end = m.start() if m else size
        if end > at:
            add(page[at:end])
        if not m:
            break
        at, name = m.end(), (m["name"] or "").lower()
        if not name:
            continue
        if m["close"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    close(i)
                    break
                if name not in BLOCKS and stack[i][0] in BLOCKS:
                    break  # an inline end tag doesn't close blocks
            continue
        if name in RAW:
            stop = None if name in unclosed else re.compile(rf"</{name}\b[^>]*+>?", re.I).search(page, at)
            if stop is None:
                unclosed.add(name)  # nor is there an end tag farther on
            nodes[current].controls += name in ("select", "textarea", "button")
            at = stop.end() if stop else (size if name in ("script", "style", "textarea", "title") else at)
            if name == "title":
                leaf = -1
            continue
        if name in VOID:
            nodes[current].controls += name == "input"
            nodes[current].tags += 1
            if leaf >= 0 and name in ("br", "hr"):
                nodes[leaf].runs.append(" ")
            continue
        if name in BLOCKS:
            for i in range(len(stack) - 1, 0, -1):
                tag = stack[i][0]
                if tag == "p":
                    close(i)
                    break
                if tag in BLOCKS:
                    break
            if name in _CLOSES:
                same, holders = _CLOSES[name]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in same:
                        close(i)
                        break
                    if stack[i][0] in holders:
                        break
            leaf = -1
            nodes[current].children.append(len(nodes))
            nodes.append(Node(name, current, nodes[current].depth + 1, m["attrs"], seen))
            current = len(nodes) - 1
        else:
            nodes[current].tags += 1
            if name == "a":
                in_link += 1
                nodes[current].links += 1
        stack.append((name, current))
    for node in nodes:
        if node.runs:
            text = "".join(node.runs)
            node.text, node.words = len(text), text.count(" ") + 1
            node.punct = text.count(".") + text.count(",") + text.count("!") + text.count("?") + text.count(";")
    return nodes


N_FEATURES = 26


def node_features(nodes: list[Node]) -> np.ndarray:
    n = len(nodes)
    total = np.array([[x.text, x.link, x.links, x.tags + 1, x.controls, x.punct, x.words, x.tag == "p" or x.tag in _HEADINGS, 1] for x in nodes], float)
    for i in range(n - 1, 0, -1):
        total[nodes[i].parent] += total[i]
    page = max(1.0, total[0, 0])
    out = np.zeros((n, N_FEATURES))
    fors, against, bad_tag, good_tag = (np.zeros(n) for _ in range(4))
    for i, x in enumerate(nodes):
        up, group = max(x.parent, 0), _TAG_GROUP.get(x.tag, 5)
        if i:
            fors[i], against[i] = fors[up] + x.fors, against[up] + x.against
            bad_tag[i], good_tag[i] = bad_tag[up] + (group == 0), good_tag[up] + (group == 1)
        text, link, links, tags, controls, punct, words, paragraphs, below = total[i]
        siblings = len(nodes[up].children) if i else 1
        out[i] = (
            x.depth, math.log1p(text), link / max(1.0, text), text / tags, len(x.children), paragraphs / below,
            x.fors, x.against, group, x.tag == "#text", fors[i], against[i], bad_tag[i], good_tag[i],
            x.start / page, (x.start + text) / page, siblings, text / max(1.0, total[up, 0]), punct / max(1.0, text), words, controls, links,
            x.tag in _HEADINGS, text / page, _TAG_GROUP.get(nodes[up].tag, 5), nodes[up].against,
        )
    return out


def decode(nodes: list[Node], log_odds: np.ndarray) -> list[int]:
    """Leaves kept by the choice with the highest sum of log-odds in which kept blocks have kept parents."""
    best = log_odds.tolist()
    for i in range(len(nodes) - 1, 0, -1):
        if best[i] > 0:
            best[nodes[i].parent] += best[i]
    keep, out = [best[0] > 0] + [False] * (len(nodes) - 1), []
    for i in range(1, len(nodes)):
        keep[i] = keep[nodes[i].parent] and best[i] > 0
        if keep[i] and nodes[i].runs:
            out.append(i)
    return out


def block_text(node: Node) -> str:
    return " ".join(html.unescape("".join(node.runs)).split())


def main_texts(pages: list[str], trees: list) -> list[str]:
    parsed = [blocks(p) for p in pages]
    if not parsed:
        return []
    scores = boost.log_odds(trees, np.concatenate([node_features(n) for n in parsed]))
    out, at = [], 0
    for nodes in parsed:
        kept = decode(nodes, scores[at : at + len(nodes)])
        at += len(nodes)
        out.append(" ".join(t for t in (block_text(nodes[i]) for i in kept) if t))
    return out


# --- training pages ----------------------------------------------------------


def training_page(rng: random.Random) -> str:
    """A page in which every block of the article carries the letter q in each word, and no other block does."""

    def words(n: int, main: bool) -> str:
        letters = "abcdefghijklmnoprstuvwxyz"
        return " ".join(("q" if main else "") + "".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(n))

    def sentence(main: bool, lo: int = 2, hi: int = 25) -> str:
        return words(rng.randint(lo, hi), main).capitalize().replace("Q", "q") + rng.choice([".", ".", "!", "?", ""])

    def prose(main: bool, lo: int = 1, hi: int = 6) -> str:
        s = " ".join(sentence(main) for _ in range(rng.randint(lo, hi)))
        return f"<b>{s}</b>" if rng.random() < 0.05 else s.replace(" ", ' <a href="/x">qz</a> ' if main else " ", 1) if rng.random() < 0.1 else s

    def attr(names: str) -> str:
        return f' {rng.choice(["class", "id", "class"])}="{rng.choice(names.split("|"))}"'

    def links(lo: int = 2, hi: int = 9) -> str:
        item = lambda: f'<a href="/{words(1, False)}">{words(rng.randint(1, 3), False)}</a>'
        return "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(rng.randint(lo, hi))) + "</ul>" if rng.random() < 0.7 else " ".join(item() for _ in range(rng.randint(lo, hi)))

    def some(make: list, p: float) -> str:
        return "".join(m() for m in make if rng.random() < p)

    wrap = lambda tag, names, body: f"<{tag}{attr(names) if rng.random() < 0.6 or tag == 'div' else ''}>{body}</{tag}>"
    short = lambda: prose(False, 1, 2)
    p_or_bare = lambda x: f"<p>{x}</p>" if rng.random() < 0.5 else x
    nav = lambda: wrap(rng.choice(["nav", "nav", "div"]), "nav|menu|top-menu|main-navigation|breadcrumb|navbar", links())
    advert = lambda: wrap(rng.choice(["div", "div", "aside", "section"]), "ad|ads|advert|ad-slot|sponsored|promo|banner-ad", p_or_bare(prose(False, 1, 3)))
    header = lambda: wrap(rng.choice(["header", "div"]), "header|masthead|site-header|banner", p_or_bare(short()) + (links(1, 5) if rng.random() < 0.5 else ""))
    footer = lambda: wrap(rng.choice(["footer", "footer", "div"]), "footer|site-footer|copyright|foot", rng.choice(["&copy; ", ""]) + p_or_bare(prose(False, 1, 3)))
    sidebar = lambda: wrap(rng.choice(["aside", "aside", "div"]), "sidebar|side|widget|related|recommended-posts", (f"<h3>{words(2, False)}</h3>" if rng.random() < 0.5 else "") + rng.choice([links, lambda: f"<p>{prose(False)}</p>"])())
    notice = lambda: wrap(rng.choice(["div", "section", "aside"]), "notice|cookie-notice|cookie|consent|alert|gdpr-popup|newsletter|disclaimer", p_or_bare(prose(False, 1, 3)) + ("<button>OK</button>" if rng.random() < 0.5 else ""))
    form = lambda: f"<form{attr('login|search|subscribe|contact-form') if rng.random() < 0.5 else ''}>" + p_or_bare(f"<label>{words(2, False)}</label><input name=a>" + short()) + "</form>"
    remark = lambda: rng.choice(["<div class=\"comment\"><p>{}</p></div>", "<li><p>{}</p></li>", "<p>{}</p>", "<div>{}</div>", "<article class=\"comment\"><p>{}</p></article>"]).format(prose(False, 1, 5))
    comments = lambda: wrap(rng.choice(["section", "div", "div", "aside"]), "comments|comment-list|replies|discussion|respond|reader-comments", (f"<h3>{words(2, False)}</h3>" if rng.random() < 0.6 else "") + "".join(remark() for _ in range(rng.randint(1, 8))))
    outer = [nav, advert, header, sidebar, notice, form]

    def paragraph() -> str:
        kind, text = rng.random(), prose(True, 1, 9)
        if kind < 0.75:
            return f"<p>{text}</p>" if rng.random() < 0.85 else f"<p><b>{text}<br>"
        if kind < 0.82:
            return f"<h2>{words(rng.randint(1, 8), True)}</h2>"
        if kind < 0.88:
            return "<ul>" + "".join(f"<li>{prose(True, 1, 2)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if kind < 0.92:
            return f"<blockquote><p>{text}</p></blockquote>"
        if kind < 0.95:
            return "<table>" + "".join(f"<tr><td>{prose(True, 1, 1)}</td><td>{words(2, True)}</td></tr>" for _ in range(3)) + "</table>"
        if kind < 0.97:
            return f"<pre>{text}</pre>"
        return f"<div>{text}</div>"

    body = (f"<h1>{words(rng.randint(1, 12), True)}</h1>" if rng.random() < 0.85 else "") + "".join(
        paragraph() + (some([advert, sidebar, form, notice], 0.05) if rng.random() < 0.4 else "") for _ in range(rng.randint(1, 14))
    )
    tail = comments() if rng.random() < 0.45 else ""
    inside = rng.random() < 0.3
    tag = rng.choice(["article", "article", "article", "main", "div", "section"])
    article = wrap(tag, "content|post|article|entry-content|main|story|article-body|post-content", body + (tail if inside else ""))
    if rng.random() < 0.3:
        article = wrap(rng.choice(["main", "div"]), "main|wrapper|container|page|content|row", some(outer, 0.15) + article + some([sidebar, advert], 0.2))
    page = some(outer, 0.4) + article + ("" if inside else tail) + some([sidebar, advert, notice, form, nav], 0.2) + some([footer], 0.85)
    if rng.random() < 0.2:
        page = f"<div{attr('wrapper|container|site|app|layout')}>{page}</div>"
    out = f'<!DOCTYPE html><html lang="en"><head><title>{words(4, True)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>{page}</body></html>'
    return out[: rng.randint(len(out) // 2, len(out))] if rng.random() < 0.1 else out


def fit(pages: int = TRAIN_PAGES, seed: int = 5) -> list:
    rng, xs, ys = random.Random(seed), [], []
    for _ in range(pages):
        nodes = blocks(training_page(rng))
        y = np.zeros(len(nodes))
        for i in range(len(nodes) - 1, 0, -1):
            if nodes[i].runs:
                y[i] = any(w.startswith("q") for w in "".join(nodes[i].runs).split())
            y[nodes[i].parent] = max(y[nodes[i].parent], y[i])
        xs.append(node_features(nodes))
        ys.append(y)
    return boost.fit(np.concatenate(xs), np.concatenate(ys), trees=TREES, depth=DEPTH, bins=16)


_trees: list = []


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for each row of pages (page_id, url, html)."""
    if not _trees:
        _trees.extend(fit())
    trees = pages.sparkSession.sparkContext.broadcast(list(_trees))

    def run(batches):
        for batch in batches:
            texts = []
            for _, parts in chunks(batch, "html"):
                texts += main_texts([p.decode("utf-8", "replace") for p in parts], trees.value)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return (
        pages.select("page_id", "url", "html")
        .mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
        .withColumn("n_chars", F.length("text").cast("bigint"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
