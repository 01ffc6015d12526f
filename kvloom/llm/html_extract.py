"""HTML extraction: a linear-chain conditional random field over the leaf blocks of a page.

``blocks`` reads a page in one pass into its leaf blocks (runs of text between block-level tags)
with their ancestors; a block's features are its ancestors' tags and class or id words, its parent,
and its text (length, share of link text, ending, digits, capitals).  The field labels each block
as main text or not, with weights for neighbouring labels, and is decoded by Viterbi.

It is trained on labelled pages: a bounded sample of the table (``TRAIN_PAGES`` rows of smallest id
hash) labelled by its semantic containers, and the same articles set into other layouts (plain
``div`` pages with menus, sidebars, notices, adverts, forms, related links and comments), whose
labels are known because the layouts are built here.

Edge cases: null or empty html gives an empty text; markup that never closes is read to its end;
repeated rows are extracted each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvloom.llm.shipping import ship

TRAIN_PAGES = 240
EPOCHS = 6

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|title|textarea|template|svg|iframe|noframes|annotation)(?=[\s/>])[^>]*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][\w:-]*)(?P<attrs>(?:[^>=]|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>"
    r"|<[/!?a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr data picture source input math mi mn mo ms mtext mrow msub msup msubsup mfrac msqrt mroot mover munder munderover mstyle semantics mspace".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag here ends open elements of these kinds first, up to their container.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+")
_MARK = re.compile(r'data-main="([01])"')


@dataclass
class Node:
    """An element with its ancestors; equal paths share one node, over all pages."""

    tag: str
    features: frozenset[str]
    main: bool | None
    parent: Node | None
    children: dict[tuple[str, str], Node] = field(default_factory=dict)
    score: float | None = None

    def child(self, tag: str, attrs: str) -> Node:
        found = self.children.get((tag, attrs))
        if found is None:
            names = " ".join("".join(m) for m in _NAMES.findall(attrs)).lower()
            mark = _MARK.search(attrs)
            own = {f"tag {tag}", *(f"name {w}" for w in _WORDS.findall(names)), *(f"piece {w[i : i + 5]}" for w in _WORDS.findall(names) for i in range(max(1, len(w) - 4)))}
            found = Node(tag, self.features | own, self.main if mark is None else mark[1] == "1", self)
            if len(self.children) < 5000 and len(attrs) <= 4000:
                self.children[(tag, attrs)] = found
        return found


@dataclass
class Block:
    node: Node
    text: str
    linked: int


def blocks(page: str, root: Node) -> Iterator[Block]:
    """Leaf blocks with text, in page order."""
    path, parts, at, linked, in_link = [root], [], 0, 0, 0

    def flush() -> Iterator[Block]:
        nonlocal parts, linked
        if parts:
            text = "".join(parts)
            if "&" in text:
                text = html.unescape(text)
            if text := " ".join(text.split()):
                yield Block(path[-1], text, linked)
        parts, linked = [], 0

    for m in _MARKUP.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
            if in_link:
                linked += m.start() - at
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _INLINE:
            if tag == "a":
                in_link = not m["end"]
            continue
        if tag == "br":
            parts.append(" ")
            continue
        yield from flush()
        if m["end"]:
            for depth in range(len(path) - 1, 0, -1):
                if path[depth].tag == tag:
                    del path[depth:]
                    break
        else:
            if path[-1].tag == "p":
                path.pop()
            if tag in _ENDS:
                ended, within = _ENDS[tag]
                for depth in range(len(path) - 1, 0, -1):
                    if path[depth].tag in ended:
                        del path[depth:]
                        break
                    if path[depth].tag in within:
                        break
            if tag not in _VOID and not m["attrs"].endswith("/"):
                path.append(path[-1].child(tag, m["attrs"]))
    if at < len(page):
        parts.append(page[at:])
    yield from flush()


def root() -> Node:
    return Node("#", frozenset(), None, None)


def text_features(block: Block) -> tuple[str, ...]:
    text = block.text
    n = text.count(" ") + 1
    share = min(1.0, block.linked / len(text))
    return (
        f"words {min(9, int(math.log2(n)))}",
        f"links {int(share * 4)}",
        f"parent {block.node.tag}",
        "ends" if text[-1] in ".!?\"”»:…" else "open",
        f"digits {min(3, 8 * sum(c.isdigit() for c in text) // len(text))}",
        "copyright" if "©" in text or "all rights reserved" in text.lower() else "plain",
    )


@dataclass
class Field:
    """Weights of main text over the rest for each feature, and for pairs of neighbours."""

    weights: dict[str, float]
    pairs: list[list[float]]
    first: float

    def of_node(self, node: Node) -> float:
        if node.score is None:
            node.score = sum(self.weights.get(f, 0.0) for f in node.features)
        return node.score

    def emission(self, block: Block) -> float:
        weights = self.weights
        return self.of_node(block.node) + sum(weights.get(f, 0.0) for f in text_features(block))

    def decode(self, emissions: list[float]) -> list[int]:
        """The likeliest labels (Viterbi)."""
        if not emissions:
            return []
        (p00, p01), (p10, p11) = self.pairs
        zero, one, back = 0.0, emissions[0] + self.first, []
        for e in emissions[1:]:
            from0, from1 = (0 if zero + p00 >= one + p10 else 1), (0 if zero + p01 >= one + p11 else 1)
            zero, one = (zero + p00 if from0 == 0 else one + p10), (zero + p01 if from1 == 0 else one + p11) + e
            back.append((from0, from1))
        labels = [int(one > zero)]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]


def _log_add(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def train(pages: list[list[tuple[list[str], int]]], epochs: int = EPOCHS, rate: float = 0.3, ridge: float = 1e-4) -> Field:
    """Conditional likelihood by gradient steps over pages (each a list of features and label),
    with expectations from forward and backward sums."""
    weights: dict[str, float] = {}
    squares: dict[str, float] = {}
    model = Field(weights, [[0.0, 0.0], [0.0, 0.0]], 0.0)
    shuffled = random.Random(5)

    def step(name: str, slope: float) -> None:
        slope -= ridge * weights.get(name, 0.0)
        squares[name] = squares.get(name, 1e-2) + slope * slope
        weights[name] = weights.get(name, 0.0) + rate * slope / math.sqrt(squares[name])

    for _ in range(epochs):
        shuffled.shuffle(pages)
        for page in pages:
            n = len(page)
            if not n:
                continue
            emissions = [(0.0, sum(weights.get(f, 0.0) for f in names)) for names, _ in page]
            pairs = model.pairs
            forward = [(0.0, emissions[0][1] + model.first)]
            for e in emissions[1:]:
                a = forward[-1]
                forward.append(tuple(_log_add(a[0] + pairs[0][y], a[1] + pairs[1][y]) + e[y] for y in (0, 1)))
            backward = [(0.0, 0.0)]
            for e in reversed(emissions[1:]):
                b = backward[-1]
                backward.append(tuple(_log_add(pairs[x][0] + e[0] + b[0], pairs[x][1] + e[1] + b[1]) for x in (0, 1)))
            backward.reverse()
            total = _log_add(*forward[-1])
            slopes = [[0.0, 0.0], [0.0, 0.0]]
            for i, (names, y) in enumerate(page):
                expected = math.exp(min(0.0, forward[i][1] + backward[i][1] - total))
                if abs(y - expected) > 1e-4:
                    for name in names:
                        step(name, y - expected)
                if i:
                    slopes[page[i - 1][1]][y] += 1
                    for a in (0, 1):
                        for b in (0, 1):
                            slopes[a][b] -= math.exp(min(0.0, forward[i - 1][a] + pairs[a][b] + emissions[i][b] + backward[i][b] - total))
            for a in (0, 1):
                for b in (0, 1):
                    step(f"#{a}{b}", slopes[a][b])
                    model.pairs[a][b] = weights[f"#{a}{b}"]
    return model


# --- labelled pages ----------------------------------------------------------------------------

_MAIN = frozenset({"tag article", "tag main"})
_ASIDE = frozenset(
    [f"tag {t}" for t in "nav aside footer header form button select noscript menu dialog".split()]
    + [f"name {w}" for w in "ad ads advert advertisement banner sponsored promo comment comments sidebar footer header menu nav navigation related share social cookie notice newsletter subscribe breadcrumb breadcrumbs popup modal login search widget".split()]
)


def semantic_label(block: Block) -> int:
    """Main text by the page's own containers."""
    features = block.node.features
    return int(bool(features & _MAIN) and not features & _ASIDE)


def layouts(articles: list[list[str]], seed: int = 3) -> Iterator[str]:
    """Pages in other layouts around known articles; ``data-main`` marks what is main text."""
    r = random.Random(seed)
    filler = [w for a in articles for p in a for w in p.split()[:6]] or ["word"]
    some = lambda a, b: " ".join(r.choice(filler) for _ in range(r.randint(a, b)))
    pick = lambda *x: r.choice(x)

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{i}">{html.escape(some(1, 4))}</a></li>' for i in range(n))

    def rest(kind: str) -> str:
        text = html.escape(some(4, 40))
        return {
            "menu": f'<{(t := pick("nav", "div"))} class="{pick("menu", "nav", "navigation", "topnav", "navbar", "breadcrumbs", "pagination")}"><ul>{links(r.randint(3, 8))}</ul></{t}>',
            "bare": pick(f"<div>{html.escape(some(1, 3))}</div>", f"<p>{html.escape(some(2, 6))}</p>", f'<p><a href="/x">{html.escape(some(1, 3))}</a></p>'),
            "share": f'<{(t := pick("div", "ul"))} class="{pick("share", "sharebar", "share-buttons", "social", "social-links", "sharing", "follow-us", "socialmedia")}">{pick(html.escape(some(1, 3)), links(r.randint(2, 4)))}</{t}>',
            "header": f'<{(t := pick("header", "div"))} class="{pick("header", "site-header", "masthead")}"><div>{text}</div><p>{html.escape(some(2, 6))}</p></{t}>',
            "footer": f'<{(t := pick("footer", "div"))} class="{pick("footer", "site-footer", "bottom")}"><p>&copy; {text}</p></{t}>',
            "sidebar": f'<{(t := pick("aside", "div"))} class="{pick("sidebar", "related", "widget", "aside", "recommended", "trending", "side", "rail")}"><h3>{html.escape(some(1, 3))}</h3><ul>{links(5)}</ul><p>{text}</p></{t}>',
            "noscript": f"<noscript><p>{text}.</p></noscript>",
            "notice": f'<div class="{pick("cookie", "cookies", "consent", "gdpr", "notice", "banner", "popup", "alert", "newsletter", "subscribe", "paywall")}"><p>{text}.</p><button>{html.escape(some(1, 2))}</button></div>',
            "advert": f'<div class="{pick("ad", "advert", "ads", "sponsored", "promo", "adslot", "ad-container", "advertising", "sponsor", "banner")}">{pick("<p>", "")}{text}.</div>',
            "form": f'<form action="/s"><p>{html.escape(some(2, 9))}</p><label>{html.escape(some(1, 3))}</label><input name="q"><button>{html.escape(some(1, 2))}</button></form>',
            "comments": f'<{(t := pick("section", "div"))} {pick("id", "class")}="{pick("comments", "comment-list", "replies", "responses", "disqus-thread", "user-feedback", "discussion", "reader-comments", "feedback", "commentsection")}"><h3>{html.escape(some(1, 2))}</h3>' + "".join(f'<div class="{pick("comment", "reply", "item", "post")}">{pick("<p>", "")}{html.escape(some(5, 40))}.</div>' for _ in range(r.randint(1, 4))) + f"</{t}>",
        }[kind]

    for paragraphs in articles:
        inner = [f"<{(t := pick('p', 'p', 'p', 'div', 'blockquote', 'li'))}>{html.escape(p)}</{t}>" for p in paragraphs[1:]]
        if r.random() < 0.3:  # figures and tables are part of an article, short as their texts are
            cells = "".join(f"<td>{html.escape(some(1, 3))}</td>" for _ in range(4))
            inner.insert(r.randint(0, len(inner)), pick(f"<table><tr>{cells}</tr><tr>{cells}</tr></table>", f'<figure><img src="i"><figcaption>{html.escape(some(3, 9))}</figcaption></figure>', f"<h2>{html.escape(some(2, 5))}</h2>", f"<ul><li>{html.escape(some(2, 9))}</li><li>{html.escape(some(2, 9))}</li></ul>"))
        for _ in range(r.randint(0, 2)):
            inner.insert(r.randint(0, len(inner)), f'<div data-main="0">{rest(pick("advert", "sidebar", "notice", "form", "share"))}</div>')
        body = f"<h1>{html.escape(paragraphs[0])}</h1>" + "".join(inner)
        body += pick("", f'<div data-main="0">{rest("comments")}</div>')
        shell = pick("article", "main", "div", "div", "section", "td")
        name = pick("", ' class="content"', ' id="content"', ' class="post entry"', ' class="article-body"', ' id="main"', ' role="main"', ' class="story text"')
        main = f'<{shell}{name} data-main="1">{body}</{shell}>'
        before = [rest(k) for k in ("header", "menu", "notice", "advert", "form", "share", "bare") if r.random() < 0.5]
        after = [rest(k) for k in ("sidebar", "comments", "advert", "form", "menu", "share", "bare", "noscript") if r.random() < 0.5] + [rest("footer")]
        if shell == "td":
            before, after = ([f"<td>{x if r.random() < 0.7 else html.escape(some(1, 6))}</td>" for x in part] for part in (before, after))
            before[:1], after = [f"<table><tr>{''.join(before[:1])}"], [*after, "</tr></table>"]
        wrap = pick("", "div", 'div class="wrap"', 'div id="page"')
        page = "".join(before) + main + "".join(after)
        yield f"<html><body>{f'<{wrap}>{page}</div>' if wrap else page}</body></html>"


def learn(pages: list[str]) -> Field:
    """A field from sample pages: labelled as they are, and their articles in other layouts."""
    examples, articles = [], []
    for page in pages:
        found = list(blocks(page or "", root()))
        labels = [semantic_label(b) for b in found]
        if any(labels):
            examples.append([([*b.node.features, *text_features(b)], y) for b, y in zip(found, labels)])
            articles.append([b.text for b, y in zip(found, labels) if y])
    for page in layouts(articles or [["Title", "A sentence of some words, which ends here."]] * 40):
        examples.append([([*b.node.features, *text_features(b)], int(bool(b.node.main))) for b in blocks(page, root())])
    return train(examples)


def fit(pages: DataFrame, limit: int = TRAIN_PAGES) -> Field:
    # Only ids compete for a place; the pages of the ``limit`` ids that win are then fetched.
    chosen = pages.where("html is not null").select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(limit).distinct()
    sample = pages.where("html is not null").select("page_id", "html").join(F.broadcast(chosen), "page_id").limit(limit)
    return learn([r["html"] for r in sorted(sample.collect(), key=lambda r: r["page_id"])])


class Extractor:
    """Decodes pages with one field; paths seen before keep their scores."""

    def __init__(self, model: Field, known: int = 20_000):
        self.model, self.known, self.root, self.n = model, known, root(), 0

    def text(self, page: str) -> str:
        self.n += 1
        if self.n % self.known == 0:
            self.root = root()
        found = list(blocks(page, self.root))
        labels = self.model.decode([self.model.emission(b) for b in found])
        return " ".join(b.text for b, y in zip(found, labels) if y)


RESULT = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame, model: Field | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    ship(pages.sparkSession)
    model = model or fit(pages)

    def run(batches):
        extractor = Extractor(model)
        for batch in batches:
            texts = [extractor.text(page) if page else "" for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, RESULT)
