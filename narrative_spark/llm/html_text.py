"""Main text of web pages: boosted trees over DOM-node features and a hierarchical decoding."""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .runtime import bounded_arrow

# Fixed values of HTML: kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript noframes template iframe svg math title textarea select button object audio video canvas".split())
TEXT_ONLY = frozenset("script style title textarea iframe noscript noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Opening one of these closes an open element of the named kinds.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
HEAD_END = re.compile(r"</head\b|<body\b", re.I)
SPACE = re.compile(r"\s+")
#: Attribute values are cut into words at other characters and where the case rises.
SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")

# Attribute tokens that pages use for parts other than the article, and for the article.
ASIDE_TOKENS = frozenset(
    "ad ads advert advertisement adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer copyright legal sidebar aside rail widget related recommended more trending comment comments respond reply disqus discussion cookie consent notice alert gdpr popup modal overlay share sharing social follow subscribe newsletter signup login form search pagination pager toolbar tags meta byline skip hidden".split()
)
ARTICLE_TOKENS = frozenset("article content post entry story body main text articlebody postbody entrycontent maincontent page prose blog news read single".split())
TAGS = ("div", "p", "article", "main", "section", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "table", "blockquote", "figure", "#text")


class Node:
    __slots__ = ("tag", "parent", "children", "aside", "article", "depth", "text", "linked", "chars", "words", "tags", "marks", "leaves", "before", "keep", "mark")

    def __init__(self, tag: str, parent: "Node | None", aside: int = 0, article: int = 0):
        self.tag, self.parent, self.aside, self.article = tag, parent, aside, article
        self.children: list[Node] = []
        self.depth = parent.depth + 1 if parent else 0
        self.text = ""
        self.linked = self.chars = self.words = self.tags = self.marks = self.leaves = self.before = 0
        self.keep = self.mark = False
        if parent:
            parent.children.append(self)


def build_tree(page: str) -> Node:
    """Block elements and, as leaves, blocks of text. Scripts, styles, titles, comments and controls have no text.

    The tags of the head are passed over: it ends, as in HTML, at the first thing that can't stand in it, and what can
    has no text.
    """
    root = Node("#root", None)
    stack, inline, run, linked, depth_a = [root], 0, [], 0, 0
    at, skip, skip_depth = 0, None, 0
    places: dict[str, list[int]] = {}  # of the open elements of a name, where they are on the stack

    def last(name: str) -> int:
        return places[name][-1] if places.get(name) else 0

    def cut(k: int) -> None:
        for node in stack[k:]:
            places[node.tag].pop()
        del stack[k:]

    def flush() -> None:
        nonlocal run, linked, inline
        text = SPACE.sub(" ", entities.unescape("".join(run))).strip()
        if text:
            leaf = Node("#text", stack[-1])
            leaf.text, leaf.chars, leaf.words = text, len(text), text.count(" ") + 1
            leaf.linked, leaf.tags, leaf.leaves = min(linked, len(text)), inline, 1
            leaf.marks = sum(map(text.count, ".,;:!?"))
        run, linked, inline = [], 0, 0

    size = len(page)
    while at < size:
        m = TAG.search(page, at)
        end = m.start() if m else size
        if skip is None and end > at:
            piece = page[at:end]
            run.append(piece)
            if depth_a:
                linked += len(piece.strip())
        if not m:
            break
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name, closing = name.lower(), m[1] == "/"
        if skip is not None:
            if name == skip:
                skip_depth += -1 if closing else (0 if m[3].endswith("/") else 1)
                if skip_depth == 0:
                    skip = None
            if skip is not None:
                continue
            if closing:
                continue
        if name in RAW and not closing:
            if m[3].endswith("/"):
                continue
            if name in TEXT_ONLY:  # markup in it is text: on to its end tag
                close = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                late = None if close else HEAD_END.search(page, at)
                at = close.end() if close else late.start() if late else size
                run.append(" ")
                continue
            skip, skip_depth = name, 1
            run.append(" ")
            continue
        if name == "head":
            run.append(" ")
            continue
        if name in INLINE:
            inline += not closing
            if name == "a":
                depth_a = 0 if closing else 1
            if name == "br":
                run.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        flush()
        depth_a = 0
        if closing:
            if k := last(name):
                cut(k)
            continue
        if stack[-1].tag == "p" or stack[-1].tag in HEADINGS and name in HEADINGS:
            cut(len(stack) - 1)
        if name in CLOSES:
            k = max(map(last, CLOSES[name]))
            if k > max(map(last, STOPS[name])):
                cut(k)
        aside = article = 0
        if m[3] and "=" in m[3]:
            for key, *values in ATTRIBUTE.findall(m[3]):
                tokens = {t.lower() for v in values if v for t in SPLIT.split(v) if t}
                aside += len(tokens & ASIDE_TOKENS)
                article += len(tokens & ARTICLE_TOKENS)
        places.setdefault(name, []).append(len(stack))
        stack.append(Node(name, stack[-1], aside, article))
        stack[-1].mark = 'k="1"' in m[3]
    flush()
    return root


def nodes_of(root: Node) -> list[Node]:
    """All nodes in page order, with the sums of their subtrees."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(reversed(node.children))
    before = 0
    for node in order:
        node.before = before
        if node.tag == "#text":
            before += node.chars
    for node in reversed(order):
        if node.parent is not None:
            up = node.parent
            up.chars += node.chars
            up.words += node.words
            up.linked += node.linked
            up.tags += node.tags + (node.tag != "#text")
            up.marks += node.marks
            up.leaves += node.leaves
    return order


def node_features(order: list[Node]) -> list[list[float]]:
    """Density, attribute tokens, depth and statistics of siblings and ancestors, one row a node."""
    total = max(1, order[0].chars)
    most = max((c.chars for c in order if c.tag == "#text"), default=1)
    inherited: dict[int, tuple] = {}
    rows = []
    for node in order:
        up = node.parent
        bad, good, near = inherited[id(up)] if up is not None else (0, 0, 0)
        own_bad = node.aside + (node.tag in ("nav", "footer", "aside", "form", "menu", "dialog"))
        own_good = node.article + (node.tag in ("article", "main"))
        inherited[id(node)] = (bad + own_bad, good + own_good, own_bad if own_bad else near + (0 if not near else 1))
        siblings = up.children if up is not None else [node]
        around = max(1, sum(s.chars for s in siblings))
        alike = sum(1 for s in siblings if s.tag == node.tag)
        inner = node.chars or 1
        grand = up.parent if up is not None and up.parent is not None else up
        rows.append(
            [
                math.log1p(node.chars),
                math.log1p(node.words),
                node.linked / inner,
                node.tags / (node.words + 1),
                node.marks / (node.words + 1),
                node.chars / max(1, node.leaves),
                math.log1p(node.leaves),
                float(node.depth),
                float(len(node.children)),
                float(len(siblings)),
                alike / len(siblings),
                node.chars / around,
                node.before / total,
                node.chars / total,
                node.chars / most,
                float(own_bad),
                float(own_good),
                float(bad),
                float(good),
                float(node.tag in HEADINGS),
                float(up is not None and up.tag in HEADINGS),
                float(TAGS.index(node.tag)) if node.tag in TAGS else -1.0,
                float(TAGS.index(up.tag)) if up is not None and up.tag in TAGS else -1.0,
                up.linked / max(1, up.chars) if up is not None else 0.0,
                float(grand.aside if grand is not None else 0),
                *(float(node.tag == t) for t in ("p", "article", "nav", "footer", "header", "form", "aside", "li")),
            ]
        )
    return rows


def decode(order: list[Node], odds) -> None:
    """Keep or drop nodes so that the sum of log-likelihoods is greatest and no kept node is below a dropped one."""
    kept, dropped = {}, {}
    for node, o in zip(reversed(order), reversed(odds)):
        yes, no = -math.log1p(math.exp(-o)) if o > -30 else o, -math.log1p(math.exp(o)) if o < 30 else -o
        drop = sum(dropped[id(c)] for c in node.children)
        keep = sum(max(dropped[id(c)], kept[id(c)]) for c in node.children)
        kept[id(node)], dropped[id(node)] = yes + keep, no + drop
    for node in order:
        if node.parent is None:
            node.keep = True
        else:
            node.keep = node.parent.keep and kept[id(node)] > dropped[id(node)]


class PageModel:
    def __init__(self, trees: BoostedTrees):
        self.trees = trees

    def extract(self, pages: list[str | None]) -> list[str]:
        import numpy as np

        orders, rows = [], []
        for page in pages:
            order = nodes_of(build_tree(page or ""))
            orders.append(order)
            rows.extend(node_features(order))
        odds = np.clip(self.trees.log_odds(np.asarray(rows)), -25, 25).tolist() if rows else []
        out, at = [], 0
        for order in orders:
            decode(order, odds[at : at + len(order)])
            at += len(order)
            out.append("\n\n".join(n.text for n in order if n.tag == "#text" and n.keep))
        return out


# ---- training pages


class _Random(random.Random):
    """Also how long a page's sentences are."""

    run = (3, 16)


def _words(r: _Random, n: int) -> str:
    make = lambda: "".join(r.choice(("ba", "re", "ti", "on", "es", "la", "mo", "su", "der", "an", "the", "qui")) for _ in range(r.randint(1, 4)))
    out = []
    while n > 0:
        k = min(n, r.randint(*r.run))
        out.append(" ".join(make() for _ in range(k)).capitalize() + r.choice(".....!?,;"))
        n -= k
    return " ".join(out)


def training_page(r: _Random) -> str:
    """A page of random layout. Elements of the article carry the attribute ``k``; its value isn't a feature."""
    plain = r.random() < 0.25  # no helpful attributes at all
    r.run = r.choice(((3, 16), (3, 16), (2, 6), (20, 60), (200, 300)))

    def attr(*names: str) -> str:
        return "" if plain or r.random() < 0.15 else f' {r.choice(("class", "id"))}="{r.choice(names)}"'

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{i}">{_words(r, r.randint(1, 4))[:-1]}</a></li>' for i in range(n))

    def aside() -> str:
        kind = r.randrange(9)
        box = r.choice(("div", "aside", "section"))
        long = _words(r, r.choice((4, 12, 30, 80)))
        if kind == 0:
            return f"<{box}{attr('ad', 'ads', 'advert', 'sponsored', 'ad-banner')}>{r.choice((long, f'<p>{long}</p>'))}</{box}>"
        if kind == 1:
            return f"<{box}{attr('sidebar', 'related', 'widget', 'trending')}><h3>{_words(r, 2)}</h3><ul>{links(r.randint(2, 9))}</ul></{box}>"
        if kind == 2:
            return f"<div{attr('cookie-notice', 'notice', 'alert', 'consent')}><p>{long}</p><button>OK</button></div>"
        if kind == 3:
            return f"<form{attr('newsletter', 'subscribe', 'search')}><label>{_words(r, 4)}</label><input><p>{_words(r, 9)}</p><button>Go</button></form>"
        if kind == 4:
            return f"<div{attr('share', 'social')}>" + "".join(f'<a href="#">{_words(r, 1)}</a> ' for _ in range(4)) + "</div>"
        if kind == 5:
            return f"<nav{attr('menu', 'breadcrumbs')}>" + " / ".join(f'<a href="#">{_words(r, 1)}</a>' for _ in range(r.randint(2, 6))) + "</nav>"
        if kind == 6:
            return f"<aside><h4>{_words(r, 3)}</h4><p>{long}</p></aside>"
        if kind == 7:
            return f"<script>var a = '<p>{_words(r, 5)}</p>';</script>"
        return f"<div{attr('promo', 'banner', 'meta', 'byline')}>{_words(r, r.randint(2, 12))}</div>"

    def block() -> str:
        kind = r.randrange(14)
        text = _words(r, r.choice((1, 3, 8, 20, 40, 90, 150)))
        if kind < 8:
            if r.random() < 0.2:
                text = f"<b>{text}<br>" if r.random() < 0.5 else text.replace(" ", f' <a href="/x">{_words(r, 2)}</a> ', 1)
            return f'<p k="1">{text}' + ("</p>" if r.random() < 0.8 else "")
        if kind == 8:
            return f'<h2 k="1">{_words(r, r.randint(1, 7))}</h2>'
        if kind == 9:
            return '<ul k="1">' + "".join(f'<li k="1">{_words(r, r.randint(2, 25))}</li>' for _ in range(r.randint(2, 6))) + "</ul>"
        if kind == 10:
            return f'<blockquote k="1"><p k="1">{text}</p></blockquote>'
        if kind == 11:
            return f'<div k="1">{text}</div>'
        if kind == 12:
            return f'<pre k="1">{text}</pre>'
        return '<table k="1">' + "".join(f'<tr k="1"><td k="1">{_words(r, 2)}</td><td k="1">{_words(r, 3)}</td></tr>' for _ in range(3)) + "</table>"

    body = []
    for _ in range(r.choice((1, 2, 3, 5, 8, 14, 25))):
        body.append(block())
        if r.random() < 0.06:
            body.append(aside())
    title = f'<h1 k="1">{_words(r, r.randint(1, 12))}</h1>'
    if r.random() < 0.2:
        title = f'<header k="1">{title}</header>'
    inside = title + "".join(body)
    if r.random() < 0.35:
        inside = title + f'<div k="1"{attr("article-body", "content", "entry-content", "text")}>' + "".join(body) + "</div>"
    box = r.choice(("article", "article", "main", "div", "section"))
    main = f'<{box} k="1"{attr("post", "article", "content", "story", "main-content")}>{inside}</{box}>'
    if r.random() < 0.5:
        deep = f"<{r.choice(('ul', 'ol'))}>" if r.random() < 0.1 else ""
        said = "".join(f"<{r.choice(('div', 'li', 'article'))}{attr('comment', 'reply')}><b>{_words(r, 1)}</b><p>{_words(r, r.choice((3, 10, 30, 70)))}</p></div>" for _ in range(r.randint(1, 6)))
        comments = f"<{r.choice(('section', 'div'))} {r.choice(('id', 'class'))}=\"{r.choice(('comments', 'discussion', 'respond', 'comment-list'))}\"><h3>{_words(r, 2)}</h3>{deep}{said}</section></div>"
    else:
        comments = ""
    top = r.choice(("nav", "header", "div"))
    head = f"<{top}{attr('menu', 'header', 'navbar', 'masthead')}><ul>{links(r.randint(2, 9))}</ul></{top}>" if r.random() < 0.9 else f"<header>{_words(r, 3)}<nav>{links(4)}</nav></header>"
    foot = r.choice(("footer", "div"))
    tail = f"<{foot}{attr('footer', 'copyright', 'legal')}>&copy; {_words(r, r.randint(2, 20))}</{foot}>"
    middle = [aside() for _ in range(r.choice((0, 1, 1, 2, 3)))]
    after = [aside() for _ in range(r.choice((0, 0, 1, 2)))]
    rest = "".join(middle) + main + "".join(after) + comments
    if r.random() < 0.4:
        rest = f'<div k="1"{attr("page", "wrapper", "container")}>{rest}</div>'
    return f'<html><head><title>{_words(r, 5)}</title><style>p {{}}</style></head><body k="1">{head}{rest}{tail}</body></html>'


def _marked_tree(page: str) -> tuple[list[Node], list[int]]:
    """The nodes of a training page and whether they hold article text."""
    order = nodes_of(build_tree(page))
    return order, [int((n.mark if n.tag != "#text" else n.parent.mark) and n.chars > 0) for n in order]


def structural_labels(order: list[Node]) -> list[int] | None:
    """Labels of a page that has one <article> or <main>: all text in it but for parts that say they are others."""
    mains = [n for n in order if n.tag == "article"] or [n for n in order if n.tag == "main"]
    if len(mains) != 1:
        return None
    inside, hold = set(), set()
    for node in order:
        if node is mains[0] or (node.parent is not None and id(node.parent) in inside and not node.aside and node.tag not in ("nav", "aside", "form", "footer")):
            inside.add(id(node))
    up = mains[0]
    while up is not None:
        hold.add(id(up))
        up = up.parent
    return [int((id(n) in inside or id(n) in hold) and n.chars > 0) for n in order]


def fit(pages: DataFrame | None = None, made: int = 600, sample: int = 150, most_bytes: int = 40_000, seed: int = 7) -> PageModel:
    """A model of ``made`` generated pages and of ``sample`` pages of the table whose own structure labels them.

    The sample has the pages with the least hash of id and markup among those of at most ``most_bytes``; the three
    parameters bound it at any size of the table. Which pages it has doesn't depend on how the table is cut.
    """
    import numpy as np

    r = _Random(seed)
    rows, labels = [], []
    for _ in range(made):
        order, own = _marked_tree(training_page(r))
        rows.extend(node_features(order))
        labels.extend(own)
    if pages is not None and sample:
        n = pages.count()  # of the files' footers; with it one scan finds the sample
        place = F.xxhash64("page_id", "html")
        some = pages.where((F.octet_length("html") <= most_bytes) & (F.pmod(place, F.lit(max(1, n))) < 2 * sample)).select("html", place.alias("place"))
        for page in some.orderBy("place", "html").limit(sample).collect():
            order = nodes_of(build_tree(page.html))
            own = structural_labels(order)
            if own:
                rows.extend(node_features(order))
                labels.extend(own)
    return PageModel(BoostedTrees().fit(np.asarray(rows), np.asarray(labels, dtype=float)))


def extract_pages(pages: DataFrame, model: PageModel | None = None) -> DataFrame:
    """``(page_id, url, text, n_chars)``, one per input row.

    Blocks of the article in page order, joined by two line feeds; white space in a block is one space. Null and empty
    pages, and those without an article, have an empty text. Cut and badly nested markup is read as far as it goes.
    Repeated rows are extracted each; extra columns are ignored.
    """
    spark = pages.sparkSession
    bounded_arrow(spark)
    shared = spark.sparkContext.broadcast(model or fit(pages))  # bounded by fit's parameters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = shared.value.extract(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"]
                )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
