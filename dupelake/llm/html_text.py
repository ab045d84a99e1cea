"""Main text of web pages by tree scoring.

The page becomes a tree. Parts that are never article text (scripts, menus, headers and footers of the page, side bars, notices,
adverts, forms, comments of readers) are cut off by element, role and the words of class and id. Forms, roles and words only raise a doubt:
a node that holds an article and most of the page stays, and where nothing or little is left, the doubtful nodes around the best
container come back. Every paragraph then passes
points, one and more for commas and length, to its ancestors: all to its parent, half to the next, a third of a share beyond.
A container's points are discounted by its link density; the best one, raised to an enclosing article or main element, gives the
text together with those of its siblings that score or read like it. Block texts are joined in page order.

Defined cases: null or empty html, and pages without text, give an empty string; unclosed and stray tags are repaired, a page may
end anywhere; null ids and urls are kept; repeated rows give equal results; an empty table gives no rows; further columns of the
table are ignored. Work is linear in the length of a page, nothing is dropped for length.
"""

from __future__ import annotations

import html as _html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

# Element groups of the HTML standard (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template xmp iframe noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
                   "strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                     "header hgroup hr main menu nav ol p pre section table ul".split())
SAME_CLOSES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"),
               "th": ("tr", "table"), "option": ("select",)}

#: Parts that are not article text (chosen here).
CUT = frozenset("head script style noscript template nav footer aside button input select textarea iframe object svg canvas audio video "
                "dialog menu map".split())
#: Elements that are cut unless they hold the article, as by the words of class and id.
DOUBTFUL = frozenset("form label fieldset".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
CUT_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup "
    "modal overlay newsletter subscribe subscription signup signin login register sidebar side rail menu menus nav navbar navigation navigator breadcrumb breadcrumbs pager "
    "pagination footer foot masthead topbar comment comments commentlist disqus respond reply replies discussion share sharing social related "
    "recommended recommendations widget toolbar captcha search hidden skip legal copyright disclaimer paywall donate tags taglist".split())
#: Cut words that name the comments of readers, which may be longer than the article; words that say what stands beside a node.
READER_WORDS = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
BESIDE = frozenset("has have with without no not".split())
#: A second try counts if it gives so many times the text.
FAR = 3
GOOD_WORDS = frozenset("article content post entry story main body text page".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6 figcaption".split())

#: A comment, a declaration, a tag; a tag whose quotes do not match ends at the next ">". Searched up to the last ">" of a page only,
#: so that no "<" is followed to the end of the page more than once.
_TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/><]*+)((?:[^>\"'<]++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/><]*+)([^>]*+)>", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    __slots__ = ("tag", "parent", "kids", "cut", "points", "good", "post", "inside", "doubt", "all")

    def __init__(self, tag: str, parent: "Node | None", cut: bool = False, good: bool = False):
        self.tag, self.parent, self.cut, self.good = tag, parent, cut, good
        self.kids: list = []
        self.points, self.post = 0.0, False
        self.inside = parent is not None and (parent.inside or parent.post or parent.tag in ("article", "main"))
        self.doubt, self.all = 0, None  # 1: cut unless it holds the article, 2: comments of readers; kids with the doubtful ones


#: Words of class and id that name one article, so that a header inside is its title.
POST_WORDS = frozenset("article post entry story".split())


def _names(value: str) -> list[list[str]]:
    """The words of every name in a class or id, without what stands after ``BESIDE``: content with-sidebar is content."""
    out = []
    for name in value.split():
        words = [w.lower() for w in _WORD.findall(name)]
        out.append(words[:next((i for i, w in enumerate(words) if w in BESIDE), len(words))])
    return out


def _judge(tag: str, attrs: str, node: Node) -> tuple[bool, bool, bool, int]:
    """(is cut off, is a semantic container, is named as an article, is in doubt) of a new element under ``node``."""
    doubt = 1 if tag in DOUBTFUL else 0
    if tag in CUT:
        return True, False, False, 0
    if tag == "header":
        return not (node.inside or node.post or node.tag in ("article", "main")), False, False, 0
    semantic = tag in ("article", "main")
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return False, semantic, False, doubt
    got = {m[1].lower(): _html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attrs)}
    if "hidden" in got or got.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", got.get("style", "")):
        return True, False, False, 0
    semantic = semantic or got.get("role", "").lower() == "main" or got.get("itemprop", "").lower() == "articlebody"
    if tag in ("html", "body", "main"):
        return False, semantic, False, 0
    words = {w for key in ("class", "id") for name in _names(got.get(key, "")) for w in name}
    if got.get("role", "").lower() in CUT_ROLES:
        doubt = 1
    if words & CUT_WORDS:
        doubt = 2 if words & READER_WORDS else 1
    elif "header" in words and not words & GOOD_WORDS and tag not in ("h1", "h2", "h3"):
        doubt = 1
    return False, semantic, bool(words & (GOOD_WORDS if doubt else POST_WORDS)), doubt


def parse(page: str) -> Node:
    """The tree of a page; kids are nodes and strings."""
    root = node = Node("#root", None)
    open_count: dict[str, int] = {}
    low, at, end = None, 0, len(page)

    def pop_to(tag: str) -> None:
        nonlocal node
        while node.parent is not None:
            done, gone = node.tag == tag, node
            open_count[gone.tag] -= 1
            node = gone.parent
            if done:
                return

    last = page.rfind(">") + 1
    while at < end:
        m = _TOKEN.search(page, at, last)
        stop = m.start() if m else end
        if not m:  # what a page breaks off in: a comment or declaration
            stop = min((i for i in (page.find("<!", at), page.find("<?", at)) if i >= 0), default=end)
        text = page[at:stop]
        if text and not node.cut:
            node.kids.append(_html.unescape(text) if "&" in text else text)
        if not m or page.startswith("<!--", stop) and not m[0].endswith("-->"):
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if open_count.get(tag):
                pop_to(tag)
            elif tag == "br" and not node.cut:
                node.kids.append("\n")
            continue
        attrs = m[3] if m[2] else m[6]
        if tag in VOID:
            if tag in ("br", "hr", "img") and not node.cut:
                node.kids.append("\n" if tag == "br" else " " if tag == "img" else Node("hr", node))
            continue
        if tag in RAW:
            low = page.lower() if low is None else low
            stop = low.find("</" + tag, at)
            if stop < 0 or len(low) != end:
                again = re.compile("</" + tag, re.I).search(page, at)
                stop = again.start() if again else end
            close = page.find(">", stop)
            at = end if close < 0 else close + 1
            continue
        if tag in CLOSES_P and open_count.get("p"):
            up = node
            while up.tag in INLINE:
                up = up.parent
            if up.tag == "p":
                pop_to("p")
        if tag in SAME_CLOSES and open_count.get(tag):
            up = node
            while up.parent is not None and up.tag not in SAME_CLOSES[tag] and up.tag != tag:
                up = up.parent
            if up.tag == tag:
                pop_to(tag)
        cut, good, post, doubt = (True, False, False, 0) if node.cut else _judge(tag, attrs, node)
        child = Node(tag, node, cut, good)
        child.post, child.doubt = post, doubt
        if not cut:
            node.kids.append(child)
        node = child
        open_count[tag] = open_count.get(tag, 0) + 1
    return root


def _walk(top: Node):
    """Nodes under ``top`` in page order, parents first."""
    stack = [top]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(k for k in reversed(node.kids) if not isinstance(k, str))


def _measure(root: Node) -> dict[int, tuple[int, int, int]]:
    """id of a node -> (characters, characters inside links, links)."""
    order = list(_walk(root))
    got: dict[int, tuple[int, int, int]] = {}
    for node in reversed(order):
        n = linked = links = 0
        for k in node.kids:
            if isinstance(k, str):
                n += len(k.strip())
            else:
                a, b, c = got[id(k)]
                n, linked, links = n + a, linked + b, links + c
        got[id(node)] = (n, n, links + 1) if node.tag == "a" else (n, linked, links)
    return got


def _own_text(node: Node) -> str:
    """Text of a node and its inline descendants."""
    out, stack = [], list(reversed(node.kids))
    while stack:
        k = stack.pop()
        if isinstance(k, str):
            out.append(k)
        elif k.tag in INLINE:
            stack.extend(reversed(k.kids))
    return " ".join("".join(out).split())


def _blocks(top: Node, menus: set[int]) -> list[str]:
    """Texts of the blocks under ``top``, in page order; a run of text between two block elements is a block."""
    out: list[str] = []
    run: list[str] = []

    def close():
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            out.append(text)

    stack: list = [top]
    while stack:
        k = stack.pop()
        if k is None:
            close()
        elif isinstance(k, str):
            run.append(k)
        elif id(k) in menus:
            continue
        elif k.tag in INLINE:
            stack.extend(reversed(k.kids))
        else:
            close()
            stack.append(None)
            stack.extend(reversed(k.kids))
    close()
    return out


def _doubts(root: Node) -> tuple[list[Node], set[int]]:
    """Nodes with doubtful kids, and the ids of the doubtful nodes that stay: those with most of the page's text and an article in them."""
    order = list(_walk(root))
    above = [n for n in order if any(not isinstance(k, str) and k.doubt for k in n.kids)]
    if not above:
        return [], set()
    size, holds, held = _measure(root), {}, set()
    for node in reversed(order):
        inside = node.good or node.post or any(not isinstance(k, str) and holds[id(k)] for k in node.kids)
        n, linked, _ = size[id(node)]
        if node.doubt == 1 and inside and 2 * n >= size[id(root)][0] and 2 * linked < n:
            held.add(id(node))
        holds[id(node)] = inside and (not node.doubt or id(node) in held)
    for node in above:
        node.all = node.kids
    return above, held


def _keep(root: Node, above: list[Node], stays) -> None:
    """Put back the doubtful nodes that ``stays`` admits, and no others."""
    for node in above:
        node.kids = node.all
    for node in _walk(root):
        node.points = 0.0
    for node in above:
        node.kids = [k for k in node.all if isinstance(k, str) or not k.doubt or stays(k)]


def extract(page: str | None) -> str:
    """The main text of one page."""
    if not page or page.isspace():
        return ""
    root = parse(page)
    above, held = _doubts(root)
    if not above:
        return _main_text(root)[0]
    size = _measure(root)
    _keep(root, above, lambda k: id(k) in held)
    text = _main_text(root)[0]
    most = max((size[id(k)][0] for n in above for k in n.all if not isinstance(k, str) and k.doubt and id(k) not in held), default=0)
    for worst in (1, 2):  # comments of readers only if nothing else is left
        if text and (worst == 2 or most <= FAR * len(text)):
            break
        _keep(root, above, lambda k: k.doubt <= worst)
        again, best = _main_text(root)
        around = set(held)
        while best is not None:  # of the doubtful nodes only those around the best container
            around.add(id(best))
            best = best.parent
        if around - held:
            _keep(root, above, lambda k: id(k) in around)
            again = _main_text(root)[0]
        if not text or len(again) > FAR * len(text):
            text = again
    return text


def _main_text(root: Node) -> tuple[str, Node | None]:
    """The main text of a tree and the container that gave it."""
    size = _measure(root)
    density = lambda n: size[id(n)][1] / max(1, size[id(n)][0])
    menus = {id(n) for n in _walk(root) if n.tag in ("ul", "ol", "div", "table", "p", "section") and size[id(n)][2] >= 3 and density(n) > 0.6}
    scored: list[Node] = []
    for node in _walk(root):
        text = _own_text(node) if node.tag in PARAGRAPHS or node.tag in ("div", "section", "article", "main", "body") else ""
        if not text or node.tag not in PARAGRAPHS and len(text) < 25:
            continue
        points = (1 + text.count(",") + text.count("，") + text.count("、") + min(len(text) / 100, 3)) * (1 - density(node))
        if node.tag[0] == "h" or node.tag == "li":
            points *= 0.3
        up, share = (node.parent if node.tag in PARAGRAPHS else node), 1.0
        level = 1
        while up is not None and up.tag != "#root" and level < 6:
            if not up.points:
                scored.append(up)
            up.points += points * share
            level += 1
            up, share = up.parent, 0.5 if level == 2 else 1 / (3 * (level - 1))
    if not scored:
        return " ".join(_blocks(root, menus)), None
    best = max(scored, key=lambda n: n.points * (1 - density(n)))
    top = best.points * (1 - density(best))
    up = best
    while up is not None:
        if up.good:
            best = up
        up = up.parent
    parent = best.parent if best.parent is not None and best.tag not in ("body", "html") else None
    if parent is None:
        return " ".join(_blocks(best, menus)), best
    chosen = []
    for k in parent.kids:
        if isinstance(k, str):
            continue
        if k is best:
            chosen.append(k)
        elif id(k) in menus:
            continue
        elif not best.good and k.tag in ("h1", "h2", "h3"):
            chosen.append(k)
        elif k.points and k.points * (1 - density(k)) >= max(4.0, 0.2 * top) and k.tag == best.tag:
            chosen.append(k)
        elif k.tag == "p" and not best.good and density(k) < 0.25 and size[id(k)][0] > 80:
            chosen.append(k)
    return " ".join(t for k in chosen for t in _blocks(k, menus)), best


_OUT = StructType([StructField("page_id", LongType()), StructField("url", StringType()), StructField("text", StringType()), StructField("n_chars", LongType())])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [extract(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                                 names=_OUT.names)

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, _OUT)
