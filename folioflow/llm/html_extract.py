"""Main text of HTML pages by minimum-cut labelling.

A page is read into blocks: runs of text between block-level tags, each with the chain of
elements it stands in. A fitted classifier (html_classifier) turns the features of a block (its
words, its share of linked text, names of its elements, classes and ids, its place in the
page) into the log-odds that it is content. These are capacities from the source or to
the sink; neighbouring blocks, and blocks under the same container, are joined by edges
that make it costly to label them differently. The minimum cut labels all blocks at once.

Pages are independent of each other, so this is one pass without a shuffle.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_classifier import fitted

#: Element names of HTML.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements whose text is never displayed as text, or belongs to the controls of a form.
UNSEEN = frozenset("script style title textarea iframe noembed noframes template head noscript canvas audio video select datalist option annotation annotation-xml desc metadata defs".split())
#: Elements whose text leads elsewhere or does something.
LINKS = frozenset(("a", "button"))
#: Elements that a start tag of the given name ends, if they are open in the same container.
ENDS_P = BLOCKS - frozenset("li dd dt td th tr tbody thead tfoot option optgroup legend caption summary body html".split())
ENDS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
SCOPES = frozenset("ul ol dl table div article section main aside nav header footer form body blockquote figure details menu".split())
#: Elements that hold the whole page: a class there says nothing against its content.
WHOLE = frozenset("html body main".split())
HEADS = frozenset("h2 h3 h4 h5 h6".split())
#: Words of names (of classes, ids) that boilerplate has, those that content has as well, and words of layout.
STRONG = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox adslot sponsor sponsored promo promos promotion banner cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe paywall signup login "
    "sidebar widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs toolbar topbar masthead footer colophon comment comments commentlist respond replies disqus related recommended recommendations trending teaser teasers outbrain taboola pagination pager".split()
)
WEAK = frozenset("side header head foot legal copyright disclaimer discussion reply more readmore popular promoted share sharing social follow tag tags skip search form byline meta hidden print subscription crumbs aside".split())
LAYOUT = frozenset("box slot wrapper wrap container block area list item items bar unit section top bottom left right inner outer main primary secondary content col row panel group holder zone region site page global mobile desktop sticky fixed link links title heading text body post posts article thread read".split())
GOOD = frozenset("article story entry post content main body text prose maincontent copy".split())
FORMS = frozenset("form fieldset search dialog label legend".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
#: What is known of an element or one of its ancestors.
FLAGS = ("article", "main", "nav", "footer", "header", "aside", "form", "bad", "bad in part", "doubtful", "doubtful in part", "good", "bad role", "good role", "nested")
BIT = {name: 1 << i for i, name in enumerate(FLAGS)}
#: A quote delimits only where an attribute's value begins; elsewhere it is a letter like others, also if its partner is missing.
QUOTED = r"(?>[\s/]+|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?>\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*+)?)?)*+"
TOKEN, PLAIN = (re.compile(rf"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|</?([a-zA-Z][^\s/>]*)({body})>|<(?=/?[a-zA-Z])", re.S) for body in (QUOTED, "[^>]*"))
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACE = re.compile(r"\s+")
WITH = re.compile(r"(?<![a-z])(has|with|no|without|is|show|hide)[-_][a-z]+")
UNUSED = re.compile(r"[^a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Element:
    """An open or closed element, with what its ancestors tell, so that nobody has to walk up to them.

    flags: of it and its ancestors; unseen: likewise; block, box: the nearest block-level element and the
    nearest scope, itself included; inner: how many elements of each name are open within its scope.
    """

    __slots__ = ("block", "box", "flags", "inner", "name", "parent", "unseen")

    def __init__(self, name: str, parent: Element | None, flags: int = 0, unseen: bool = False):
        self.name, self.parent, self.flags, self.unseen = name, parent, flags, unseen
        self.block = self if parent is None or name in BLOCKS else parent.block
        scope = parent is None or name in SCOPES
        self.box = self if scope else parent.box
        self.inner: Counter = Counter() if scope else parent.inner


@dataclass
class Block:
    owner: Element
    text: str = ""
    linked: int = 0
    parts: list[str] = field(default_factory=list)


def of_name(value: str) -> int:
    """What one class or id says. A word that boilerplate has says less beside words that it does not have."""
    words = [w for w in UNUSED.split(value) if w]
    kinds = [w in STRONG for w in words], [w in WEAK for w in words]
    known = all(a or b or w in LAYOUT or len(w) < 2 for w, a, b in zip(words, *kinds, strict=True))
    if any(kinds[0]):
        return BIT["bad"] if known else BIT["bad in part"]
    if any(kinds[1]):
        return BIT["doubtful"] if known else BIT["doubtful in part"]
    return BIT["good"] if any(w in GOOD for w in words) else 0


@functools.lru_cache(maxsize=20_000)
def said(name: str, attributes: str) -> tuple[int, bool]:
    """What an element's name and attributes say for or against content, and whether it is not displayed."""
    flags, hidden = 0, False
    if name in ("article", "main", "footer", "header", "aside"):
        flags = BIT[name]
    elif name in ("nav", "menu"):
        flags = BIT["nav"]
    elif name in FORMS:
        flags = BIT["form"]
    if attributes.strip(" /"):
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                for one in WITH.sub("", CAMEL.sub("-", value).lower()).split():
                    got = of_name(one)
                    if name not in WHOLE and (name != "article" or got == BIT["bad"]) or got == BIT["good"]:
                        flags |= got
            elif key == "role":
                role = value.lower()
                flags |= BIT["bad role"] if role in BAD_ROLES else BIT["good role"] if role in ("main", "article") else 0
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                hidden = True
    return flags, hidden


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order; text that is never displayed is left out."""
    root = Element("#root", None)
    at, found, block = root, [], None
    open_links = 0
    total: Counter = Counter()  # how many elements of each name are open

    def text(raw: str, decoded: bool = False) -> None:
        nonlocal block
        if not raw or at.unseen:
            return
        if block is None:
            if not raw.strip():
                return
            block = Block(at.block)
            found.append(block)
        plain = raw if decoded else html.unescape(raw)
        block.parts.append(plain)
        if open_links:
            block.linked += len(plain.strip())

    def opened(child: Element) -> None:
        nonlocal at, open_links
        at = child
        total[child.name] += 1
        if child.name not in SCOPES:
            child.inner[child.name] += 1
        open_links += child.name in LINKS

    def close(until: Element) -> None:
        nonlocal at, open_links
        while at is not until and at.parent:
            total[at.name] -= 1
            if at.name not in SCOPES:
                at.inner[at.name] -= 1
            open_links -= at.name in LINKS
            at = at.parent

    def nearest(names: frozenset[str] | set[str] | tuple[str, ...]) -> Element:
        """The innermost open element of some names, of which there is one."""
        up = at
        while up.name not in names:
            up = up.parent
        return up

    position, hidden_ends = 0, 0
    while m := TOKEN.search(page, position):
        if m[1] is None and m[0] == "<":  # quotes hide the end of this tag: it ends at the next '>'
            hidden_ends += 1
            m = (PLAIN.match(page, m.start()) if ">" in page[m.end() : m.end() + 10_000] or page.find(">", m.end()) >= 0 else None) or m
        text(page[position : m.start()])
        position = m.end()
        if m[1] is None:
            if m[0] == "<":  # a tag that never ends: the rest of the page
                position = len(page)
            continue
        if hidden_ends > MOST_HIDDEN:  # quotes are of no use on this page
            return blocks(page.translate(NO_QUOTES))
        name = m[1].lower()
        if m[0].startswith("</"):
            if name in BLOCKS:
                block = None
            if total[name] if name in BLOCKS else at.inner[name]:
                close(nearest((name,)).parent)
            continue
        if name == "br" or name == "wbr" or name in VOID and name != "hr":
            if block is not None and name == "br":
                block.parts.append(" ")
            continue
        if name in BLOCKS:
            block = None
            ends = set(ENDS.get(name, ()))
            if name in ENDS_P:
                ends.add("p")
            if name in HEADS or name == "h1":
                ends |= {*HEADS, "h1"}
            while any(at.inner[n] for n in ends):
                close(nearest(ends).parent)
        if name == "hr":
            continue
        flags, hidden = said(name, m[2])
        nested = BIT["nested"] if name == "article" and at.flags & BIT["article"] else 0
        child = Element(name, at, at.flags | flags | nested, at.unseen or hidden or name in UNSEEN)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, position)
            begin, position = position, end.start() if end else len(page)
            if name == "xmp":  # shown as it is written
                text(page[begin:position], decoded=True)
            if end:
                position = (page.find(">", position) + 1) or len(page)
            continue
        if m[2].rstrip().endswith("/") and name not in BLOCKS:
            continue
        opened(child)
    text(page[position:])
    for b in found:
        b.text = SPACE.sub(" ", "".join(b.parts)).strip()
    return [b for b in found if b.text]


#: Tags of a page whose end may be hidden by quotes before all its quotes are read as letters, so that time stays linear.
MOST_HIDDEN = 20
NO_QUOTES = {0x22: "\u2033", 0x27: "\u2032"}
#: Log-odds beyond which a block is as certain as can be, so that its neighbours may still outvote it.
MOST = 7.0
COPYRIGHT = re.compile(r"(©|\(c\)|copyright\b|all rights reserved)", re.I)
#: What short lines above lists of other articles, readers' comments and the like say.
ELSEWHERE = re.compile(
    r"\b(you (may|might|will) (also |like )|also like|related (posts?|stories|articles|content|reading|topics)|recommended|more (from|stories|on this|like this|in )|read (next|more|also)|up next|see also|most (read|popular|viewed)|trending|popular (now|posts|stories)|"
    r"editors?'?s? picks?|latest (news|posts|stories)|around the web|from the web|elsewhere on|don't miss|what to read|share this|follow us|(\d+ )?(comments?|responses|replies)( \(?\d+\)?)?$|leave a (reply|comment)|join the (conversation|discussion)|what do you think|add a comment|post a comment|thoughts on)",
    re.I,
)
#: What lines beside a reader's comment say.
REMARK = re.compile(r"\b(reply|report( abuse)?|permalink|upvote|like \(?\d+\)?)$|\b\d+ (s|sec(ond)?|min(ute)?|h(ou)?r?|d(ay)?|w(ee)?k|mo(nth)?|y(ea)?r)s? ago\b|\b(says|said|wrote|writes):$|\bat \d{1,2}:\d\d( ?[ap]m)?\b", re.I)
SHORT = 12


def shadows(found: list[Block]) -> list[bool]:
    """Whether each block stands below a line that announces other articles or comments, in the container of that line or within it, up to the next heading there."""
    out, under = [], {}
    for b in found:
        box, way = b.owner.box, []
        while id(box) not in under and box.parent:
            way.append(box)
            box = box.parent.box
        known = under.get(id(box), False)
        for inner in way:
            under[id(inner)] = known
        box = b.owner.box
        if len(b.text) < 80 and len(b.text.split()) <= SHORT and ELSEWHERE.search(b.text):
            under[id(box)] = True
        elif b.owner.name == "h1" or b.owner.name in HEADS and b.owner.parent is box:
            under[id(box)] = False
        out.append(under.get(id(box), False))
    return out


def remarks(found: list[Block]) -> tuple[list[bool], list[bool]]:
    """Whether each block is a line beside a comment, and whether it stands in one of several containers, side by side, with such lines."""
    line = [len(b.text) < 80 and len(b.text.split()) <= SHORT and REMARK.search(b.text) is not None for b in found]
    beside, holds = Counter(), set()
    for b, is_line in zip(found, line, strict=True):
        box = b.owner.box
        if is_line and box.parent and id(box) not in holds:
            holds.add(id(box))
            beside[id(box.parent.box)] += 1
    return line, [b.owner.box.parent is not None and id(b.owner.box) in holds and beside[id(b.owner.box.parent.box)] > 1 for b in found]


def features(page: str) -> tuple[list[Block], np.ndarray]:
    """The blocks of a page and a row of features for each."""
    found = blocks(page)
    total = sum(len(b.text) for b in found)
    marked = any(b.owner.flags & (BIT["article"] | BIT["main"] | BIT["good"]) for b in found)
    first = next((i for i, b in enumerate(found) if b.owner.name == "h1"), -1)
    shadow, (line, beside) = shadows(found), remarks(found)
    out = []
    for i, b in enumerate(found):
        flags, name = b.owner.flags, b.owner.name
        words = len(b.text.split())
        inside = bool(flags & (BIT["article"] | BIT["main"] | BIT["good"]))
        out.append(
            (
                1.0,
                min(5.0, math.log1p(words)),
                min(1.0, b.linked / len(b.text)),
                b.text[-1] in ".!?\"'”»…",
                name == "h1",
                name in HEADS,
                name == "li",
                bool(COPYRIGHT.match(b.text)),
                math.log(len(b.text) / total),
                marked and not inside,
                i < first,
                bool(flags & BIT["header"]) and inside,
                shadow[i],
                line[i],
                beside[i],
                inside * min(1.0, b.linked / len(b.text)),
                inside and name == "li",
                *(bool(flags & bit) for bit in BIT.values()),
            )
        )
    return found, np.array(out, dtype=float).reshape(-1, 17 + len(FLAGS))


#: The cost of a border between neighbours of one container, of a container and one within, of others; and between a container's successive blocks that are no neighbours.
SAME, WITHIN, OTHER, APART = 3.0, 1.2, 0.3, 1.5


def links(found: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: neighbours, the more so the nearer they stand in the tree, and successive blocks of one container."""
    out, last = [], {}
    for i, block in enumerate(found):
        own = block.owner.box
        if i:
            other = found[i - 1].owner.box
            near = SAME if own is other else WITHIN if own.parent is other or other.parent is own else OTHER
            out.append((i - 1, i, near))
        if (before := last.get(id(own))) is not None and before != i - 1:
            out.append((before, i, APART))
        last[id(own)] = i
    return out


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """For each node whether it lies on the source's side of a minimum cut (Dinic's algorithm: levels, then blocking flows)."""
    n = len(source)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def add(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(forth)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i in range(n):
        through = min(source[i], sink[i])  # this flow is certain
        if source[i] > through:
            add(s, i, source[i] - through, 0.0)
        if sink[i] > through:
            add(i, t, sink[i] - through, 0.0)
    for a, b, w in edges:
        add(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        used = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                path, a = [], s
                continue
            while used[a] < len(out[a]):
                e = out[a][used[a]]
                if cap[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    break
                used[a] += 1
            if used[a] < len(out[a]):
                path.append(e)
                a = to[e]
            elif path:
                level[a] = -1
                a = to[path.pop() ^ 1]
            else:
                break


def label(found: list[Block], odds: np.ndarray) -> list[bool]:
    """Which blocks are content. source: the cost of calling a block boilerplate; sink: of calling it content."""
    odds = np.clip(odds, -MOST, MOST).tolist()
    return minimum_cut([max(0.0, x) for x in odds], [max(0.0, -x) for x in odds], links(found))


def main_text(page: str | None, weights: tuple[float, ...] | None = None) -> str:
    """The content blocks of a page, in order, joined by a blank line."""
    found, x = features(page or "")
    if not found:
        return ""
    odds = x @ np.array(weights or fitted(features))
    return "\n\n".join(b.text for b, is_content in zip(found, label(found, odds), strict=True) if is_content)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    A null or empty html, or a page without content, has an empty text. Rows are
    independent, so repeated rows and null ids need no rule; other columns are not read;
    an empty table gives no rows.
    """

    weights = fitted(features)  # on the driver, a few numbers

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(x, weights) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", F.coalesce(F.col(html_col), F.lit("")).alias("html")).mapInArrow(rows, "page_id long, url string, text string, n_chars long")
