"""The classifier of html_extract: logistic regression over features of blocks, fitted here.

It is fitted on the blocks of pages that are made from a grammar of page parts, which
knows what is content: articles in wrappers of all kinds (or in none), menus, headers,
footers, sidebars, notices, adverts, forms, lists of links and readers' comments, some inside the
article, some without any telling name; with names that mislead in both directions, articles that are lists of
links, and texts of all lengths. Their number is
bounded (PAGES) and does not depend on the pages to extract.
"""

from __future__ import annotations

import functools
import random
from collections.abc import Callable

import numpy as np

#: Pages of the training set, and the seed that makes them.
PAGES, SEED = 700, 11
RIDGE = 0.3
STEMS = "ba co de fi gu ha in jo ka lo me no or pa qu ri se ta un vi wo xa ye zo ment tion er al ou".split()

CONTENT_NAMES = "post entry-content story article-body content main text post-body entry story-text articleBody prose page-content body-copy".split()
PLAIN_NAMES = "wrapper row col-8 c17 x-box inner grid-12 outer stack l-main-2 css-1q2w3e block-7".split()
#: Names that content has although a part of them is one of boilerplate's words.
MISLEADING = "social-history share-price-table more print-era side-effects commentary comment-on-law header-text search-for-meaning meta-analysis form-and-function legal-history related-work-section follow-up head tag-team ad-hoc-notes banner-of-war menu-of-the-day login-shell-guide".split()
PARTS = {
    "menu": ("nav", "div class=nav", "ul class=menu", "div id=navigation", "div class=navbar", "div role=navigation", "div class=breadcrumbs", "div class=top-menu", "div"),
    "header": ("header", "div class=masthead", "div id=header", "div class=site-header", "header class=top"),
    "footer": ("footer", "div class=footer", "div id=footer", "div role=contentinfo", "div class=site-footer", "section class=colophon"),
    "side": ("aside", "div class=sidebar", "div id=side", "div class=widget", "div class=related-posts", "div role=complementary", "section class=recommended", "div class=right-sidebar"),
    "notice": ("div class=cookie-notice", "div role=alert", "dialog", "div class=gdpr-consent", "div id=cookies", "div class=notice", "div class=alert-box", "p class=notice"),
    "advert": ("div class=ad", "div class=advert", "div id=ad-slot-3", "div class=sponsored", "section class=promo", "div class=banner", "aside class=ad-box", "p class=advertisement"),
    "form": ("form", "div class=newsletter", "form class=signup", "div class=subscribe-box", "fieldset"),
    "comments": ("section id=comments", "div class=comments", "div class=comment-list", "div id=disqus_thread", "ol class=commentlist", "div class=comment-section", "div id=respond"),
    "links": ("ul class=share", "div class=social", "ul class=tags", "div class=pagination", "ul class=social-links", "div class=read-more", "ul"),
}

#: What stands above other articles and above comments where no name tells.
ABOVE_LINKS = ("You may also like", "You might also like", "Related posts", "Related stories", "More from this author", "Read next", "Most popular", "Recommended for you", "More stories", "See also", "Trending now", "Up next", "Share this")
ABOVE_COMMENTS = ("Comments", "3 Comments", "12 responses", "Leave a reply", "Join the discussion", "What do you think?", "Comments (4)", "Post a comment")


class Writer:
    """Makes pages; every block's text begins with a mark that says whether it is content. hard: also parts without telling names, and articles that are lists of links."""

    def __init__(self, rng: random.Random, hard: bool = True):
        self.rng, self.hard = rng, hard

    def words(self, n: int) -> str:
        r = self.rng
        return " ".join("".join(r.choice(STEMS) for _ in range(r.randint(1, 3))) + ("," if r.random() < 0.05 else "") for _ in range(n))

    def prose(self, low: int = 3, high: int = 120) -> str:
        r = self.rng
        n = round(low * (high / low) ** r.random())
        return self.words(n).capitalize() + (r.choice(".....!?") if r.random() < 0.85 else "")

    def block(self, content: bool, inner: str, tag: str, name: str = "") -> str:
        return f"<{tag}{name}>{'C' if content else 'B'} {inner}</{tag}>"

    def link(self, n: int = 2) -> str:
        return f"<a href=/{self.rng.randrange(99)}>{self.words(self.rng.randint(1, n))}</a>"

    def wrapped(self, inner: str, opening: str) -> str:
        name, _, rest = opening.partition(" ")
        key, _, value = rest.partition("=")
        return f'<{name}{f" {key}={chr(34)}{value}{chr(34)}" if rest else ""}>{inner}</{name}>'

    def part(self, kind: str) -> str:
        r = self.rng
        if kind in ("menu", "links"):
            item = r.choice(("li", "li", "p", "div"))
            inner = "".join(f"<{item}><a href=/x>B {self.words(r.randint(1, 3))}</a></{item}>" for _ in range(r.randint(2, 7)))
        elif kind == "comments":
            inner = "".join(self.block(False, self.prose(4, 60), r.choice(("p", "p", "div", "li"))) for _ in range(r.randint(1, 5)))
            if r.random() < 0.4:
                inner = self.block(False, "Comments", "h2") + inner
            if r.random() < 0.3:
                inner = f'<article class="comment">{inner}</article>'
        elif kind == "footer":
            inner = self.block(False, ("&copy; 2020 " if r.random() < 0.5 else "") + self.prose(3, 40), r.choice(("p", "div")))
        elif kind == "header":
            inner = self.block(False, self.prose(2, 12), r.choice(("p", "div", "h2"))) + (f"<p><a href=/>B {self.words(2)}</a></p>" if r.random() < 0.5 else "")
        elif kind == "form":
            inner = self.block(False, self.prose(3, 25), r.choice(("p", "label", "div")))
        else:
            inner = "".join(self.block(False, self.prose(3, 50) if r.random() < 0.7 else self.link(4), r.choice(("p", "div", "li"))) for _ in range(r.randint(1, 3)))
        return self.wrapped(inner, r.choice(PARTS[kind]))

    def unnamed(self) -> str:
        """Other articles, or comments, in elements whose names tell nothing."""
        r = self.rng
        plain = lambda: f"{r.choice(('div', 'section', 'ul', 'div'))}{' class=' + r.choice(PLAIN_NAMES) if r.random() < 0.7 else ''}"
        if r.random() < 0.5:
            item = r.choice(("li", "p", "div", "h3"))
            inner = [f"<{item}><a href=/x>B {self.words(r.randint(2, 9))}</a>{' ' + self.words(r.randint(2, 9)) if r.random() < 0.2 else ''}</{item}>" for _ in range(r.randint(2, 6))]
            above = r.choice(ABOVE_LINKS)
        else:
            inner = []
            for _ in range(r.randint(1, 5)):
                who = self.block(False, f"{self.words(1).capitalize()} {r.choice(('2 days ago', '5 hours ago', 'says:', 'wrote:', 'at 10:42 pm', '1 week ago'))}", r.choice(("p", "div", "h4")))
                said = "".join(self.block(False, self.prose(4, 60), r.choice(("p", "div"))) for _ in range(r.choice((1, 1, 2))))
                inner.append(self.wrapped(who + said + (self.block(False, "<a href=#>Reply</a>", r.choice(("p", "div"))) if r.random() < 0.6 else ""), plain()))
            above = r.choice(ABOVE_COMMENTS)
        head = self.block(False, above, r.choice(("h2", "h3", "h4", "p", "div"))) if r.random() < 0.85 or len(inner) < 2 else ""
        return self.wrapped(head + "".join(inner), plain()) if r.random() < 0.8 else head + "".join(inner)

    def content(self) -> str:
        r = self.rng
        out = [self.block(True, self.words(r.randint(2, 9)), "h1")] if r.random() < 0.8 else []
        if out and r.random() < 0.15:
            out = [f"<header>{out[0]}{self.block(True, self.prose(3, 12), 'p')}</header>"]
        linked = self.hard and r.random() < 0.04  # nothing but lists of links
        for _ in range(r.randint(1, 2) if linked else max(1, round(12 * r.random() ** 1.5))):
            kind = r.random()
            name = f' {r.choice(("class", "id"))}="{r.choice(MISLEADING)}"' if r.random() < 0.07 else ""
            if self.hard and kind < 0.03 or linked:
                items = [f"<li><a href=/x>C {self.words(r.randint(1, 9))}</a>{' ' + self.prose(2, 20) if r.random() < 0.3 else ''}</li>" for _ in range(r.randint(3, 9))]
                out.append(self.wrapped("".join(items), r.choice(("ul", "ol"))))
            elif kind < 0.75:
                text = self.prose()
                if r.random() < 0.15:
                    text = text.replace(" ", f" {self.link()} ", 1)
                one = self.block(True, text, r.choice(("p", "p", "p", "p", "div", "blockquote", "pre")), name)
                out.append(self.wrapped(one, f"{r.choice(('div', 'section'))} class={r.choice([*PLAIN_NAMES, *MISLEADING])}") if r.random() < 0.12 else one)
            elif kind < 0.85:
                out.append(self.block(True, self.words(r.randint(1, 6)), r.choice(("h2", "h3")), name))
            elif kind < 0.97:
                out.append(self.wrapped("".join(self.block(True, self.prose(1, 15), "li") for _ in range(r.randint(1, 5))), r.choice(("ul", "ol"))))
            else:
                out.append(f"<table><tr>{self.block(True, self.prose(1, 5), 'td')}{self.block(True, self.prose(1, 5), 'td')}</tr></table>")
        for kind in ("advert", "comments", "links", "side"):
            if r.random() < 0.2:
                at = r.randrange(1, len(out) + 1) if kind != "comments" else len(out)
                out.insert(at, self.part(kind))
        inner = "".join(out)
        if self.hard and r.random() < 0.12:
            inner += self.unnamed()
        opening = r.choice(("article", "article", "main", "div", "div", "section", "td", ""))
        if linked:
            opening = r.choice(("article", "main"))
        if not opening:
            return inner
        names = CONTENT_NAMES if r.random() < 0.6 else PLAIN_NAMES
        inner = self.wrapped(inner, opening + (f" {r.choice(('class', 'id'))}={r.choice(names)}" if r.random() < 0.7 else ""))
        return self.wrapped(inner, r.choice(("main", "div class=page", "div id=wrapper", "div class=container"))) if r.random() < 0.4 else inner

    def page(self) -> str:
        r = self.rng
        if r.random() < 0.06:  # nothing but a little content
            return "".join(self.block(True, self.prose(1, 15), "p") for _ in range(r.randint(1, 3)))
        chosen = lambda kinds, share: "".join(self.part(k) for k in kinds if r.random() < share)
        before, after = chosen(("notice", "header", "menu", "links", "advert", "side"), 0.4), chosen(("comments", "links", "side", "form", "advert", "footer", "notice"), 0.4)
        if self.hard and r.random() < 0.15:
            after = self.unnamed() + after
        return f"<body>{before}{self.content()}{after}</body>"


def pages(n: int, seed: int, hard: bool = False) -> list[str]:
    writer = Writer(random.Random(seed), hard)
    return [writer.page() for _ in range(n)]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Weights by Newton's method with a ridge on all but the first."""
    w, held = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    held[0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(held), x.T @ (y - p) - held * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


@functools.cache
def fitted(features: Callable[[str], tuple[list, np.ndarray]], n: int = PAGES, seed: int = SEED) -> tuple[float, ...]:
    """The weights of features(page), which gives a page's blocks and a row for each of them."""
    rows, labels = [], []
    for page in pages(n, seed, hard=True):
        found, x = features(page)
        rows.append(x)
        labels += [b.text.startswith("C") for b in found]
    return tuple(map(float, logistic(np.concatenate(rows), np.array(labels, dtype=float), RIDGE)))
