"""Lines as they are read, from lines as they are seen: letters of right-to-left scripts stand in a page from the left."""

from __future__ import annotations

import unicodedata

RIGHT, LEFT, NUMBER = frozenset(("R", "AL")), frozenset(("L",)), frozenset(("EN", "AN"))
#: What joins two numbers, and what may stand before or behind one, as parts of it.
JOINS, BESIDE = frozenset(("ES", "CS")), frozenset(("ET",))


def logical(seen: str) -> str:
    """The reading order of a line that is given from left to right as it is seen.

    The line runs to the left if more of its letters do. Then it is turned as a whole, and runs of the other direction, numbers among
    them, are turned back; otherwise only runs of right-to-left letters are turned. What has no direction goes with what
    stands on both its sides, or with the line. Presentation forms become the letters that they show.
    """
    if seen.isascii():
        return seen
    kinds = [unicodedata.bidirectional(c) for c in seen]
    right, left = sum(k in RIGHT for k in kinds), sum(k in LEFT for k in kinds)
    if not right:
        return seen
    turned = right >= left
    ways = resolved(kinds, turned)
    runs: list[tuple[bool, str]] = []
    for c, way in zip(seen, ways, strict=True):
        if runs and runs[-1][0] == way:
            runs[-1] = (way, runs[-1][1] + c)
        else:
            runs.append((way, c))
    parts = [text[::-1] if to_left else text for to_left, text in runs]
    return plain("".join(reversed(parts) if turned else parts))


def resolved(kinds: list[str], turned: bool) -> list[bool]:
    """For each character whether it runs to the left."""
    n = len(kinds)
    ways: list[bool | None] = [True if k in RIGHT else False if k in LEFT or k in NUMBER else None for k in kinds]
    for i in range(1, n - 1):
        if kinds[i] in JOINS and kinds[i - 1] in NUMBER and kinds[i + 1] in NUMBER:
            ways[i] = False
    for i in range(n):
        if kinds[i] in BESIDE and any(0 <= j < n and kinds[j] in NUMBER for j in (i - 1, i + 1)):
            ways[i] = False
    at = 0
    while at < n:
        if ways[at] is not None:
            at += 1
            continue
        end = at
        while end < n and ways[end] is None:
            end += 1
        # a number beside a right-to-left letter does not take the gap between them
        before = None if at == 0 else turned if kinds[at - 1] in NUMBER or kinds[at - 1] in JOINS | BESIDE else ways[at - 1]
        after = None if end == n else turned if kinds[end] in NUMBER or kinds[end] in JOINS | BESIDE else ways[end]
        ways[at:end] = [before if before == after and before is not None else turned] * (end - at)
        at = end
    return [bool(w) for w in ways]


def plain(text: str) -> str:
    """Arabic and Hebrew presentation forms as ordinary letters."""
    if not any("\ufb1d" <= c <= "\ufdff" or "\ufe70" <= c <= "\ufefc" for c in text):
        return text
    return "".join(unicodedata.normalize("NFKC", c) if "\ufb1d" <= c <= "\ufdff" or "\ufe70" <= c <= "\ufefc" else c for c in text)
