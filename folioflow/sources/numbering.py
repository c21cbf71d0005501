"""Lists of Word documents: which paragraphs are items, and the number each one shows."""

from __future__ import annotations

from dataclasses import dataclass, field
from xml.etree.ElementTree import Element

from .ooxml import find, tag

UNNUMBERED = ("bullet", "none")


@dataclass
class Level:
    kind: str = "bullet"
    start: int = 1
    #: 0: never starts anew; k: only after a level above k was used; None: after any level above
    restart: int | None = None


@dataclass
class Numbers:
    """Counters run per abstract list and level, across whatever stands between the items; a list with a start of its own begins there once."""

    levels: dict[tuple[str, int], Level] = field(default_factory=dict)
    #: numbering id -> abstract list, and the starts that it sets itself
    lists: dict[str, tuple[str, dict[int, int]]] = field(default_factory=dict)
    #: style id -> numbering id and level
    styles: dict[str, tuple[str, int]] = field(default_factory=dict)
    counts: dict[str, dict[int, int]] = field(default_factory=dict)
    begun: set[tuple[str, int]] = field(default_factory=set)

    def level(self, number: str, depth: int) -> Level:
        own = self.levels.get((f"num {number}", depth))
        return own or self.levels.get((self.lists.get(number, ("", {}))[0], depth), Level())

    def next(self, number: str, depth: int) -> int:
        """The number of the next item of a list at a depth."""
        abstract, starts = self.lists.get(number, (number, {}))
        counts = self.counts.setdefault(abstract, {})
        start = self.level(number, depth).start
        if depth in starts and (number, depth) not in self.begun:
            start = starts[depth]
            counts.pop(depth, None)
        self.begun.add((number, depth))
        counts[depth] = counts[depth] + 1 if depth in counts else start
        for deeper in [d for d in counts if d > depth]:
            restart = self.level(number, deeper).restart
            if restart is None or depth < restart:
                del counts[deeper]
        return counts[depth]


def whole(text: str | None, otherwise: int | None) -> int | None:
    try:
        return int(text) if text is not None else otherwise
    except ValueError:
        return otherwise


def value(element: Element | None, path: str) -> str | None:
    found = find(element, path) if element is not None else None
    return None if found is None else found.get(tag("w:val"), "1")


def read(numbering: Element | None, styles: Element | None) -> Numbers:
    """From the roots of the parts numbering and styles, either of which may be missing."""
    out = Numbers()

    def level(lv: Element) -> Level:
        return Level(value(lv, "w:numFmt") or "decimal", whole(value(lv, "w:start"), 1), whole(value(lv, "w:lvlRestart"), None))

    linked: dict[str, str] = {}  # abstract list -> the style that it takes its levels from
    named: dict[str, str] = {}  # style -> the abstract list that defines it
    if numbering is not None:
        for a in numbering.findall(tag("w:abstractNum")):
            key = a.get(tag("w:abstractNumId"), "")
            for lv in a.findall(tag("w:lvl")):
                out.levels[key, whole(lv.get(tag("w:ilvl")), 0)] = level(lv)
            if link := value(a, "w:numStyleLink"):
                linked[key] = link
            if link := value(a, "w:styleLink"):
                named[link] = key
        for n in numbering.findall(tag("w:num")):
            number, abstract = n.get(tag("w:numId"), ""), value(n, "w:abstractNumId") or ""
            starts = {}
            for o in n.findall(tag("w:lvlOverride")):
                depth = whole(o.get(tag("w:ilvl")), 0)
                if (start := whole(value(o, "w:startOverride"), None)) is not None:
                    starts[depth] = start
                if (lv := find(o, "w:lvl")) is not None:
                    out.levels[f"num {number}", depth] = level(lv)
            out.lists[number] = (named.get(linked.get(abstract, ""), abstract), starts)
    parents: dict[str, str] = {}
    own: dict[str, tuple[str | None, int]] = {}
    for s in styles.findall(tag("w:style")) if styles is not None else []:
        key = s.get(tag("w:styleId"), "")
        parents[key] = value(s, "w:basedOn") or ""
        if find(s, "w:pPr/w:numPr") is not None:
            own[key] = (value(s, "w:pPr/w:numPr/w:numId"), whole(value(s, "w:pPr/w:numPr/w:ilvl"), 0))
    for key in parents:
        at, depth, seen = key, None, set()
        while at and at not in seen:
            seen.add(at)
            number, level_here = own.get(at, (None, None))
            depth = level_here if depth is None else depth
            if number is not None:
                out.styles[key] = (number, depth or 0)
                break
            at = parents.get(at, "")
    return out
