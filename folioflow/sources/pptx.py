"""Slides to items."""

from __future__ import annotations

import posixpath
from xml.etree.ElementTree import Element

from ..functions.catalog import WARNINGS
from .items import BODY, HEAD, NOTES, Extract, Item
from .ooxml import NS, Package, tag

FAR = 10**9


def extract(content: bytes, notes: bool = False, include_media: bool = True) -> Extract:
    package = Package(content)
    main = package.xml("ppt/presentation.xml")
    relations = package.relations("ppt/presentation.xml")
    out = Extract(parts=0)
    listed = main.find("p:sldIdLst", NS)
    for number, entry in enumerate(listed if listed is not None else [], start=1):
        _, name, _ = relations[entry.get(tag("r:id"))]
        out.parts = number
        Slide(package, name, number, include_media).read(out.items, notes)
    return out


def runs(paragraph: Element) -> str:
    """The text of a paragraph's runs; fields and line breaks are not runs."""
    return "".join(t.text or "" for r in paragraph.findall("a:r", NS) for t in r.findall("a:t", NS))


def whole_text(body: Element | None) -> str:
    """All text of a frame, with its fields and breaks."""
    if body is None:
        return ""
    lines = []
    for p in body.findall("a:p", NS):
        lines.append("".join("\v" if x.tag == tag("a:br") else (x.findtext("a:t", "", NS) or "") for x in p))
    return "\n".join(lines)


class Slide:
    def __init__(self, package: Package, name: str, number: int, include_media: bool):
        self.package, self.number, self.include_media = package, number, include_media
        self.relations = package.relations(name)
        self.tree = package.xml(name).find("p:cSld/p:spTree", NS)
        self.warned: set[str] = set()

    def of_type(self, kind: str) -> str | None:
        return next((target for k, target, outer in self.relations.values() if k == kind and not outer and target in self.package.names), None)

    def read(self, items: list[Item], notes: bool) -> None:
        shapes = list(self.tree) if self.tree is not None else []
        title = next((s for s in shapes if (ph := self.placeholder(s)) is not None and (ph.get("type") in ("title", "ctrTitle") or ph.get("idx", "0") == "0" and ph.get("type") in (None, "title", "ctrTitle"))), None)
        items.append(Item(self.number, "slide", HEAD, text=whole_text(title.find("p:txBody", NS)) if title is not None else ""))
        for z, shape in enumerate(s for s in shapes if s is not title):
            self.shape(shape, (*self.position(shape), z), items)
        if notes and (name := self.of_type("notesSlide")):
            for s in self.package.xml(name).iter(tag("p:sp")):
                if (ph := self.placeholder(s)) is not None and ph.get("type") == "body":
                    items.append(Item(self.number, "notes", NOTES, text=whole_text(s.find("p:txBody", NS))))
                    break

    @staticmethod
    def placeholder(shape: Element) -> Element | None:
        return next((e for e in (shape.find(f"p:{nv}/p:nvPr/p:ph", NS) for nv in ("nvSpPr", "nvPicPr", "nvGraphicFramePr")) if e is not None), None)

    def position(self, shape: Element) -> tuple[int, int]:
        """top, left; a placeholder without its own has its layout's."""
        for path in ("p:spPr/a:xfrm/a:off", "p:grpSpPr/a:xfrm/a:off", "p:xfrm/a:off"):
            off = shape.find(path, NS)
            if off is not None:
                return int(off.get("y", FAR)), int(off.get("x", FAR))
        mine = self.placeholder(shape)
        if mine is not None:
            if not hasattr(self, "layout"):
                name = self.of_type("slideLayout")
                self.layout = list(self.package.xml(name).find("p:cSld/p:spTree", NS)) if name else []
            for other in self.layout:
                ph = self.placeholder(other)
                off = other.find("p:spPr/a:xfrm/a:off", NS)
                if ph is not None and off is not None and ph.get("idx", "0") == mine.get("idx", "0"):
                    return int(off.get("y", FAR)), int(off.get("x", FAR))
        return FAR, FAR

    def warn(self, kind: str, key: tuple[int, ...], items: list[Item]) -> None:
        if kind not in self.warned:
            self.warned.add(kind)
            items.append(Item(self.number, "warning", BODY, key, text=WARNINGS[kind].replace("{n}", str(self.number))))

    def shape(self, shape: Element, key: tuple[int, ...], items: list[Item]) -> None:
        """A group, else a table, a picture, something unsupported, or a text frame."""
        kind = shape.tag.rpartition("}")[2]
        if kind == "grpSp":
            for z, child in enumerate(shape):
                if child.tag.rpartition("}")[2] in ("sp", "grpSp", "graphicFrame", "pic", "cxnSp"):
                    self.shape(child, (*key, *self.position(child), z), items)
        elif kind == "graphicFrame":
            table = shape.find("a:graphic/a:graphicData/a:tbl", NS)
            if table is not None:
                rows = [[whole_text(c.find("a:txBody", NS)) for c in r.findall("a:tc", NS)] for r in table.findall("a:tr", NS)]
                items.append(Item(self.number, "table", BODY, key, rows=rows))
                return
            data = shape.find("a:graphic/a:graphicData", NS)
            uri = data.get("uri", "") if data is not None else ""
            if uri.endswith("/chart"):
                self.warn("chart", key, items)
            elif uri.endswith("/diagram"):
                self.warn("diagram", key, items)
            elif uri.endswith("/ole"):
                self.warn("linked" if next(data.iter(tag("p:link")), None) is not None else "embedded", key, items)
        elif kind == "pic":
            self.picture(shape, key, items)
        elif kind == "cxnSp":
            self.warn("line", key, items)
        elif kind == "sp" and (body := shape.find("p:txBody", NS)) is not None:
            paragraphs = [(int(p.find("a:pPr", NS).get("lvl", 0)) if p.find("a:pPr", NS) is not None else 0, runs(p)) for p in body.findall("a:p", NS)]
            items.append(Item(self.number, "frame", BODY, key, paragraphs=paragraphs))

    def picture(self, shape: Element, key: tuple[int, ...], items: list[Item]) -> None:
        properties = shape.find("p:nvPicPr/p:nvPr", NS)
        if properties is not None and any(properties.find(f"a:{x}", NS) is not None for x in ("videoFile", "audioFile", "wavAudioFile", "quickTimeFile")):
            self.warn("media", key, items)
            return
        if not self.include_media:
            return
        blip = shape.find("p:blipFill/a:blip", NS)
        _, target, outer = self.relations.get(blip.get(tag("r:embed"), "") if blip is not None else "", ("", "", True))
        if outer or target not in self.package.names:
            self.warn("slide_image", key, items)
            return
        ext = posixpath.splitext(target)[1].lower()
        if ext in (".wmf", ".emf"):
            self.warn(ext[1:], key, items)
            return
        try:
            content = self.package.read(target)
        except Exception:  # a damaged member
            self.warn("slide_image", key, items)
            return
        about = shape.find("p:nvPicPr/p:cNvPr", NS)
        items.append(Item(self.number, "image", BODY, key, ext=ext or ".png", alt=about.get("descr") if about is not None else None, content=content))


