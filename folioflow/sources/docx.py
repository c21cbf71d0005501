"""Word documents to Markdown blocks: headings, emphasis, lists, tables, links, notes, equations, images.

The body is a tree: blocks stand in content controls, custom XML, moved or inserted ranges,
alternate content and text boxes, to any depth. Tracked changes count as accepted. What
has no Markdown leaves a warning.
"""

from __future__ import annotations

import hashlib
import posixpath
import re
from collections.abc import Iterator
from functools import lru_cache
from xml.etree.ElementTree import Element

from ..functions.catalog import WARNINGS
from . import numbering
from .equations import tex
from .items import AFTER, BODY, Extract, Item
from .numbering import value, whole
from .ooxml import Package, find, tag

#: What only holds other blocks or runs.
HOLDERS = frozenset(("sdt", "sdtContent", "customXml", "ins", "moveTo", "smartTag", "fldSimple", "dir", "bdo", "rubyBase", "hyperlink", "Choice", "Fallback", "oMathPara", "txbxContent"))
#: What tracked changes took away.
GONE = frozenset(("del", "moveFrom"))
#: The note parts and their usual names.
NOTES = {"footnote": "word/footnotes.xml", "endnote": "word/endnotes.xml"}
#: Elements that make an alternative worth taking.
HOLDS = tuple(tag(t) for t in ("w:t", "a:blip", "v:imagedata", "m:t"))


def extract(content: bytes, include_media: bool = True) -> Extract:
    document = Document(Package(content), include_media)
    document.read()
    return Extract(document.items)


def kind_of(element: Element) -> str:
    return local(element.tag)


@lru_cache(4096)
def local(name: str) -> str:
    return name.rpartition("}")[2]


def is_on(properties: Element | None, name: str) -> bool:
    return value(properties, name) not in (None, "0", "false", "none")


def alternative(element: Element) -> list[Element]:
    """The first of several forms of the same content that holds anything."""
    forms = [e for e in element if kind_of(e) in ("Choice", "Fallback")]
    held = [f for f in forms if any(e.tag in HOLDS for e in f.iter())]
    return (held or forms)[:1]


def members(element: Element, *wanted: str) -> Iterator[Element]:
    """The elements of some kinds below an element, through whatever only holds them."""
    for child in element:
        kind = kind_of(child)
        if kind in wanted:
            yield child
        elif kind == "AlternateContent":
            for form in alternative(child):
                yield from members(form, *wanted)
        elif kind not in GONE and (kind in HOLDERS or kind not in ("p", "tbl", "tr", "tc") and any(kind_of(e) in wanted for e in child.iter() if e is not child)):
            yield from members(child, *wanted)


class Table:
    """Cells on a grid: a cell that spans columns is followed by empty ones, one that goes on from the row above is empty and what it holds belongs to the cell where it began."""

    def __init__(self) -> None:
        self.rows: list[list[str]] = []
        self.above: dict[int, tuple[int, int]] = {}  # column -> row and place of the merged cell that covers it

    def row(self, before: int, cells: list[tuple[str, int, str | None]], after: int) -> None:
        """cells: text, columns, and None, "restart" or "continue" for cells that are merged downwards."""
        out, covered = [""] * before, {}
        for text, span, merge in cells:
            at = len(out)
            if merge == "continue" and at in self.above:
                row, place = self.above[at]
                if text:
                    self.rows[row][place] = f"{self.rows[row][place]} {text}".strip()
                covered[at], text = (row, place), ""
            elif merge is not None:
                covered[at] = (len(self.rows), at)
            out += [text] + [""] * (span - 1)
        self.rows.append(out + [""] * after)
        self.above = covered


class Document:
    def __init__(self, package: Package, include_media: bool):
        self.package, self.include_media = package, include_media
        self.relations = package.relations("word/document.xml")
        self.items: list[Item] = []
        self.names: dict[str, str] = {}  # digest -> media/...
        self.marks: dict[tuple[str, str], int] = {}  # kind and id of a note -> its number
        self.notes: list[str] = []
        self.fields: list[dict] = []  # the fields that are open where we read
        self.boxes: list[Element] = []  # text boxes of the paragraph that is being read
        self.pending: list[str] = []  # the lines of the list that is being read
        self.widths: dict[int, int] = {}  # of the marks of the last items, by depth
        self.shown: dict[int, tuple[int, str]] = {}  # the last numbers of the list that is being read, and what follows them, by depth
        self.carried = ""  # the text of paragraphs whose end was deleted
        part = lambda name: package.xml(name) if name in package.names else None
        styles = part("word/styles.xml")
        self.headings = self._headings(styles)
        self.numbers = numbering.read(part("word/numbering.xml"), styles)
        named = {k: t for k, t, outer in self.relations.values() if not outer}
        self.note_parts = {k: named.get(f"{k}s", usual) for k, usual in NOTES.items()}
        self.note_bodies = {(k, n.get(tag("w:id"), "")): n for k, p in self.note_parts.items() if (root := part(p)) is not None for n in root.findall(tag(f"w:{k}"))}

    @staticmethod
    def _headings(styles: Element | None) -> dict[str, int]:
        """Style id -> heading level, by the style's name or outline level."""
        found = {}
        for s in styles.findall(tag("w:style")) if styles is not None else []:
            name = (value(s, "w:name") or "").lower()
            outline = value(s, "w:pPr/w:outlineLvl")
            if m := re.fullmatch(r"heading ([1-9])", name):
                found[s.get(tag("w:styleId"))] = min(6, int(m[1]))
            elif name == "title":
                found[s.get(tag("w:styleId"))] = 1
            elif outline is not None and outline.isdigit() and int(outline) < 9:
                found[s.get(tag("w:styleId"))] = min(6, int(outline) + 1)
        return found

    def read(self) -> None:
        body = find(self.package.xml("word/document.xml"), "w:body")
        if body is not None:
            self.blocks(body)
        self.flush()
        for n, text in enumerate(self.notes, 1):
            self.items.append(Item(1, "raw", AFTER, (len(self.items),), text=f"[^{n}]: {text}"))

    def blocks(self, container: Element) -> None:
        for element in members(container, "p", "tbl", "oMath", "altChunk", "subDoc"):
            kind = kind_of(element)
            if kind == "p":
                self.paragraph(element)
            elif kind == "tbl":
                self.flush()
                self.items.append(Item(1, "table", BODY, (len(self.items),), rows=self.table(element)))
            elif kind == "oMath":
                self.flush()
                self.block(f"$${tex(element)}$$")
            else:
                self.warn("doc_part")

    def flush(self) -> None:
        """Ends the list and the paragraph that are being read."""
        lines, self.pending = "\n".join(self.pending), []
        carried, self.carried = self.carried.strip(), ""
        self.widths, self.shown = {}, {}
        self.block(lines)
        self.block(carried)

    def block(self, text: str) -> None:
        if text:
            self.items.append(Item(1, "raw", BODY, (len(self.items),), text=text))

    def warn(self, kind: str) -> None:
        self.items.append(Item(1, "warning", BODY, (len(self.items),), text=WARNINGS[kind]))

    def paragraph(self, element: Element) -> None:
        outer, self.boxes = self.boxes, []
        text = self.carried + self.inline(element)
        self.carried = ""
        if find(element, "w:pPr/w:rPr/w:del") is not None or find(element, "w:pPr/w:rPr/w:moveFrom") is not None:
            self.carried = text  # its end was deleted: the next one goes on
        else:
            item = self.list_item(element, text)
            if item is not None:
                self.pending.append(item)
            else:
                self.flush()
                style = value(element, "w:pPr/w:pStyle")
                level = self.headings.get(style or "") or (int(m[1]) if (m := re.fullmatch(r"(?i)heading([1-6])", style or "")) else 0)
                text = text.strip()
                self.block(f"{'#' * level} {' '.join(text.split())}" if level and text else text)
        boxes, self.boxes = self.boxes, outer
        for box in boxes:
            self.flush()
            self.blocks(box)

    def list_item(self, paragraph: Element, text: str) -> str | None:
        style = value(paragraph, "w:pPr/w:pStyle") or ""
        number, depth = value(paragraph, "w:pPr/w:numPr/w:numId"), whole(value(paragraph, "w:pPr/w:numPr/w:ilvl"), None)
        by_style = self.numbers.styles.get(style)
        if number is None and by_style is not None and not self.headings.get(style):
            number, depth = by_style[0], by_style[1] if depth is None else depth
        depth = min(max(depth or 0, 0), 8)
        if number is None:
            if not style.lower().startswith(("listbullet", "listnumber")):
                return None
            depth = int(style[-1]) - 1 if style[-1] in "123456789" else 0
            number, kind = style.lower()[:10], "bullet" if style.lower().startswith("listbullet") else "decimal"
        elif number == "0" or style.lower().startswith("heading"):
            return None
        else:
            kind = self.numbers.level(number, depth).kind
        mark = "-" if kind in numbering.UNNUMBERED else self.numbered(self.numbers.next(number, depth), depth)
        indent = sum(self.widths.get(d, len(mark) + 1 if mark == "-" else 3) for d in range(depth))
        self.widths = {d: w for d, w in self.widths.items() if d < depth} | {depth: len(mark) + 1}
        return f"{' ' * indent}{mark} {text.strip()}"

    def numbered(self, number: int, depth: int) -> str:
        """A number with its point, or with a bracket where another list ends right before, as only that tells Markdown's lists apart."""
        last, sign = self.shown.get(depth, (number - 1, "."))
        if number != last + 1:
            sign = "." if sign == ")" else ")"
        self.shown = {d: x for d, x in self.shown.items() if d < depth} | {depth: (number, sign)}
        return f"{number}{sign}"

    def table(self, element: Element) -> list[list[str]]:
        out = Table()
        for row in members(element, "tr"):
            if find(row, "w:trPr/w:del") is not None:
                continue
            cells = []
            for c in members(row, "tc"):
                properties = find(c, "w:tcPr")
                span = max(1, whole(value(properties, "w:gridSpan"), 1))
                merge = find(properties, "w:vMerge") if properties is not None else None
                side = value(properties, "w:hMerge") if properties is not None and find(properties, "w:hMerge") is not None else None
                text = self.flat(c)
                if side is not None and side != "restart" and cells:  # goes on from the cell to its left
                    before = cells[-1]
                    cells[-1] = (f"{before[0]} {text}".strip(), before[1] + span, before[2])
                else:
                    cells.append((text, span, None if merge is None else "restart" if merge.get(tag("w:val")) == "restart" else "continue"))
            out.row(whole(value(row, "w:trPr/w:gridBefore"), 0), cells, whole(value(row, "w:trPr/w:gridAfter"), 0))
        return out.rows

    def flat(self, container: Element) -> str:
        """The text of a cell or a note as one line: its paragraphs, tables within it and text boxes in order."""
        out = []
        for element in members(container, "p", "tbl", "oMath"):
            kind = kind_of(element)
            if kind == "p":
                outer, self.boxes = self.boxes, []
                out.append(self.inline(element).strip())
                boxes, self.boxes = self.boxes, outer
                out += map(self.flat, boxes)
            elif kind == "tbl":
                out += [c for row in self.table(element) for c in row]
            else:
                out.append(f"${tex(element)}$")
        return " ".join(filter(None, out))

    def inline(self, element: Element) -> str:
        """Runs with emphasis, links, notes, equations and images; neighbours that look alike are joined."""
        joined: list[list] = []  # [link, [marks, text] ...]
        for link, marks, text in self.runs(element, None):
            if not joined or joined[-1][0] != link:
                joined.append([link, []])
            parts = joined[-1][1]
            if parts and parts[-1][0] == marks:
                parts[-1][1] += text
            else:
                parts.append([marks, text])
        out = []
        for link, parts in joined:
            text = "".join(emphasised(marks, t) for marks, t in parts)
            out.append(f"[{text}]({link})" if link and text.strip() else text)
        return "".join(out)

    def runs(self, element: Element, link: str | None) -> Iterator[tuple[str | None, str, str]]:
        """Link, marks around it and text of each run below an element."""
        for child in element:
            kind = kind_of(child)
            if kind == "r":
                properties = find(child, "w:rPr")
                marks = ("**" if is_on(properties, "w:b") else "") + ("*" if is_on(properties, "w:i") else "") + ("~~" if is_on(properties, "w:strike") else "")
                text = self.run(child)
                yield link or next((f["link"] for f in reversed(self.fields) if f["link"]), None), marks, text
            elif kind == "hyperlink":
                _, target, outer = self.relations.get(child.get(tag("r:id"), ""), ("", "", False))
                yield from self.runs(child, target if outer else link)
            elif kind == "oMath":
                yield link, "", f"${tex(child)}$"
            elif kind == "AlternateContent":
                for form in alternative(child):
                    yield from self.runs(form, link)
            elif kind in ("drawing", "pict", "object"):
                yield link, "", self.drawn(child)
            elif kind in HOLDERS:
                yield from self.runs(child, link)

    def run(self, run: Element) -> str:
        out = []
        for child in run:
            kind = kind_of(child)
            if kind == "t":
                out.append(child.text or "")
            elif kind in ("tab", "ptab"):
                out.append("\t")
            elif kind in ("br", "cr"):
                out.append("  \n" if child.get(tag("w:type"), "textWrapping") == "textWrapping" else "")
            elif kind == "noBreakHyphen":
                out.append("-")
            elif kind in ("footnoteReference", "endnoteReference"):
                out.append(self.note(kind[:-9], child.get(tag("w:id"), "")))
            elif kind in ("drawing", "pict", "object"):
                out.append(self.drawn(child))
            elif kind == "AlternateContent":
                out += [self.run(form) for form in alternative(child)]
            elif kind == "sym":
                out.append(self.symbol(child))
            elif kind == "ruby":
                base, over = ("".join(t for part in child.findall(tag(f"w:{name}")) for _, _, t in self.runs(part, None)) for name in ("rubyBase", "rt"))
                out.append(f"{base}({over})" if over else base)
            elif kind in ("fldChar", "instrText"):
                self.field(child, kind)
        return "".join(out)

    def symbol(self, element: Element) -> str:
        """A character that is given by its number; one of a font's own has no letter."""
        try:
            code = int(element.get(tag("w:char"), ""), 16)
        except ValueError:
            code = 0xF000
        if 0xE000 <= code < 0xF900 or 0xD800 <= code < 0xE000 or not 0x20 <= code < 0x110000:
            self.warn("doc_symbol")
            return ""
        return chr(code)

    def field(self, element: Element, kind: str) -> None:
        """Follows fields that are made of runs: what they are, then what they show."""
        if kind == "instrText":
            if self.fields:
                self.fields[-1]["code"] += element.text or ""
            return
        change = element.get(tag("w:fldCharType"))
        if change == "begin":
            self.fields.append({"code": "", "link": None})
        elif change == "separate" and self.fields:
            if m := re.match(r'\s*HYPERLINK\s+"([a-zA-Z][a-zA-Z0-9+.-]*:[^"]*)"', self.fields[-1]["code"]):
                self.fields[-1]["link"] = m[1]
        elif change == "end" and self.fields:
            self.fields.pop()

    def note(self, kind: str, key: str) -> str:
        """The mark of a note; its text is read where it is first met, with the links of its own part."""
        body = self.note_bodies.get((kind, key))
        if body is None:
            return ""
        if (kind, key) not in self.marks:
            self.marks[kind, key] = len(self.notes) + 1
            self.notes.append("")
            outer = self.relations, self.fields
            self.relations, self.fields = self.package.relations(self.note_parts[kind]), []
            self.notes[self.marks[kind, key] - 1] = self.flat(body)
            self.relations, self.fields = outer
        return f"[^{self.marks[kind, key]}]"

    def drawn(self, drawing: Element) -> str:
        """The images of a drawing; its text boxes are kept for the end of the paragraph, the rest leaves a warning."""
        about = next(drawing.iter(tag("wp:docPr")), None)
        alt = " ".join((about.get("descr") or "").split()) if about is not None else ""
        if kind_of(drawing) == "object":
            self.warn("doc_object")
        out: list[str] = []

        def walk(element: Element) -> None:
            for child in element:
                kind = kind_of(child)
                if kind == "txbxContent":
                    self.boxes.append(child)
                elif kind in ("blip", "imagedata"):
                    out.append(self.image(child.get(tag("r:embed")) or child.get(tag("r:id"), ""), alt))
                elif kind == "AlternateContent":
                    for form in alternative(child):
                        walk(form)
                else:
                    if kind == "graphicData" and (what := {"chart": "doc_chart", "diagram": "doc_diagram"}.get(child.get("uri", "").rpartition("/")[2])):
                        self.warn(what)
                    walk(child)

        walk(drawing)
        return "".join(out)

    def image(self, relation: str, alt: str) -> str:
        _, target, outer = self.relations.get(relation, ("", "", True))
        if not self.include_media:
            return ""
        if outer or target not in self.package.names:
            self.warn("doc_image")
            return ""
        content = self.package.read(target)
        digest = hashlib.sha256(content).hexdigest()
        if digest not in self.names:
            self.names[digest] = f"media/image{len(self.names) + 1}{posixpath.splitext(target)[1].lower() or '.png'}"
            self.items.append(Item(1, "file", BODY, (len(self.items),), alt=self.names[digest], content=content))
        return f"![{alt or 'Image'}]({self.names[digest]})"


def emphasised(marks: str, text: str) -> str:
    core = text.strip()
    if not marks or not core:
        return text
    at = text.index(core)
    return f"{text[:at]}{marks}{core}{closing(marks)}{text[at + len(core):]}"


def closing(marks: str) -> str:
    """Marks in the opposite order."""
    return "".join(reversed(re.findall(r"\*\*|\*|~~", marks)))
