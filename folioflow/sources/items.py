"""What extractors return: a document is a list of items, each with a place in its order."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

#: kind: slide, page (heads of parts; text is a slide's title or a page's text, position a page's number of images), frame (paragraphs), table, ptable (rows),
#: raw (a finished block), image (content), file (content under the name in alt), notes, warning.
ITEM = (
    "struct<part_no:int,place:int,key:array<bigint>,kind:string,text:string,paragraphs:array<struct<level:int,text:string>>,"
    "rows:array<array<string>>,ext:string,alt:string,position:int,boxes:array<struct<w:double,h:double>>,area:double,digest:string,content:binary>"
)
EXTRACT = f"error_code string, parts int, items array<{ITEM}>"
#: Places within a part.
HEAD, BODY, TABLES, IMAGES, NOTES, AFTER = range(6)


class Failure(Exception):
    """A document that cannot be converted; code is from the catalogue of errors."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


@dataclass
class Item:
    part_no: int
    kind: str
    place: int = BODY
    key: tuple[int, ...] = ()
    text: str | None = None
    paragraphs: list[tuple[int, str]] | None = None
    rows: list[list[str | None]] | None = None
    ext: str | None = None
    alt: str | None = None
    position: int | None = None
    boxes: list[tuple[float, float]] | None = None
    area: float | None = None
    content: bytes | None = None

    def row(self) -> dict:
        paragraphs = None if self.paragraphs is None else [{"level": a, "text": b} for a, b in self.paragraphs]
        digest = None if self.content is None else hashlib.sha256(self.content).hexdigest()
        boxes = None if self.boxes is None else [{"w": float(w), "h": float(h)} for w, h in self.boxes]
        return {**self.__dict__, "key": list(self.key), "paragraphs": paragraphs, "boxes": boxes, "digest": digest}


@dataclass
class Extract:
    items: list[Item] = field(default_factory=list)
    parts: int | None = None
    error_code: str | None = None
