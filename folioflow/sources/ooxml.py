"""Parts and relationships of Office packages, with the standard library."""

from __future__ import annotations

import io
import posixpath
import zipfile
from functools import cached_property, lru_cache
from xml.etree import ElementTree

from .items import Failure

#: Name spaces.
NS = {
    "a": "http://schemas.openxmlformats.org/drawingml/2006/main",
    "m": "http://schemas.openxmlformats.org/officeDocument/2006/math",
    "p": "http://schemas.openxmlformats.org/presentationml/2006/main",
    "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
    "v": "urn:schemas-microsoft-com:vml",
    "w": "http://schemas.openxmlformats.org/wordprocessingml/2006/main",
    "wp": "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing",
    "rel": "http://schemas.openxmlformats.org/package/2006/relationships",
}


@lru_cache(4096)
def tag(name: str) -> str:
    """p:sp as ElementTree writes it."""
    prefix, _, local = name.partition(":")
    return f"{{{NS[prefix]}}}{local}"


@lru_cache(4096)
def steps(path: str) -> tuple[str, ...]:
    return tuple(map(tag, path.split("/")))


def find(element: ElementTree.Element, path: str) -> ElementTree.Element | None:
    """element.find(path, NS) of a path of names, without making it out anew for each element."""
    *outer, last = steps(path)
    if not outer:
        return element.find(last)
    return within(element, outer, last)


def within(element: ElementTree.Element, outer: list[str], last: str) -> ElementTree.Element | None:
    if not outer:
        return element.find(last)
    for child in element.findall(outer[0]):
        if (found := within(child, outer[1:], last)) is not None:
            return found
    return None


class Package:
    def __init__(self, content: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(content))
        except Exception:
            raise Failure("CONVERSION_FAILED") from None

    @cached_property
    def names(self) -> set[str]:
        return set(self.zip.namelist())

    def read(self, name: str) -> bytes:
        return self.zip.read(name)

    def xml(self, name: str) -> ElementTree.Element:
        raw = self.read(name)
        if b"<!DOCTYPE" in raw or b"<!ENTITY" in raw:  # Office files have none; entities could expand without bound
            raise Failure("CONVERSION_FAILED")
        return ElementTree.fromstring(raw)

    def relations(self, name: str) -> dict[str, tuple[str, str, bool]]:
        """id -> (type's last part, target as a part's name or an outer address, outer)."""
        folder, base = posixpath.split(name)
        rels = f"{folder}/_rels/{base}.rels" if folder else f"_rels/{base}.rels"
        if rels not in self.names:
            return {}
        found = {}
        for r in self.xml(rels).findall("rel:Relationship", NS):
            outer = r.get("TargetMode") == "External"
            target = r.get("Target", "")
            if not outer:
                target = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
            found[r.get("Id", "")] = (r.get("Type", "").rsplit("/", 1)[-1], target, outer)
        return found
