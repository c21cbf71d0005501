from __future__ import annotations

import struct

import pytest

from folioflow.config import Limits
from folioflow.sources import fonts, pdf
from folioflow.sources.samples import cmap4, truetype


def cmap12(codes: dict[int, int]) -> bytes:
    rows = b"".join(struct.pack(">3L", c, c, g) for c, g in sorted(codes.items()))
    return struct.pack(">2H3L", 12, 0, 16 + len(rows), 0, len(codes)) + rows


def post2(names: list[str]) -> bytes:
    own = b"".join(bytes([len(n)]) + n.encode() for n in names)
    return b"\0\2\0\0" + bytes(28) + struct.pack(">H", len(names)) + b"".join(struct.pack(">H", 258 + i) for i in range(len(names))) + own


def cff(ids: list[int], own: list[bytes], keyed: bool = False) -> bytes:
    def index(items: list[bytes]) -> bytes:
        if not items:
            return b"\0\0"
        ends = [1]
        for i in items:
            ends.append(ends[-1] + len(i))
        return struct.pack(">HB", len(items), 2) + b"".join(struct.pack(">H", e) for e in ends) + b"".join(items)

    number = lambda n: b"\x1d" + struct.pack(">l", n)
    strings = index(own)
    top = lambda charset, chars: (number(1) + number(2) + number(0) + b"\x0c\x1e" if keyed else b"") + number(charset) + b"\x0f" + number(chars) + b"\x11"
    begin = 4 + len(index([b"F"])) + len(index([top(0, 0)])) + len(strings) + 2
    charset = b"\0" + b"".join(struct.pack(">H", i) for i in ids)
    return b"\1\0\4\1" + index([b"F"]) + index([top(begin, begin + len(charset))]) + strings + b"\0\0" + charset + index([b"\x0e"] * (len(ids) + 1))


def text_of(font: str, shown: str, streams: dict[int, bytes]) -> str:
    """The text of a page in one font; streams are objects from 20 on."""
    content = f"BT /F1 12 Tf 50 700 Td <{shown}> Tj ET".encode()
    objects = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Count 1/Kids[3 0 R]>>", 3: b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 600 800]/Contents 4 0 R/Resources<</Font<</F1 5 0 R>>>>>>", 4: b"<</Length %d>>\nstream\n%s\nendstream" % (len(content), content), 5: font.encode()}
    objects |= {n: b"<</Length %d>>\nstream\n%s\nendstream" % (len(d), d) for n, d in streams.items()}
    data = b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % o for o in objects.items()) + b"trailer\n<</Root 1 0 R>>\n"
    return next(i.text for i in pdf.extract(data, Limits()).items if i.kind == "page")


def wide(descriptor: str, encoding: str = "Identity-H", more: str = "") -> str:
    return f"<</Type/Font/Subtype/Type0/Encoding/{encoding}/DescendantFonts[<</Type/Font/Subtype/CIDFontType2/FontDescriptor<<{descriptor}>>{more}>>]>>"


def test_subset_fonts_without_a_map():
    codes = {ord(c): g for g, c in enumerate("Grüße 漢", 1)}
    for table in (cmap4(codes), cmap12(codes)):
        program = truetype({(3, 1): table})
        shown = "".join(f"{codes[ord(c)]:04x}" for c in "Grüße 漢")
        assert text_of(wide("/FontFile2 20 0 R"), shown, {20: program}) == "Grüße 漢"
    mapped = struct.pack(">5H", 0, 0, 3, 2, 1)
    assert text_of(wide("/FontFile2 20 0 R", more="/CIDToGIDMap 21 0 R"), "000200030004", {20: truetype({(3, 1): cmap4(codes)}), 21: mapped}) == "".join("Grüße 漢"[g - 1] for g in (3, 2, 1))
    assert text_of(wide("/FontFile2 20 0 R"), "00010002", {20: truetype({}, post2([".notdef", "eacute", "uni4E00"]))}) == "é一"
    assert text_of(wide(""), "00010002", {}) == ""
    assert text_of(wide("/FontFile2 20 0 R"), "0001", {20: b"no font"}) == ""


def test_compact_fonts():
    program = cff([34, 66, 391, 392], [b"eacute", b"Omega"])
    assert text_of(wide("/FontFile3 20 0 R"), "00010002000300040009", {20: program}) == "AaéΩ"
    assert fonts.Compact(cff([7, 9], [], keyed=True)).ids == {0: 0, 1: 7, 2: 9}


def test_simple_fonts_of_symbols():
    program = truetype({(3, 0): cmap4({0xF021: 1, 0xF022: 2})}, post2([".notdef", "alpha", "germandbls"]))
    assert text_of("<</Type/Font/Subtype/TrueType/FontDescriptor<</Flags 4/FontFile2 20 0 R>>>>", "2122", {20: program}) == "αß"
    assert text_of("<</Type/Font/Subtype/TrueType/FontDescriptor<</Flags 4>>>>", "4142", {}) == "AB"
    assert text_of("<</Type/Font/Subtype/Type1/Encoding<</Differences[1/Scaron/one/u1F600/f_i.alt]>>>>", "010203", {}) == "Š1😀"


@pytest.mark.parametrize(("name", "codec"), [("90ms-RKSJ-H", "cp932"), ("GBK-EUC-H", "gb18030"), ("KSCms-UHC-H", "cp949"), ("ETen-B5-H", "big5"), ("EUC-H", "euc_jp"), ("UniJIS-UTF16-H", "utf-16-be"), ("UniGB-UCS2-H", "utf-16-be"), ("UniJIS-UTF8-H", "utf-8")])
def test_predefined_maps(name, codec):
    word = "한글" if "KSC" in name else "日本"
    assert text_of(wide("", name), word.encode(codec).hex(), {}) == word


def test_widths_tell_words_apart():
    program = truetype({(3, 1): cmap4({ord("a"): 1, ord("b"): 2})})
    close, apart = "/W[1[500 500]]", "/W[1 2 500]/DW 900"
    for w in (close, apart):
        font = wide("/FontFile2 20 0 R", more=w)
        assert text_of(font, "00010002", {20: program}) == "ab"
    assert text_of(wide("/FontFile2 20 0 R", more="/W[1[3000 500]]"), "00010002", {20: program}) == "ab"


def test_names():
    assert [fonts.glyph(n) for n in ("A", "Aacute", "scaron", "Omega", "sigma", "omega", "uni00410042", "u110000", "g17", "five", "hyphen", "a.sc")] == ["A", "Á", "š", "Ω", "σ", "ω", "AB", "", "", "5", "-", "a"]
    assert [fonts.standard(i) for i in (0, 3, 36, 98, 300)] == ["", "uni0020", "uni0041", "uni00C4", ""]
