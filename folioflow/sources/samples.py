"""Small Office and PDF files put together from their parts, for queries and tests."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

TYPES = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>'
OPEN = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" xmlns:v="urn:schemas-microsoft-com:vml" xmlns:wps="http://schemas.microsoft.com/office/word/2010/wordprocessingShape"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def zipped(members: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in members.items():
            z.writestr(name, content)
    return out.getvalue()


def stored(members: dict[str, bytes]) -> bytes:
    """An archive whose members are not compressed."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, content in members.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), content)
    return out.getvalue()


def rels(entries: dict[str, tuple[str, str]]) -> str:
    inner = "".join(f'<Relationship Id="{i}" Type="{REL}/{k}" Target="{t}"{" TargetMode=" + chr(34) + "External" + chr(34) if t.startswith("http") else ""}/>' for i, (k, t) in entries.items())
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{inner}</Relationships>'


def png(shade: int = 0) -> bytes:
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(bytes([0, shade]))) + chunk(b"IEND", b"")


def off(top: int | None, left: int | None) -> str:
    return "" if top is None else f'<a:xfrm><a:off x="{left}" y="{top}"/></a:xfrm>'


def paragraph(text: str, level: int = 0) -> str:
    return f'<a:p><a:pPr lvl="{level}"/><a:r><a:t>{text}</a:t></a:r></a:p>'


def title(text: str) -> str:
    return f'<p:sp><p:nvSpPr><p:cNvPr id="2" name="t"/><p:cNvSpPr/><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr><p:spPr/><p:txBody>{paragraph(text)}</p:txBody></p:sp>'


def box(paragraphs: str, top: int | None = 0, left: int | None = 0) -> str:
    return f'<p:sp><p:nvSpPr><p:cNvPr id="3" name="b"/><p:cNvSpPr/><p:nvPr/></p:nvSpPr><p:spPr>{off(top, left)}</p:spPr><p:txBody>{paragraphs}</p:txBody></p:sp>'


def group(inner: str, top: int = 0, left: int = 0) -> str:
    return f'<p:grpSp><p:nvGrpSpPr><p:cNvPr id="9" name="g"/></p:nvGrpSpPr><p:grpSpPr>{off(top, left)}</p:grpSpPr>{inner}</p:grpSp>'


def frame(uri: str, inner: str, top: int = 0, left: int = 0) -> str:
    return f'<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="4" name="f"/></p:nvGraphicFramePr><p:xfrm><a:off x="{left}" y="{top}"/></p:xfrm><a:graphic><a:graphicData uri="{uri}">{inner}</a:graphicData></a:graphic></p:graphicFrame>'


def slide_table(rows: list[list[str]], top: int = 0) -> str:
    cells = "".join("<a:tr>" + "".join(f"<a:tc><a:txBody>{paragraph(c)}</a:txBody></a:tc>" for c in r) + "</a:tr>" for r in rows)
    return frame("http://schemas.openxmlformats.org/drawingml/2006/table", f"<a:tbl>{cells}</a:tbl>", top)


def picture(rel: str, alt: str = "", top: int = 0) -> str:
    return f'<p:pic><p:nvPicPr><p:cNvPr id="5" name="p" descr="{alt}"/><p:cNvPicPr/><p:nvPr/></p:nvPicPr><p:blipFill><a:blip r:embed="{rel}"/></p:blipFill><p:spPr>{off(top, 0)}</p:spPr></p:pic>'


def pptx(slides: list[str], media: dict[str, bytes] | None = None, notes: dict[int, str] | None = None) -> bytes:
    media, notes = media or {}, notes or {}
    members: dict[str, str | bytes] = {"[Content_Types].xml": TYPES}
    ids = "".join(f'<p:sldId id="{256 + i}" r:id="rId{i}"/>' for i in range(len(slides)))
    members["ppt/presentation.xml"] = f"<p:presentation {OPEN}><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>"
    members["ppt/_rels/presentation.xml.rels"] = rels({f"rId{i}": ("slide", f"slides/slide{i + 1}.xml") for i in range(len(slides))})
    for i, inner in enumerate(slides):
        members[f"ppt/slides/slide{i + 1}.xml"] = f"<p:sld {OPEN}><p:cSld><p:spTree><p:nvGrpSpPr/><p:grpSpPr/>{inner}</p:spTree></p:cSld></p:sld>"
        entries = {f"m{k}": ("image", f"../media/{name}") for k, name in enumerate(media)}
        if i in notes:
            entries["n"] = ("notesSlide", f"../notesSlides/notesSlide{i + 1}.xml")
            members[f"ppt/notesSlides/notesSlide{i + 1}.xml"] = f'<p:notes {OPEN}><p:cSld><p:spTree><p:sp><p:nvSpPr><p:cNvPr id="3" name="n"/><p:cNvSpPr/><p:nvPr><p:ph type="body" idx="1"/></p:nvPr></p:nvSpPr><p:spPr/><p:txBody>{paragraph(notes[i])}</p:txBody></p:sp></p:spTree></p:cSld></p:notes>'
        members[f"ppt/slides/_rels/slide{i + 1}.xml.rels"] = rels(entries)
    return zipped(members | {f"ppt/media/{n}": c for n, c in media.items()})


def run(text: str, marks: str = "") -> str:
    return f"<w:r><w:rPr>{marks}</w:rPr><w:t>{text}</w:t></w:r>"


def para(inner: str, style: str = "", extra: str = "") -> str:
    return f'<w:p><w:pPr>{f"<w:pStyle w:val={chr(34)}{style}{chr(34)}/>" if style else ""}{extra}</w:pPr>{inner}</w:p>'


def drawing(rel: str, alt: str = "") -> str:
    return f'<w:r><w:drawing><wp:inline><wp:docPr id="1" name="i" descr="{alt}"/><a:graphic><a:graphicData><a:blip r:embed="{rel}"/></a:graphicData></a:graphic></wp:inline></w:drawing></w:r>'


def docx(body: str, media: dict[str, bytes] | None = None, links: dict[str, str] | None = None, extra: dict[str, str] | None = None) -> bytes:
    media, links = media or {}, links or {}
    styles = "".join(f'<w:style w:styleId="Heading{i}"><w:name w:val="heading {i}"/></w:style>' for i in range(1, 7))
    numbering = '<w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum><w:abstractNum w:abstractNumId="1"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="1"/></w:num>'
    members: dict[str, str | bytes] = {
        "[Content_Types].xml": TYPES,
        "word/document.xml": f"<w:document {OPEN}><w:body>{body}</w:body></w:document>",
        "word/styles.xml": f"<w:styles {OPEN}>{styles}</w:styles>",
        "word/numbering.xml": f"<w:numbering {OPEN}>{numbering}</w:numbering>",
        "word/_rels/document.xml.rels": rels({f"m{k}": ("image", f"media/{n}") for k, n in enumerate(media)} | {k: ("hyperlink", v) for k, v in links.items()}),
    }
    return zipped(members | (extra or {}) | {f"word/media/{n}": c for n, c in media.items()})


def control(inner: str) -> str:
    """A content control around blocks, runs, rows or cells."""
    return f'<w:sdt><w:sdtPr><w:alias w:val="field"/></w:sdtPr><w:sdtContent>{inner}</w:sdtContent></w:sdt>'


def item(text: str, number: int, level: int = 0) -> str:
    return para(run(text), extra=f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{number}"/></w:numPr>')


def notes(kind: str, texts: dict[int, str]) -> str:
    """The part of footnotes or endnotes."""
    return f"<w:{kind}s {OPEN}>" + "".join(f'<w:{kind} w:id="{i}">{para(run(t))}</w:{kind}>' for i, t in texts.items()) + f"</w:{kind}s>"


def word_cell(inner: str, properties: str = "") -> str:
    return f"<w:tc><w:tcPr>{properties}</w:tcPr>{inner}</w:tc>"


def numberings(levels: dict[int, list[tuple[str, int]]], lists: dict[int, tuple[int, dict[int, int]]]) -> str:
    """levels: abstract list -> format and start of each level. lists: numbering id -> abstract list and the starts it sets itself."""
    abstract = "".join(f'<w:abstractNum w:abstractNumId="{a}">' + "".join(f'<w:lvl w:ilvl="{d}"><w:start w:val="{start}"/><w:numFmt w:val="{kind}"/></w:lvl>' for d, (kind, start) in enumerate(depths)) + "</w:abstractNum>" for a, depths in levels.items())
    nums = "".join(f'<w:num w:numId="{n}"><w:abstractNumId w:val="{a}"/>' + "".join(f'<w:lvlOverride w:ilvl="{d}"><w:startOverride w:val="{start}"/></w:lvlOverride>' for d, start in starts.items()) + "</w:num>" for n, (a, starts) in lists.items())
    return f"<w:numbering {OPEN}>{abstract}{nums}</w:numbering>"


def word_table(rows: list[list[str]]) -> str:
    return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{para(run(c))}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"


def pdf(pages: list[str], images: dict[str, tuple[int, int, bytes]] | None = None, packed: bool = False, encrypted: bool = False, jpegs: dict[str, bytes] | None = None) -> bytes:
    """pages: content streams. images: name -> width, height, grey bytes. packed: dictionaries in an object stream, without a table. jpegs: name -> file."""
    images = images or {}
    objects: list[bytes] = [b"", b""]  # catalogue and page tree, filled in below
    font = len(objects) + 1
    objects.append(b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding>>")
    names = {}
    for name, (w, h, data) in images.items():
        body = zlib.compress(data)
        objects.append(b"<</Type/XObject/Subtype/Image/Width %d/Height %d/ColorSpace/DeviceGray/BitsPerComponent 8/Filter/FlateDecode/Length %d>>\nstream\n%s\nendstream" % (w, h, len(body), body))
        names[name] = len(objects)
    for name, data in (jpegs or {}).items():
        objects.append(b"<</Type/XObject/Subtype/Image/Width 8/Height 8/ColorSpace/DeviceRGB/BitsPerComponent 8/Filter/DCTDecode/Length %d>>\nstream\n%s\nendstream" % (len(data), data))
        names[name] = len(objects)
    kids = []
    for content in pages:
        body = zlib.compress(content.encode("cp1252"))
        objects.append(b"<</Filter/FlateDecode/Length %d>>\nstream\n%s\nendstream" % (len(body), body))
        x = b"".join(b"/%s %d 0 R" % (n.encode(), i) for n, i in names.items() if f"/{n} Do" in content)
        objects.append(b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 600 800]/Contents %d 0 R/Resources<</Font<</F1 %d 0 R>>/XObject<<%s>>>>>>" % (len(objects), font, x))
        kids.append(len(objects))
    objects[0] = b"<</Type/Catalog/Pages 2 0 R>>"
    objects[1] = b"<</Type/Pages/Count %d/Kids[%s]>>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    out = bytearray(b"%PDF-1.7\n")
    plain = [(i, o) for i, o in enumerate(objects, 1) if not packed or b"stream" in o]
    for i, o in plain:
        out += b"%d 0 obj\n%s\nendobj\n" % (i, o)
    if packed:
        inner = [(i, o) for i, o in enumerate(objects, 1) if b"stream" not in o]
        heads, bodies = b"", b""
        for i, o in inner:
            heads += b"%d %d " % (i, len(bodies))
            bodies += o + b" "
        body = zlib.compress(heads + bodies)
        out += b"90 0 obj\n<</Type/ObjStm/N %d/First %d/Filter/FlateDecode/Length %d>>\nstream\n%s\nendstream\nendobj\n" % (len(inner), len(heads), len(body), body)
    return bytes(out) + b"trailer\n<</Root 1 0 R%s>>\nstartxref\n0\n%%%%EOF" % (b"/Encrypt 99 0 R" if encrypted else b"")


def pdf_with_images(images: list[tuple[str, bytes]], extra: list[bytes] = (), text: str = "") -> bytes:
    """A page that draws images, each with its dictionary's entries and its bytes; extra objects are numbered from 20 (up to 14 images)."""
    content = (text + " ".join(f"q 9 0 0 9 0 0 cm /I{k} Do Q" for k in range(len(images)))).encode("cp1252")
    names = " ".join(f"/I{k} {5 + k} 0 R" for k in range(len(images))).encode()
    objects = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Count 1/Kids[3 0 R]>>", 3: b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 600 800]/Contents 4 0 R/Resources<</Font<</F1 19 0 R>>/XObject<<%s>>>>>>" % names}
    objects[4] = b"<</Length %d>>\nstream\n%s\nendstream" % (len(content), content)
    objects |= {5 + k: b"<</Type/XObject/Subtype/Image%s/Length %d>>\nstream\n%s\nendstream" % (e.encode("latin-1"), len(d), d) for k, (e, d) in enumerate(images)}
    objects[19] = b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding>>"
    objects |= {20 + k: o for k, o in enumerate(extra)}
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % o for o in objects.items()) + b"trailer\n<</Root 1 0 R>>\nstartxref\n0\n%%EOF"


def pdf_with_image(entries: str, data: bytes, extra: list[bytes] = ()) -> bytes:
    return pdf_with_images([(entries, data)], extra)


def merged_grid(boxes: dict[tuple[int, int, int, int], str], left: int = 50, top: int = 700, width: int = 120, height: int = 20) -> str:
    """Cells (top, bottom, left, right, ends excluded), each with its own border and its text in its first row."""
    out = ""
    for (t, b, l, r), text in boxes.items():
        out += f"{left + l * width} {top - b * height} {(r - l) * width} {(b - t) * height} re S\n" + text_at(left + l * width + 4, top - (t + 1) * height + 6, text, 10)
    return out


def nested_forms(depth: int, times: int) -> bytes:
    """A page that draws a form so many times, which draws another so many times, and so on."""
    objects = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Count 1/Kids[3 0 R]>>", b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 9 9]/Contents 4 0 R/Resources<</XObject<</X 5 0 R>>>>>>"]
    body = b"/X Do " * times
    objects.append(b"<</Length %d>>\nstream\n%s\nendstream" % (len(body), body))
    for i in range(depth):
        objects.append(b"<</Type/XObject/Subtype/Form/Length %d/Resources<</XObject<</X %d 0 R>>>>>>\nstream\n%s\nendstream" % (len(body), 6 + i, body))
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objects, 1)) + b"trailer\n<</Root 1 0 R>>\nstartxref\n0\n%%EOF"


def text_at(x: float, y: float, text: str, size: int = 12) -> str:
    return f"BT /F1 {size} Tf {x} {y} Td ({text}) Tj ET\n"


def grid(rows: list[list[str]], left: int = 50, top: int = 700, width: int = 120, height: int = 20) -> str:
    out = ""
    for i in range(len(rows) + 1):
        out += f"{left} {top - i * height} m {left + width * len(rows[0])} {top - i * height} l S\n"
    for j in range(len(rows[0]) + 1):
        out += f"{left + j * width} {top} m {left + j * width} {top - height * len(rows)} l S\n"
    for i, r in enumerate(rows):
        for j, c in enumerate(r):
            out += text_at(left + j * width + 4, top - (i + 1) * height + 6, c, 10)
    return out


def cmap4(codes: dict[int, int]) -> bytes:
    """A table of codes and glyphs, of format 4 with a segment for each code."""
    rows = [*sorted(codes.items()), (0xFFFF, 0)]
    n = len(rows)
    starts = b"".join(struct.pack(">H", c) for c, _ in rows)
    deltas = b"".join(struct.pack(">H", (g - c) & 0xFFFF) for c, g in rows)
    body = struct.pack(">4H", n * 2, 0, 0, 0) + starts + b"\0\0" + starts + deltas + bytes(2 * n)
    return struct.pack(">3H", 4, 6 + len(body), 0) + body


def truetype(maps: dict[tuple[int, int], bytes], post: bytes = b"") -> bytes:
    """A font program with tables of codes by platform and kind, and one of names."""
    head = struct.pack(">2H", 0, len(maps))
    at, records, body = 4 + 8 * len(maps), b"", b""
    for (platform, kind), table in maps.items():
        records += struct.pack(">2HL", platform, kind, at + len(body))
        body += table
    tables = {b"cmap": head + records + body} | ({b"post": post} if post else {})
    out, data = b"\0\1\0\0" + struct.pack(">4H", len(tables), 0, 0, 0), b""
    for name, table in tables.items():
        out += struct.pack(">4s3L", name, 0, 12 + 16 * len(tables) + len(data), len(table))
        data += table
    return out + data


def subset_pdf(text: str, map_name: str = "Identity-H") -> bytes:
    """A page in a subset font that brings no map: codes are glyphs, and only its program tells their characters. Identity-V: a line that runs downwards."""
    glyphs = {ord(c): g for g, c in enumerate(sorted(set(text)), 1)}
    program = zlib.compress(truetype({(3, 1): cmap4(glyphs)}))
    content = f"BT /F1 12 Tf 50 700 Td <{''.join(f'{glyphs[ord(c)]:04x}' for c in text)}> Tj ET".encode()
    objects = [
        b"<</Type/Catalog/Pages 2 0 R>>",
        b"<</Type/Pages/Count 1/Kids[3 0 R]>>",
        b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 600 800]/Contents 4 0 R/Resources<</Font<</F1 5 0 R>>>>>>",
        b"<</Length %d>>\nstream\n%s\nendstream" % (len(content), content),
        f"<</Type/Font/Subtype/Type0/Encoding/{map_name}/DescendantFonts[<</Type/Font/Subtype/CIDFontType2/DW 500/FontDescriptor<</FontFile2 6 0 R>>>>]>>".encode(),
        b"<</Filter/FlateDecode/Length %d>>\nstream\n%s\nendstream" % (len(program), program),
    ]
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objects, 1)) + b"trailer\n<</Root 1 0 R>>\n"
