from __future__ import annotations

import pytest

from folioflow.sources import docx
from folioflow.sources import samples as s

INS, DEL = '<w:ins w:id="1" w:author="a">{}</w:ins>', '<w:del w:id="1" w:author="a">{}</w:del>'


def blocks(body: str, **parts) -> list[str]:
    """The blocks of a document's Markdown, tables as rows."""
    return [i.text if i.kind == "raw" else i.rows for i in items(body, **parts) if i.kind in ("raw", "table")]


def items(body: str, **parts):
    return docx.extract(s.docx(body, **parts)).items


def warned(body: str, **parts) -> list[str]:
    return [i.text for i in items(body, **parts) if i.kind == "warning"]


P = lambda t, **k: s.para(s.run(t), **k)


def test_blocks_in_content_controls_and_custom_xml():
    nested = s.control(P("in") + s.control(s.word_table([["a"]]) + '<w:customXml w:element="x">' + P("deeper") + "</w:customXml>"))
    assert blocks(P("before") + nested + P("after")) == ["before", "in", [["a"]], "deeper", "after"]
    rows = s.control("<w:tr>" + s.control(s.word_cell(s.control(P("x")) + P("y"))) + "</w:tr>")
    assert blocks(f"<w:tbl>{rows}</w:tbl>") == [[["x y"]]]
    assert blocks(f'<w:unknown xmlns:z="z"><z:q>{P("kept")}</z:q></w:unknown>') == ["kept"]


def test_moved_inserted_and_deleted_text():
    assert blocks(s.para('<w:moveFrom w:id="1">' + s.run("old") + "</w:moveFrom>" + s.run("stays ") + '<w:moveTo w:id="2">' + s.run("new") + "</w:moveTo>")) == ["stays new"]
    assert blocks('<w:moveTo w:id="2">' + P("block") + "</w:moveTo>" + DEL.format(P("gone")) + INS.format(P("added"))) == ["block", "added"]
    assert blocks(s.para(s.run("one "), extra='<w:rPr><w:del w:id="1"/></w:rPr>') + P("paragraph")) == ["one paragraph"]
    assert blocks(s.para(s.run("last"), extra='<w:rPr><w:del w:id="1"/></w:rPr>')) == ["last"]
    deleted_row = '<w:tbl><w:tr><w:trPr><w:del w:id="1"/></w:trPr>' + s.word_cell(P("no")) + "</w:tr><w:tr>" + s.word_cell(P("yes")) + "</w:tr></w:tbl>"
    assert blocks(deleted_row) == [[["yes"]]]


def test_alternate_content_is_read_once():
    box = "<mc:AlternateContent><mc:Choice Requires='wps'><w:drawing><wps:txbx><w:txbxContent>{0}</w:txbxContent></wps:txbx></w:drawing></mc:Choice><mc:Fallback><w:pict><v:textbox><w:txbxContent>{0}</w:txbxContent></v:textbox></w:pict></mc:Fallback></mc:AlternateContent>"
    assert blocks(s.para(s.run("text") + f"<w:r>{box.format(P('boxed') + s.word_table([['t']]))}</w:r>") + P("next")) == ["text", "boxed", [["t"]], "next"]
    empty = "<mc:AlternateContent><mc:Choice Requires='new'><w:drawing/></mc:Choice><mc:Fallback>" + s.run("old form") + "</mc:Fallback></mc:AlternateContent>"
    assert blocks(s.para(empty)) == ["old form"]
    assert blocks("<mc:AlternateContent><mc:Choice Requires='x'>" + P("choice") + "</mc:Choice><mc:Fallback>" + P("fallback") + "</mc:Fallback></mc:AlternateContent>") == ["choice"]


NUMBERS = s.numberings({0: [("decimal", 1), ("lowerLetter", 1), ("decimal", 5)], 1: [("bullet", 1), ("decimal", 1)], 2: [("decimal", 4)]}, {1: (0, {}), 2: (0, {0: 1}), 3: (1, {}), 4: (2, {}), 5: (0, {})})


def numbered(*rows) -> list[str]:
    return blocks("".join(s.item(t, n, d) if n else P(t) for t, n, d in rows), extra={"word/numbering.xml": NUMBERS})


def test_numbers_run_on_and_start_anew():
    assert numbered(("a", 1, 0), ("b", 1, 0), ("text", 0, 0), ("c", 1, 0)) == ["1. a\n2. b", "text", "3. c"]
    assert numbered(("a", 1, 0), ("b", 1, 0), ("c", 2, 0), ("d", 2, 0)) == ["1. a\n2. b\n1) c\n2) d"]  # a start of its own
    assert numbered(("a", 1, 0), ("b", 5, 0)) == ["1. a\n2. b"]  # the same abstract list
    assert numbered(("a", 4, 0), ("b", 4, 0)) == ["4. a\n5. b"]
    assert numbered(("a", 1, 0), ("x", 1, 1), ("y", 1, 1), ("b", 1, 0), ("z", 1, 1)) == ["1. a\n   1. x\n   2. y\n2. b\n   1. z"]
    assert numbered(("a", 3, 0), ("x", 3, 1), ("y", 3, 1), ("b", 3, 0)) == ["- a\n  1. x\n  2. y\n- b"]
    long = numbered(*[("i", 1, 0)] * 10, ("in", 1, 1))
    assert long[0].endswith("10. i\n    1. in")


def test_levels_that_do_not_start_anew():
    xml = NUMBERS.replace('<w:lvl w:ilvl="1"><w:start w:val="1"/>', '<w:lvl w:ilvl="1"><w:start w:val="1"/><w:lvlRestart w:val="0"/>', 1)
    rows = s.item("a", 1) + s.item("x", 1, 1) + s.item("b", 1) + s.item("y", 1, 1)
    assert blocks(rows, extra={"word/numbering.xml": xml}) == ["1. a\n   1. x\n2. b\n   2. y"]


def test_lists_by_style():
    styles = f'<w:styles {s.OPEN}><w:style w:styleId="Base"><w:name w:val="b"/><w:pPr><w:numPr><w:numId w:val="1"/></w:numPr></w:pPr></w:style><w:style w:styleId="Own"><w:name w:val="o"/><w:basedOn w:val="Base"/></w:style><w:style w:styleId="Loop"><w:name w:val="l"/><w:basedOn w:val="Loop"/></w:style></w:styles>'
    body = P("a", style="Own") + P("b", style="Base") + P("c", style="Loop") + s.para(s.run("d"), "Own", '<w:numPr><w:numId w:val="0"/></w:numPr>')
    assert blocks(body, extra={"word/numbering.xml": NUMBERS, "word/styles.xml": styles}) == ["1. a\n2. b", "c", "d"]


def test_merged_cells():
    merge = lambda kind: f"<w:vMerge{' w:val=' + chr(34) + kind + chr(34) if kind else ''}/>"
    rows = [
        s.word_cell(P("top"), merge("restart")) + s.word_cell(P("wide"), '<w:gridSpan w:val="2"/>') + s.word_cell(P("r")),
        s.word_cell(P(""), merge("")) + s.word_cell(P("b")) + s.word_cell(P("c"), merge("restart")) + s.word_cell(P("d")),
        s.word_cell(P("hidden"), merge("continue")) + s.word_cell(P("e")) + s.word_cell(P(""), merge("")) + s.word_cell(P("f")),
        s.word_cell(P("new"), merge("restart")) + s.word_cell(P("g")) + s.word_cell(P("h")) + s.word_cell(P("i")),
    ]
    assert blocks("<w:tbl>" + "".join(f"<w:tr>{r}</w:tr>" for r in rows) + "</w:tbl>") == [[["top hidden", "wide", "", "r"], ["", "b", "c", "d"], ["", "e", "", "f"], ["new", "g", "h", "i"]]]
    shifted = '<w:tbl><w:tr><w:trPr><w:gridBefore w:val="1"/><w:gridAfter w:val="1"/></w:trPr>' + s.word_cell(P("x")) + "</w:tr></w:tbl>"
    assert blocks(shifted) == [[["", "x", ""]]]
    assert blocks("<w:tbl><w:tr>" + s.word_cell(P("a"), '<w:hMerge w:val="restart"/>') + s.word_cell(P("b"), "<w:hMerge/>") + s.word_cell(P("c")) + "</w:tr></w:tbl>") == [[["a b", "", "c"]]]
    assert blocks("<w:tbl><w:tr>" + s.word_cell(P("o") + s.word_table([["i", "j"]]) + P("p")) + "</w:tr></w:tbl>") == [[["o i j p"]]]


def test_footnotes_and_endnotes():
    ref = lambda kind, i: f'<w:r><w:{kind}Reference w:id="{i}"/></w:r>'
    body = s.para(s.run("a") + ref("footnote", 2) + s.run("b") + ref("endnote", 2)) + s.para(ref("footnote", 2) + ref("endnote", 9))
    parts = {"word/footnotes.xml": s.notes("footnote", {2: "foot"}), "word/endnotes.xml": s.notes("endnote", {2: "end"})}
    assert blocks(body, extra=parts) == ["a[^1]b[^2]", "[^1]", "[^1]: foot", "[^2]: end"]
    own = s.notes("endnote", {2: "x"}).replace(s.run("x"), '<w:hyperlink r:id="q">' + s.run("site") + "</w:hyperlink>" + ref("endnote", 2))
    parts = {"word/endnotes.xml": own, "word/_rels/endnotes.xml.rels": s.rels({"q": ("hyperlink", "https://e.org/")})}
    assert blocks(s.para(ref("endnote", 2)), extra=parts) == ["[^1]", "[^1]: [site](https://e.org/)[^1]"]


def test_links_and_fields():
    field = lambda code, shown: f'<w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText>{code}</w:instrText></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r>{shown}<w:r><w:fldChar w:fldCharType="end"/></w:r>'
    assert blocks(s.para(field(" HYPERLINK &quot;https://a.b/c&quot; ", s.run("the ") + s.run("page", "<w:b/>")) + s.run(" after"))) == ["[the **page**](https://a.b/c) after"]
    assert blocks(s.para(field(" PAGE ", s.run("7")))) == ["7"]
    assert blocks(s.para('<w:hyperlink r:id="k">' + s.run("x") + INS.format(s.run("y")) + "</w:hyperlink>"), links={"k": "http://z/"}) == ["[xy](http://z/)"]
    assert blocks(s.para('<w:r><w:fldChar w:fldCharType="end"/></w:r>' + s.run("t"))) == ["t"]


def test_emphasis_joins_across_containers():
    assert blocks(s.para(s.run("a", "<w:b/>") + INS.format(s.run("b", "<w:b/>")) + s.control(s.run("c", "<w:b/>")) + s.run("d", "<w:b/><w:i/><w:strike/>"))) == ["**abc*****~~d~~***"]


@pytest.mark.parametrize(
    ("xml", "tex"),
    [
        ("<m:f><m:num><m:r><m:t>a</m:t></m:r></m:num><m:den><m:r><m:t>b</m:t></m:r></m:den></m:f>", r"\frac{a}{b}"),
        ("<m:sSup><m:e><m:r><m:t>x</m:t></m:r></m:e><m:sup><m:r><m:t>2</m:t></m:r></m:sup></m:sSup>", "{x}^{2}"),
        ("<m:rad><m:deg/><m:e><m:r><m:t>y</m:t></m:r></m:e></m:rad>", r"\sqrt{y}"),
        ('<m:nary><m:naryPr><m:chr m:val="∑"/></m:naryPr><m:sub><m:r><m:t>i</m:t></m:r></m:sub><m:sup><m:r><m:t>n</m:t></m:r></m:sup><m:e><m:r><m:t>i</m:t></m:r></m:e></m:nary>', r"\sum_{i}^{n}{i}"),
        ("<m:d><m:e><m:r><m:t>p</m:t></m:r></m:e><m:e><m:r><m:t>q</m:t></m:r></m:e></m:d>", r"\left(p|q\right)"),
        ("<m:unheard><m:r><m:t>kept</m:t></m:r></m:unheard>", "kept"),
    ],
)
def test_equations(xml, tex):
    assert blocks(s.para(s.run("See ") + f"<m:oMath>{xml}</m:oMath>")) == [f"See ${tex}$"]
    assert blocks(f"<m:oMathPara><m:oMath>{xml}</m:oMath></m:oMathPara>") == [f"$${tex}$$"]


def test_what_has_no_markdown_leaves_a_warning():
    chart = s.para('<w:r><w:drawing><a:graphic><a:graphicData uri="http://x/chart"/></a:graphic></w:drawing></w:r>')
    assert warned(chart) == ["The document contains a chart. Chart data is not converted."]
    assert warned(s.para("<w:r><w:object><v:shape/></w:object></w:r>")) == ["The document contains an embedded object. It is not converted."]
    assert warned('<w:altChunk r:id="x"/>') == ["The document contains another document. It is not converted."]
    assert warned(s.para(s.drawing("nowhere"))) == ["The document contains an image that could not be extracted."]
    assert warned(s.para('<w:r><w:sym w:font="Wingdings" w:char="F0FE"/></w:r>')) == ["The document contains a symbol that could not be converted."]
    assert blocks(s.para('<w:r><w:sym w:char="03B1"/></w:r>')) == ["α"]


def test_pictures_in_vml_and_text_boxes():
    picture = '<w:r><w:pict><v:shape><v:imagedata r:id="m0"/></v:shape></w:pict></w:r>'
    boxed = f"<w:r><w:drawing><wps:txbx><w:txbxContent>{s.para(s.drawing('m0', 'in a box'))}</w:txbxContent></wps:txbx></w:drawing></w:r>"
    assert blocks(s.para(picture) + s.para(boxed), media={"l.png": s.png(1)}) == ["![Image](media/image1.png)", "![in a box](media/image1.png)"]
