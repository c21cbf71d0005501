from __future__ import annotations

import io
import re
import subprocess
import sys
import time
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioflow.config import Limits
from folioflow.operators.convert import convert_folder, converted, delivered
from folioflow.sources import extract as extract_module
from folioflow.sources import samples as s
from folioflow.sources.extract import isolated
from folioflow.streaming.convert import convert_stream, outcomes

LOGO, OTHER = s.png(1), s.png(2)
BULLET = '<w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr>'
PIXELS = {"I": (2, 2, bytes(4))}


def samples() -> dict[str, bytes]:
    return {
        "text-only.pptx": s.pptx([s.title("First  slide") + s.box(s.paragraph("a") + s.paragraph("b", 1) + s.paragraph("c")), s.title("Two") + s.box(s.paragraph("single"))]),
        "images.pptx": s.pptx([s.picture("m0", "logo.png"), s.picture("m0", "The logo"), s.picture("m0") + s.picture("m1", top=5)], {"l.png": LOGO, "m.png": OTHER}),
        "tables.pptx": s.pptx([s.slide_table([["R|x", "Q1"], ["N"], ["S", "2"]])]),
        "charts.pptx": s.pptx([s.frame("http://x/chart", "") + s.frame("http://x/chart", "") + s.frame("http://x/diagram", "")]),
        "grouped.pptx": s.pptx([s.box(s.paragraph("last"), 9, 0) + s.group(s.box(s.paragraph("second"), 5, 0) + s.box(s.paragraph("first"), 1, 0))]),
        "notes.pptx": s.pptx([s.title("T")], notes={0: "confidential"}),
        "empty.pptx": s.pptx([]),
        "wmf.pptx": s.pptx([s.picture("m0")], {"l.wmf": b"x"}),
        "headings.docx": s.docx("".join(s.para(s.run(f"H{i}"), f"Heading{i}") for i in (1, 2, 3)) + s.para(s.run("plain ") + s.run("bold ", "<w:b/>") + s.run("it", "<w:i/>")) + s.para(s.run("one"), extra=BULLET) + s.para(s.run("two"), extra=BULLET)),
        "images.docx": s.docx(s.para(s.drawing("m0", "logo")) + s.para(s.drawing("m0")) + s.para(s.drawing("m1")), {"l.png": LOGO, "m.png": OTHER}),
        "text.pdf": s.pdf([s.text_at(50, 700, "Hello \\(x\\)") + s.text_at(50, 680, "Second line")]),
        "multipage.pdf": s.pdf([s.text_at(50, 700, f"Text of {i}") for i in (1, 2, 3)], packed=True),
        "scan.pdf": s.pdf(["q 600 0 0 800 0 0 cm /I Do Q"], PIXELS),
        "small-image.pdf": s.pdf([s.text_at(50, 700, "Some text that is longer than forty characters") + "q 60 0 0 80 0 0 cm /I Do Q"], PIXELS),
        "tables.pdf": s.pdf([s.text_at(50, 750, "Intro") + s.grid([["Region", "Q1"], ["North", "1"], ["South", ""]])]),
        "broken-page.pdf": s.pdf(["BT /F1 12 Tf (unfinished"]),
    }


REJECTED = {
    "fake.pdf": (b"plain text", "INVALID_FILE_FORMAT"),
    "renamed.docx": (s.zipped({"x": "y"}), "INVALID_FILE_FORMAT"),
    "unsafe.docx": (s.zipped({"[Content_Types].xml": "", "word/document.xml": "<a/>", "../evil": "x"}), "OFFICE_ARCHIVE_UNSAFE"),
    "bomb.docx": (s.zipped({"[Content_Types].xml": "", "word/document.xml": b"0" * (40 << 20)}), "OFFICE_ARCHIVE_UNSAFE"),
    "encrypted.docx": (bytes.fromhex("D0CF11E0A1B11AE1") + bytes(512), "PASSWORD_PROTECTED"),
    "encrypted.pdf": (s.pdf(["x"], encrypted=True), "PASSWORD_PROTECTED"),
    "damaged.pptx": (b"PK\x03\x04 damaged", "INVALID_FILE_FORMAT"),
    "entities.docx": (s.zipped({"[Content_Types].xml": "", "word/document.xml": '<!DOCTYPE a [<!ENTITY b "c">]><a/>'}), "CONVERSION_FAILED"),
    "macro.docm": (b"PK", "UNSUPPORTED_FILE_TYPE"),
    "nothing.pdf": (b"", "DOWNLOAD_FAILED"),
}


def frame(spark, files: dict[str, bytes]):
    return spark.createDataFrame([(f"in/{k}", len(v), bytearray(v)) for k, v in files.items()], "path string, length bigint, content binary")


@pytest.fixture(scope="module")
def results(spark):
    return {r["path"][3:]: r for r in converted(frame(spark, samples())).collect()}


def test_slides(results):
    assert results["text-only.pptx"]["markdown"] == "## Slide 1 — First slide\n\n- a\n  - b\n- c\n\n---\n\n## Slide 2 — Two\n\nsingle\n"
    images = results["images.pptx"]
    assert [m["name"] for m in images["media"]] == ["slide-001-image-001.png", "slide-003-image-002.png"]
    assert images["markdown"].count("slide-001-image-001.png") == 3 and "![The logo]" in images["markdown"] and "logo.png" not in images["markdown"]
    assert "| R\\|x | Q1 |\n| --- | --- |\n| N |  |\n| S | 2 |" in results["tables.pptx"]["markdown"]
    assert results["charts.pptx"]["warnings"] == ["Slide 1 contains a chart. Chart data is not converted.", "Slide 1 contains SmartArt. SmartArt is not converted."]
    assert re.findall("first|second|last", results["grouped.pptx"]["markdown"]) == ["first", "second", "last"]
    assert "confidential" not in results["notes.pptx"]["markdown"]
    assert (results["empty.pptx"]["markdown"], results["empty.pptx"]["pages_or_slides"]) == ("\n", 0)
    assert results["wmf.pptx"]["warnings"] == ["Slide 1 contains a WMF image. It was left unconverted."]


def test_word(results):
    assert results["headings.docx"]["markdown"] == "# H1\n\n## H2\n\n### H3\n\nplain **bold** *it*\n\n- one\n- two\n"
    assert results["headings.docx"]["pages_or_slides"] is None
    assert results["images.docx"]["media_count"] == 2
    assert results["images.docx"]["markdown"] == "![logo](media/image1.png)\n\n![Image](media/image1.png)\n\n![Image](media/image2.png)\n"


def test_pages(results):
    assert results["text.pdf"]["markdown"] == "## Page 1\n\nHello (x)\nSecond line\n"
    assert results["multipage.pdf"]["markdown"].count("---") == 2 and results["multipage.pdf"]["pages_or_slides"] == 3
    assert results["scan.pdf"]["warnings"] == ["Page 1 may be scanned or image-based. Text extraction may be incomplete."]
    assert results["small-image.pdf"]["warnings"] == [] and results["small-image.pdf"]["media_count"] == 1
    assert "| Region | Q1 |\n| --- | --- |\n| North | 1 |\n| South |  |" in results["tables.pdf"]["markdown"]


def test_every_output_keeps_the_contract(results):
    for name, r in results.items():
        assert r["error_code"] is None, name
        names, links = [m["name"] for m in r["media"]], re.findall(r"!\[[^\]]*\]\(media/([^)]+)\)", r["markdown"])
        assert set(links) == set(names), name
        assert len(set(names)) == len(names) == r["media_count"]
        assert not re.search(r"<(img|table|span|br|div)\b|\r|/tmp|file:", r["markdown"])
        assert r["markdown"].endswith("\n") and len(r["warnings"]) == len(set(r["warnings"]))
        assert r["shape"] == ("zip" if names else "md")


def test_rejections(spark):
    got = {r["path"][3:]: (r["error_code"], r["markdown"]) for r in converted(frame(spark, {k: v for k, (v, _) in REJECTED.items()})).collect()}
    assert got == {k: (code, None) for k, (_, code) in REJECTED.items()}


def test_switches(spark):
    docs = {k: samples()[k] for k in ("images.pptx", "images.docx", "small-image.pdf", "notes.pptx", "tables.pdf")}
    got = {r["path"][3:]: r for r in converted(frame(spark, docs), Limits(include_media=False, notes=True, max_table_pages=0)).collect()}
    assert all(r["shape"] == "md" and "](media" not in r["markdown"] for r in got.values())
    assert "**Speaker notes:** confidential" in got["notes.pptx"]["markdown"]
    assert "| Region" not in got["tables.pdf"]["markdown"] and len(got["tables.pdf"]["warnings"]) == 1
    small = converted(frame(spark, {"images.pptx": samples()["images.pptx"]}), Limits(max_output_bytes=100)).first()
    assert small["error_code"] == "DOCUMENT_EXPANDS_TOO_LARGE" and small["markdown"] is None


def test_every_document_is_parsed_in_a_process_that_can_be_ended():
    assert isolated("pdf", samples()["text.pdf"], Limits()).parts == 1
    before = extract_module._child[0].process.pid
    assert isolated("pdf", b"x", Limits()).error_code == "INVALID_FILE_FORMAT"
    assert extract_module._child[0].process.pid == before  # kept for the next document
    small = s.nested_forms(9, 60)
    assert len(small) < 8000
    begun = time.perf_counter()
    assert isolated("pdf", small, Limits(child_timeout=2)).error_code == "CONVERSION_TIMEOUT"
    assert time.perf_counter() - begun < 10
    assert isolated("docx", samples()["headings.docx"], Limits(child_timeout=0)).error_code is None  # replaced; Word documents have a limit of their own
    assert isolated("docx", samples()["headings.docx"], Limits(word_timeout=0)).error_code == "CONVERSION_TIMEOUT"
    isolated("pdf", samples()["text.pdf"], Limits())
    extract_module._child[0].process.kill()
    assert isolated("pdf", samples()["text.pdf"], Limits()).error_code == "CONVERSION_FAILED"
    assert isolated("pdf", samples()["text.pdf"], Limits()).parts == 1


def test_a_child_leaves_with_its_worker(tmp_path):
    code = "import sys; from folioflow.config import Limits; from folioflow.sources import extract, samples; extract.isolated('pdf', b'x', Limits()); print(extract._child[0].process.pid); sys.stdout.flush(); extract.isolated('pdf', samples.nested_forms(9, 60), Limits())"
    worker = subprocess.Popen([sys.executable, "-c", code], stdout=subprocess.PIPE)
    child = int(worker.stdout.readline())
    worker.kill()
    worker.wait()
    for _ in range(100):
        if not Path(f"/proc/{child}").exists():
            return
        time.sleep(0.1)
    raise AssertionError("it is still there")


def test_delivery(spark):
    out = {r["name"]: bytes(r["content"]) for r in delivered(converted(frame(spark, {k: samples()[k] for k in ("images.pptx", "text.pdf")}))).collect()}
    assert out["text.md"].startswith(b"## Page 1")
    with zipfile.ZipFile(io.BytesIO(out["images_markdown.zip"])) as z:
        assert z.namelist() == ["images_markdown/images.md", "images_markdown/media/slide-001-image-001.png", "images_markdown/media/slide-003-image-002.png"]
        assert z.read("images_markdown/media/slide-001-image-001.png") == LOGO


def test_a_folder_and_a_stream(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    for name in ("images.pptx", "text.pdf", "headings.docx"):
        (landing / name).write_bytes(samples()[name])
    for name in ("fake.pdf", "macro.docm", "nothing.pdf"):
        (landing / name).write_bytes(REJECTED[name][0])
    codes = {r["path"].rsplit("/", 1)[-1]: r["error_code"] for r in convert_folder(spark, str(landing)).select("path", "error_code").collect()}
    assert codes == {"images.pptx": None, "text.pdf": None, "headings.docx": None, "fake.pdf": "INVALID_FILE_FORMAT", "macro.docm": "UNSUPPORTED_FILE_TYPE"}
    root = tmp_path / "out"
    query = convert_stream(spark, str(landing), str(root), str(tmp_path / "checkpoint"), delete_sources=True)
    query.awaitTermination(120)
    assert sorted(p.name for p in root.glob("files/*/*")) == ["headings.md", "images_markdown.zip", "text.md"]
    assert sorted(p.name for p in landing.iterdir()) == ["fake.pdf", "macro.docm", "nothing.pdf"]
    rows = outcomes(spark, str(root))
    assert rows.where(F.col("error_code").isNotNull()).count() == 2 and rows.where("error_code IS NULL AND n_bytes > 0").count() == 3
    assert not {"markdown", "media", "content"} & set(rows.columns)  # contents are written once, as files
