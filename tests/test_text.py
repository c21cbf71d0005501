from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from folioflow.functions import gfm, paths, text
from folioflow.functions.binary import image_extension
from folioflow.operators import ladder

#: One or two cases for each rule: folders, extensions, composition, letters that no name may hold, dots, spaces, length, devices, nothing left.
STEMS = {
    "minutes.pptx": "minutes",
    "archive/2024/Annual Budget.docx": "Annual Budget",
    "D:\\work\\drafts\\slides.pdf": "slides",
    "mixed/sep\\arators/x.pdf": "x",
    "up/../../and/away.pdf": "away",
    "notes.v2.final.docx": "notes.v2.final",
    "no extension": "no extension",
    "a|b?c*d.pdf": "a_b_c_d",
    'quote"d.docx': "quote_d",
    "tab\there.pdf": "tab_here",
    "del\x7fete.pdf": "del_ete",
    "wait....what.docx": "wait.what",
    ". . edges . ..pdf": "edges",
    "two  \u00a0 kinds\u3000of space.pdf": "two kinds of space",
    "A\u030angstro\u0308m.docx": "Ångström",
    "日本語の資料.pptx": "日本語の資料",
    "z" * 130 + ".docx": "z" * 120,
    "y" * 119 + ". tail.docx": "y" * 119,
    "aux.docx": "aux_file",
    "Com3.pptx": "Com3_file",
    "com10.pptx": "com10",
    "folder/": "document",
    " . ": "document",
    "\u2028": "document",
}


def test_stems_are_safe(evaluate):
    assert evaluate(lambda X: text.safe_stem(X), list(STEMS)) == list(STEMS.values())


def test_extensions_route(evaluate):
    names = ["a.docx", "a.DOCX", "b/a.pptx", "a.pdf", "a.doc", "a.docm", "a.ppt", "a.pptm", "a.xlsx", "a.rtf", "a.key", "a", ".pdf", "a.pdf/b"]
    assert evaluate(lambda X: ladder.source_type(X), names) == ["docx", "docx", "pptx", "pdf"] + [None] * 10
    assert evaluate(lambda X: ladder.declared(X, F.lit(1)), names[:5]) == [None] * 4 + ["UNSUPPORTED_FILE_TYPE"]


def test_cleaner(evaluate):
    cases = {"a \t\r\nb": "a\nb", "a\n\n\n\nb": "a\n\nb", "\u00a0 a\u2028b \u3000\n": "a\nb", "": "", " \n \n": "", "a\x0b\x0cb": "a\n\nb"}
    assert evaluate(lambda X: text.cleaned(X), list(cases)) == list(cases.values())


def python_cleaned(x: str) -> str:
    """The rule, step by step."""
    out: list[str] = []
    for one in x.splitlines():
        one = one.rstrip()
        if one or not out or out[-1]:
            out.append(one)
    return "\n".join(out).strip()


def test_ends_and_lines_as_python_takes_them(evaluate):
    rng = random.Random(6)
    odd = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    assert sorted(odd) == sorted(text.SPACES)
    cases = ["".join(rng.choice([*odd, "\n", "\r\n", " ", "a", ".", "\u200b", "é"]) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    assert evaluate(lambda X: text.strip(X), cases) == [c.strip() for c in cases]
    assert evaluate(lambda X: text.strip(X, "."), cases) == [c.strip("." + text.SPACES) for c in cases]
    assert evaluate(lambda X: text.squeezed(X), cases) == [" ".join(c.split()) for c in cases]
    assert evaluate(lambda X: text.cleaned(X), cases) == [python_cleaned(c) for c in cases]


@pytest.mark.parametrize("run", [" ", "\t \u3000", "\n", " \n", "\r\n\u2028", "a \t"])
def test_time_is_linear_in_white_space(evaluate, run):
    """A megabyte of it between two letters, for every expression that looks for white space."""
    long = "a" + run * (1_000_000 // len(run)) + "b"
    evaluate(lambda X: text.cleaned(X), ["a"])
    for expression in (text.cleaned, text.squeezed, text.strip, text.cell, text.safe_stem, text.slug, lambda X: text.strip(X, ".")):
        begun = time.perf_counter()
        evaluate(expression, [long])
        assert time.perf_counter() - begun < 3  # with what a query takes in any case
    begun = time.perf_counter()
    assert evaluate(text.cleaned, [long]) == [python_cleaned(long)]
    assert time.perf_counter() - begun < 3


def test_media_targets(evaluate):
    cases = {
        "media/fig.gif": "media/fig.gif",
        "./build/././media/fig.gif": "media/fig.gif",
        "/var/spool/x9/media/fig.gif": "media/fig.gif",
        "E:\\jobs\\7\\media\\deep\\fig.gif": "media/deep/fig.gif",
        "media/old/media/new/fig.gif": "media/new/fig.gif",
        "x//media//fig.gif": "media/fig.gif",
        "media": "media",
        "http://host.example/media/fig.gif": None,
        "data:text/plain,media/": None,
        "#media/fig": None,
        "multimedia/fig.gif": None,
        "Media/fig.gif": None,
        "": None,
    }
    assert evaluate(lambda X: paths.media_target(X), list(cases)) == list(cases.values())


def test_images_become_portable(evaluate):
    before = "Start <IMG height=3 src='out/media/p1.gif'> mid <img src=\"/q/media/p2.gif\" alt=\" Two words \"><img alt='none' src='p3.gif'> ![one](x\\media\\p4.gif)![two](p5.gif) end\nlast"
    after = "Start ![Image](media/p1.gif) mid ![Two words](media/p2.gif)<img alt='none' src='p3.gif'> ![one](media/p4.gif)![two](p5.gif) end\nlast"
    assert evaluate(lambda X: paths.portable_images(X), [before, "", "no links", "![a](media/x.png)"]) == [after, "", "no links", "![a](media/x.png)"]


def test_url_pathnames(evaluate):
    cases = {
        "https://store.example.com/jobs/a%20b+c.pdf?x=1": "jobs/a b+c.pdf",
        "https://api.example.com/blob/?pathname=jobs%2Fa%2520b.zip&op=put": "jobs/a b.zip",
        "https://store.example.com": None,
        "https://store.example.com//x": "x",
    }
    assert evaluate(lambda X: paths.url_pathname(X), list(cases)) == list(cases.values())


def test_urls_are_bound_to_the_signed_path(evaluate):
    urls = ["https://s.example/jobs/a%20b.pdf?sig=1", "https://s.example/api?pathname=jobs%2Fa%2520b.pdf", "HTTPS://s.example/jobs/a%20b.pdf", "http://s.example/jobs/a%20b.pdf", "https://s.example/jobs/a.pdf", "https://s.example", None]
    assert evaluate(lambda X: paths.bound_to(X, F.lit("/jobs/a b.pdf")), urls) == [None] * 3 + ["JOB_TOKEN_INVALID"] * 4


def test_keys_belong_to_their_job(evaluate):
    keys = ["jobs/2024-01-01/j1/source/a", "jobs/2024-01-01/j1x/source/a", "/jobs/2024-01-01/j1/a", "jobs/2024-01-01/j1/../a", "jobs/24-01-01/j1/a"]
    assert evaluate(lambda X: paths.belongs_to(X, F.lit("j1")), keys) == [True, False, False, False, False]


def test_human_sizes(evaluate):
    sizes = {0: "0 B", 1023: "1023 B", 1024: "1.0 KB", 1536: "1.5 KB", 44_879_053: "42.8 MB", 5 * 1024**4: "5120.0 GB"}
    assert evaluate(lambda X: text.human_bytes(X), list(sizes), "bigint") == list(sizes.values())


def test_alt_texts(evaluate):
    described = ["logo.png", "A chart of sales", "  ", None, "Bild (1).JPEG", "see a.png here/"]
    assert evaluate(lambda X: text.alt_text(X, F.lit("Slide 1 image")), described) == ["Slide 1 image", "A chart of sales", "Slide 1 image", "Slide 1 image", "Slide 1 image", "see a.png here/"]


def test_image_signatures(evaluate):
    heads = [b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff", b"GIF89a", b"BM", b"II*\0", b"MM\0*", b"RIFF0000WEBP", b"RIFF0000WAVE", b""]
    assert evaluate(lambda X: image_extension(X), [bytearray(h) for h in heads], "binary") == [".png", ".jpg", ".gif", ".bmp", ".tiff", ".tiff", ".webp", ".png", ".png"]


def test_tables(evaluate):
    kind = "array<array<string>>"
    rows = [[["A|1", "B"], ["1", "2"]], [["A", "B", "C"], ["1"]], [["A", None], ["1", "2"]], [], [[None, None]], [[" ", "\t"], ["1", "2"]]]
    plain = evaluate(lambda X: gfm.table(X), rows, kind)
    assert plain[0] == "| A\\|1 | B |\n| --- | --- |\n| 1 | 2 |"
    assert plain[1].splitlines()[-1] == "| 1 |  |  |"
    assert plain[3] == ""
    numbered = evaluate(lambda X: gfm.table(X, numbered_header=True), rows, kind)
    assert numbered[2] == "| A |  |\n| --- | --- |\n| 1 | 2 |"
    assert numbered[3:5] == ["", ""]
    assert numbered[5] == "| Column 1 | Column 2 |\n| --- | --- |\n| 1 | 2 |"


def test_text_frames(evaluate):
    kind = "array<struct<level:int,text:string>>"
    frames = [[(0, "a"), (1, " b "), (0, "")], [(0, "alone")], [(1, "alone")], [(0, " ")], []]
    assert evaluate(lambda X: gfm.text_frame(X), frames, kind) == ["- a\n  - b", "alone", "  - alone", "", ""]


def test_documents(evaluate):
    assert evaluate(lambda X: gfm.document(X), [["a ", "", "  - b", "c"], []], "array<string>") == ["a\n\n- b\n\nc\n", "\n"]
