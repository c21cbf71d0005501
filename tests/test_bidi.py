from __future__ import annotations

import pytest

from folioflow.config import Limits
from folioflow.sources import bidi, pdf
from folioflow.sources import samples as s

HELLO, WORLD = "שלום", "עולם"


@pytest.mark.parametrize(
    ("seen", "read"),
    [
        ("plain text 1, 2", "plain text 1, 2"),
        (f"{WORLD[::-1]} {HELLO[::-1]}", f"{HELLO} {WORLD}"),
        (f"{WORLD[::-1]} 12,345.6 {HELLO[::-1]}", f"{HELLO} 12,345.6 {WORLD}"),
        (f"{WORLD[::-1]} 50% {HELLO[::-1]}", f"{HELLO} 50% {WORLD}"),
        (f"{WORLD[::-1]} New York {HELLO[::-1]}", f"{HELLO} New York {WORLD}"),
        (f"The word {HELLO[::-1]} and the word {WORLD[::-1]} are Hebrew", f"The word {HELLO} and the word {WORLD} are Hebrew"),
        (f"He said {WORLD[::-1]} {HELLO[::-1]} twice", f"He said {HELLO} {WORLD} twice"),
        (f".{HELLO[::-1]}", f"{HELLO}."),
        ("ﻼﻬﺳ", "سهلا"),
        ("", ""),
    ],
)
def test_reading_order(seen, read):
    assert bidi.logical(seen) == read


def page(text: str, *kind: str) -> str:
    return next(i.text for i in pdf.extract(s.subset_pdf(text, *kind), Limits()).items if i.kind == "page")


def test_pages():
    assert page(f"{WORLD[::-1]} 7 {HELLO[::-1]}") == f"{HELLO} 7 {WORLD}"
    assert page("日本語、縦書き", "Identity-V") == "日本語、縦書き"


def test_columns_go_from_right_to_left():
    p = pdf.Page.__new__(pdf.Page)
    p.upright = [(100, 700 - 12 * i, 12, 12, c) for i, c in enumerate("右側")] + [(80, 700 - 12 * i, 12, 12, c) for i, c in enumerate("左側")] + [(80, 600, 12, 12, "下")]
    assert p.columns() == ["右側", "左側 下"]
