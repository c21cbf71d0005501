"""What keeps many small documents from costing more than their parsing."""

from __future__ import annotations

import pyarrow as pa

from folioflow.config import Limits
from folioflow.sources import extract, pdf, samples


def test_small_documents_go_to_the_child_together(monkeypatch):
    sent, real = [], extract.Child.send
    monkeypatch.setattr(extract.Child, "send", lambda self, documents, limits: sent.append(len(documents)) or real(self, documents, limits))
    word = samples.docx(samples.para(samples.run("x")))
    n = 150
    batch = pa.RecordBatch.from_pydict({"error_code": [None if i % 3 else "X" for i in range(n)], "source_type": ["docx"] * n, "content": [word if i != 1 else b"none" for i in range(n)]})
    found = [e.error_code for _, e in extract.parsed(batch, Limits())]
    assert found == ["CONVERSION_FAILED"] + [None] * 99 and sent == [64, 36]


def test_a_document_that_overstays_among_others():
    good, slow = samples.pdf([samples.text_at(50, 700, "x")]), samples.nested_forms(9, 60)
    found = list(extract.together([("pdf", good), ("pdf", slow), ("pdf", b"x"), ("pdf", good)], Limits(child_timeout=2)))
    assert [f.error_code for f in found] == [None, "CONVERSION_TIMEOUT", "INVALID_FILE_FORMAT", None]
    assert found[0].items[0].text == found[3].items[0].text == "x"


def test_answers_that_nobody_took_are_not_the_next_ones():
    pages = [samples.pdf([samples.text_at(50, 700, t)]) for t in "abcd"]
    lot = extract.together([("pdf", p) for p in pages], Limits())
    assert next(lot).items[0].text == "a"
    assert extract.isolated("pdf", pages[3], Limits()).items[0].text == "d"


def test_words_of_a_page_are_made_out_once():
    p = pdf.Parser(b"Tj /F1 2.5 Tj /F1 2.5 7 7 1 0 R", references=False)
    seen = [p.value() for _ in range(11)]
    assert seen == ["Tj", "F1", 2.5, "Tj", "F1", 2.5, 7, 7, 1, 0, "R"]
    assert all(seen[i] is seen[i + 3] for i in range(3)) and [type(x) for x in seen[:2]] == [pdf.Word, pdf.Name]
    assert [pdf.Parser(b"7 1 0 R").value(), pdf.Parser(b"1 0 R").value()] == [7, pdf.Ref(1)]
