from __future__ import annotations

from folioflow.config import Limits
from folioflow.sources import samples
from folioflow.sources.extract import TOGETHER, extracted


def test_small_documents_that_leave_together_keep_their_rows(spark):
    n = 2 * TOGETHER + 7
    large = samples.pdf(["/I0 Do"], jpegs={"I0": b"\xff\xd8\xff" + bytes(2 << 20)})
    rows = [(f"{i}", "pdf", "FILE_TOO_LARGE" if i % 5 == 0 else None, bytearray(large if i == 9 else samples.pdf([samples.text_at(50, 700, f"key {i}")], encrypted=i % 7 == 3))) for i in range(n)]
    df = spark.createDataFrame(rows, "path string, source_type string, error_code string, content binary").coalesce(1)
    got = {int(r["path"]): (r["error_code"], [i["text"].strip() for i in r["items"] if i["kind"] == "page"], len(r["items"])) for r in extracted(df, Limits()).collect()}
    assert len(got) == n
    for i in range(n):
        code = "FILE_TOO_LARGE" if i % 5 == 0 else "PASSWORD_PROTECTED" if i % 7 == 3 and i != 9 else None
        assert got[i][0] == code
        assert got[i][1] == ([] if code else [""] if i == 9 else [f"key {i}"])
