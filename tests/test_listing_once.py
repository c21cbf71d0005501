from __future__ import annotations

from folioflow.streaming import listing


def test_a_run_lists_a_folder_once_for_all_its_batches(tmp_path, monkeypatch):
    for i in range(300):
        (tmp_path / f"{i:03d}").write_text("x")
    calls, real = [], listing.listed
    monkeypatch.setattr(listing, "listed", lambda path: calls.append(path) or real(path))
    cursor, offset, seen = listing.Cursor(str(tmp_path), 5, 10, None), {"after": ""}, []
    for _ in range(30):
        rows, offset = cursor.read(offset)
        seen += [r[0] for r in rows]
    assert seen == [f"{i:03d}" for i in range(300)] and len(calls) == 1
    (tmp_path / "300").write_text("x")  # the listing is used up, so it is made anew
    rows, offset = cursor.read(offset)
    assert [r[0] for r in rows] == ["300"] and len(calls) == 2
    cursor.until = 0  # old
    cursor.read({"after": "100"})
    assert len(calls) == 3
