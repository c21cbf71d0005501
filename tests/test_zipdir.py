from __future__ import annotations

import io
import random
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from folioflow.sources import zipdir


def archive(rng: random.Random, n: int, comment: bytes = b"", before: bytes = b"", method: int = zipfile.ZIP_DEFLATED) -> bytes:
    out = io.BytesIO()
    out.write(before)
    with zipfile.ZipFile(out, "w", method) as z:
        for i in range(n):
            name = rng.choice(["a/b.xml", f"word/m{i}.xml", f"é{i}.png", f"folder{i}/", "日本.txt"]) if rng.random() < 0.3 else f"p{i}"
            with pytest.warns(UserWarning) if name in z.namelist() else io.StringIO():
                z.writestr(name, bytes(rng.randrange(2000)) + rng.randbytes(rng.randrange(50)))
        z.comment = comment
    return out.getvalue()


def listed(content: bytes):
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return [(m.filename, m.file_size, m.compress_size) for m in z.infolist()]
    except Exception:
        return None


def archives() -> list[bytes]:
    rng = random.Random(1)
    out = [archive(rng, rng.choice([0, 1, 5, 40]), rng.randbytes(rng.choice([0, 0, 7, 65_535])), rng.choice([b"", b"", b"x" * 100])) for _ in range(60)]
    return [*out, archive(rng, 3000), archive(rng, 30, b"PK\5\6 in a comment PK\5\6" + bytes(18))]


def test_members_equal_the_library():
    for content in archives():
        assert zipdir.members(content) == listed(content)


def test_damaged_archives():
    rng = random.Random(2)
    whole = archive(rng, 8)
    for _ in range(400):
        raw = bytearray(whole)
        for _ in range(rng.randint(1, 3)):
            raw[rng.randrange(len(raw) - 200, len(raw))] = rng.randrange(256)
        got = zipdir.members(bytes(raw[: rng.choice([len(raw), rng.randrange(len(raw))])]))
        assert got is None or isinstance(got, list)
    assert zipdir.members(None) is None and zipdir.members(b"") is None and zipdir.members(b"PK\3\4") is None


def wide(members: dict[str, bytes]) -> bytes:
    """An archive with 64-bit sizes, offsets and end record throughout."""
    body, entries = bytearray(), bytearray()
    for name, data in members.items():
        at, raw = len(body), name.encode()
        extra = struct.pack("<2H2Q", 1, 16, len(data), len(data))
        body += struct.pack("<4s5H3L2H", b"PK\3\4", 45, 0x800, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), len(extra)) + raw + extra + data
        extra = struct.pack("<2H3Q", 1, 24, len(data), len(data), at)
        entries += struct.pack("<4s6H3L5H2L", b"PK\1\2", 45, 45, 0x800, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + raw + extra
    at = len(body)
    end = struct.pack("<4sQ2H2L4Q", b"PK\6\6", 44, 45, 45, 0, 0, len(members), len(members), len(entries), at)
    return bytes(body + entries + end) + struct.pack("<4sLQL", b"PK\6\7", 0, at + len(entries), 1) + struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)


def test_64_bit_archives():
    content = wide({"a": b"12345", "word/ü.xml": b"x" * 70_000})
    assert zipdir.members(content) == listed(content) == [("a", 5, 5), ("word/ü.xml", 70_000, 70_000)]


def test_repeated_and_overlapping_members():
    rng = random.Random(3)
    plain = zipdir.directory(len(c := archive(rng, 5)), lambda s, n: c[s : s + n])
    assert (plain["repeated"], plain["overlapping"]) == (len(plain["members"]) - len({m["name"] for m in plain["members"]}), 0)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z, pytest.warns(UserWarning):
        z.writestr("same", "1")
        z.writestr("same", "2")
        z.writestr("other", "3" * 100)
    raw = bytearray(out.getvalue())
    where = [i for i in range(len(raw)) if raw[i : i + 4] == b"PK\1\2"]
    raw[where[2] + 42 : where[2] + 46] = bytes(4)  # the third entry points to the first member
    found = zipdir.directory(len(raw), lambda s, n: bytes(raw[s : s + n]))
    assert (found["repeated"], found["overlapping"]) == (1, 2)


def test_only_the_end_is_read(spark):
    rng = random.Random(4)
    big = io.BytesIO()
    with zipfile.ZipFile(big, "w", zipfile.ZIP_STORED) as z:
        z.writestr("word/media/a.bin", rng.randbytes(5 << 20))
        z.writestr("word/document.xml", "<x/>")
    many = archive(rng, 3000, before=b"", method=zipfile.ZIP_STORED)
    contents = [big.getvalue(), many, b"no archive", None, b"", wide({"a": b"1"}), *archives()[:5]]
    read: list[int] = []
    whole = big.getvalue()
    found = zipdir.directory(len(whole), lambda s, n: read.append(n) or whole[s : s + n])
    assert sum(read) == found["bytes_read"] <= zipdir.TAIL
    rows = spark.createDataFrame([(i, None if c is None else bytearray(c)) for i, c in enumerate(contents)], "i int, content binary").select("i", zipdir.zip_directory(F.col("content")).alias("d")).orderBy("i").collect()
    for content, row in zip(contents, rows, strict=True):
        want = listed(content) if content is not None else None
        assert (None if row["d"] is None else [tuple(m) for m in row["d"]["members"]]) == want
    assert rows[0]["d"]["bytes_read"] <= zipdir.TAIL < rows[1]["d"]["bytes_read"] < len(many)
