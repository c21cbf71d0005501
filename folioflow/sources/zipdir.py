"""Directories of ZIP archives, read from their ends: the end record, its 64-bit form and the central directory; no member is touched, and no more of an archive than these."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MEMBERS = "array<struct<name:string,file_size:bigint,compress_size:bigint>>"
#: What is known of an archive: repeated counts members whose name an earlier one has, overlapping those that begin before an earlier one has ended.
DIRECTORY = f"struct<members:{MEMBERS},repeated:int,overlapping:int,bytes_read:bigint>"
END, END64, LOCATOR, ENTRY = (struct.Struct(x) for x in ("<4s4H2LH", "<4sQ2H2L4Q", "<4sLQL", "<4s6H3L5H2L"))
#: The longest end of an archive in which its end record may begin: a comment has at most 65,535 bytes.
TAIL = 65_535 + END.size + LOCATOR.size + END64.size
#: A directory of more bytes is none that we read: 10,000 members, which is our limit, have far less.
MOST = 1 << 25
FULL, FULL16 = 0xFFFFFFFF, 0xFFFF


class NoArchive(Exception):
    """What was read is no archive, or not one whose directory can be trusted."""


@dataclass
class End:
    """Where the directory is, and how many entries it has."""

    at: int
    size: int
    entries: int
    #: bytes that stand before the archive, by which all its offsets are too small
    before: int


def end_record(tail: bytes, length: int, read: Callable[[int, int], bytes]) -> End:
    """The last end record whose comment ends with the file. tail: the file's last bytes, read(start, n): others."""
    at = tail.rfind(b"PK\5\6")
    while at >= 0 and (len(tail) - at < END.size or at + END.size + END.unpack_from(tail, at)[7] != len(tail)):
        at = tail.rfind(b"PK\5\6", 0, at)
    if at < 0:
        raise NoArchive
    _, _, _, _, entries, size, offset, _ = END.unpack_from(tail, at)
    position = length - len(tail) + at
    if at >= LOCATOR.size and tail[at - LOCATOR.size : at - LOCATOR.size + 4] == b"PK\6\7":
        where = LOCATOR.unpack_from(tail, at - LOCATOR.size)[2]
        # the record stands right before its locator, whatever its offset says of an archive with something before it
        for place in (where, position - LOCATOR.size - END64.size):
            raw = read(place, END64.size) if 0 <= place <= length - END64.size else b""
            if raw[:4] == b"PK\6\6":
                entries, size, offset = END64.unpack(raw)[7:]
                position = place
                break
        else:
            raise NoArchive
    before = position - size - offset
    if size > MOST or before < 0:
        raise NoArchive
    return End(offset + before, size, entries, before)


def entries(raw: bytes, count: int) -> Iterator[tuple[str, int, int, int, int]]:
    """name, size, compressed size, offset and length of the local header's name of each entry."""
    at = 0
    for _ in range(count):
        if raw[at : at + 4] != b"PK\1\2" or len(raw) - at < ENTRY.size:
            raise NoArchive
        _, _, _, flags, _, _, _, _, packed, size, names, extras, comments, _, _, _, offset = ENTRY.unpack_from(raw, at)
        at += ENTRY.size
        name, extra = raw[at : at + names], raw[at + names : at + names + extras]
        if len(name) + len(extra) < names + extras:
            raise NoArchive
        at += names + extras + comments
        values = [size, packed, offset]
        wide = extra_field(extra, 1) if FULL in values else b""
        for i, v in enumerate(values):
            if v == FULL:
                if len(wide) < 8:
                    raise NoArchive
                values[i], wide = int.from_bytes(wide[:8], "little"), wide[8:]
        text = name.decode("utf-8" if flags & 0x800 else "cp437", "replace")
        yield text.partition("\0")[0], values[0], values[1], values[2], names


def extra_field(extra: bytes, kind: int) -> bytes:
    at = 0
    while at + 4 <= len(extra):
        key, size = struct.unpack_from("<2H", extra, at)
        if key == kind:
            return extra[at + 4 : at + 4 + size]
        at += 4 + size
    return b""


def directory(length: int, read: Callable[[int, int], bytes], tail: bytes | None = None) -> dict | None:
    """DIRECTORY of an archive of which read(start, n) gives bytes; None for what is none."""
    used = 0

    def counted(start: int, n: int) -> bytes:
        nonlocal used
        used += n
        return read(start, n)

    try:
        begin = max(0, length - TAIL)
        tail = counted(begin, length - begin) if tail is None else tail
        begin = length - len(tail)
        end = end_record(tail, length, lambda start, n: tail[start - begin : start - begin + n] if start >= begin else counted(start, n))
        raw = tail[end.at - begin : end.at - begin + end.size] if end.at >= begin else counted(end.at, end.size)
        found = list(entries(raw, end.entries))
    except (NoArchive, struct.error):
        return None
    names = [f[0] for f in found]
    reach = overlapping = 0
    for _, _, packed, offset, named in sorted(found, key=lambda f: f[3]):
        overlapping += offset < reach
        reach = max(reach, offset + 30 + named + packed)
    members = [{"name": n, "file_size": s, "compress_size": p} for n, s, p, _, _ in found]
    return {"members": members, "repeated": len(names) - len(set(names)), "overlapping": overlapping, "bytes_read": used}


def members(content: bytes | None) -> list[tuple[str, int, int]] | None:
    """name, size, compressed size of each member; None for what is no archive."""
    raw = content or b""
    found = directory(len(raw), lambda start, n: raw[start : start + n])
    return None if found is None else [tuple(m.values()) for m in found["members"]]


class Missing(Exception):
    """Bytes that lie before a tail."""


def zip_directory(content: Column) -> Column:
    """DIRECTORY of an archive; null for what is none. Only the archive's end crosses to Python, and where its directory is longer than that, the directory."""
    length = F.octet_length(content)
    tail = lambda n: F.substring(content, F.greatest(length - n, F.lit(0)) + 1, F.least(length, n))

    @F.pandas_udf("bigint")
    def wanted(tails: pd.Series, lengths: pd.Series) -> pd.Series:
        """How many of the last bytes hold the directory; null for no archive."""
        return pd.Series([None if t is None else from_end(t, int(n)) for t, n in zip(tails, lengths, strict=True)], dtype="Int64")

    @F.pandas_udf(DIRECTORY)
    def listed(tails: pd.Series, lengths: pd.Series) -> pd.DataFrame:
        out = [None if t is None else directory(int(n), lambda start, k, t=t, n=n: t[start - (int(n) - len(t)) :][:k], t) for t, n in zip(tails, lengths, strict=True)]
        rows = [{**(x or dict.fromkeys(("members", "repeated", "overlapping"))), "bytes_read": None if x is None else len(t)} for x, t in zip(out, tails, strict=True)]
        return pd.DataFrame(rows, columns=["members", "repeated", "overlapping", "bytes_read"]).astype({"repeated": "Int32", "overlapping": "Int32", "bytes_read": "Int64"})

    need = wanted(tail(F.lit(TAIL)), length)
    found = listed(tail(F.greatest(need, F.least(length, F.lit(TAIL))).cast("int")), length)
    return F.when(need.isNotNull() & found["members"].isNotNull(), found)


def from_end(tail: bytes, length: int) -> int | None:
    """How many of a file's last bytes hold its directory and end records."""
    begin = length - len(tail)
    low = length

    def read(start: int, n: int) -> bytes:
        nonlocal low
        low = min(low, start)
        if start < begin:
            raise Missing
        return tail[start - begin : start - begin + n]

    try:
        end = end_record(tail, length, read)
    except Missing:
        return min(length, length - low)
    except (NoArchive, struct.error):
        return None
    return length - min(low, end.at)


def zip_members(content: Column) -> Column:
    """MEMBERS of an archive; null for what is none."""
    return zip_directory(content)["members"]
