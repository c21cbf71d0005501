"""Characters of fonts that bring no map of their own: from embedded font programs, glyph names and predefined maps."""

from __future__ import annotations

import re
import struct
import unicodedata
from collections.abc import Callable

#: Accents in glyph names, and other words for single characters.
ACCENTS = {"acute": "́", "grave": "̀", "circumflex": "̂", "dieresis": "̈", "tilde": "̃", "ring": "̊", "cedilla": "̧", "caron": "̌", "breve": "̆", "macron": "̄", "ogonek": "̨", "dotaccent": "̇", "hungarumlaut": "̋"}
WORDS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "minus": "−",
    "period": ".", "slash": "/", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_", "braceleft": "{",
    "bar": "|", "braceright": "}", "asciitilde": "~", "quoteright": "’", "quoteleft": "‘", "quotedblleft": "“", "quotedblright": "”", "quotesinglbase": "‚", "quotedblbase": "„", "guillemotleft": "«", "guillemotright": "»", "endash": "–", "emdash": "—",
    "bullet": "•", "ellipsis": "…", "dagger": "†", "degree": "°", "section": "§", "paragraph": "¶", "copyright": "©", "registered": "®", "trademark": "™", "cent": "¢", "sterling": "£", "yen": "¥", "Euro": "€", "germandbls": "ß", "AE": "Æ", "ae": "æ",
    "OE": "Œ", "oe": "œ", "Oslash": "Ø", "oslash": "ø", "Lslash": "Ł", "lslash": "ł", "dotlessi": "ı", "multiply": "×", "divide": "÷", "plusminus": "±", "fi": "ﬁ", "fl": "ﬂ", "nbspace": " ",
}
DIGITS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
GREEK = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
#: Predefined maps by what their names hold, and the encodings that read the same codes.
CODECS = (("UTF16", "utf-16-be"), ("UCS2", "utf-16-be"), ("UTF8", "utf-8"), ("UTF32", "utf-32-be"), ("RKSJ", "cp932"), ("GBK", "gb18030"), ("GB-EUC", "gb2312"), ("UHC", "cp949"), ("KSC-EUC", "euc_kr"), ("B5", "big5hkscs"), ("EUC", "euc_jp"))


def glyph(name: str) -> str:
    """The character of a glyph's name; "" where it tells none."""
    name = name.partition(".")[0]
    if len(name) == 1:
        return name
    if name in WORDS:
        return WORDS[name]
    if m := re.fullmatch(r"uni((?:[0-9A-F]{4})+)", name):
        return bytes.fromhex(m[1]).decode("utf-16-be", "ignore")
    if m := re.fullmatch(r"u([0-9A-F]{4,6})", name):
        return chr(int(m[1], 16)) if int(m[1], 16) < 0x110000 and not 0xD800 <= int(m[1], 16) < 0xE000 else ""
    if name in DIGITS:
        return str(DIGITS.index(name))
    if name.lower() in GREEK and name in (name.lower(), name.capitalize()):
        at = GREEK.index(name.lower())
        letter = chr(0x3B1 + at + (at > 16))  # a final sigma stands between
        return letter if name[0].islower() else letter.upper()
    for accent, mark in ACCENTS.items():
        if name[1:] == accent:
            one = unicodedata.normalize("NFC", name[0] + mark)
            return one if len(one) == 1 else ""
    return ""


def codec(name: str) -> Callable[[bytes], list[tuple[int, str]]] | None:
    """For a predefined map: codes and characters of a string. Identity and unknown maps have none."""
    found = next((c for key, c in CODECS if key in name), None)
    if found is None or name.startswith("Identity"):
        return None

    def read(s: bytes) -> list[tuple[int, str]]:
        if found.startswith("utf-16"):
            return [(ord(c), c) for c in s[: len(s) // 2 * 2].decode(found, "replace")]
        return [(ord(c), c) for c in s.decode(found, "replace")]

    return read


class TrueType:
    """Glyphs of a TrueType program: their characters, and the glyphs of codes."""

    def __init__(self, data: bytes):
        self.data = data
        count = struct.unpack_from(">H", data, 4)[0]
        self.tables = {}
        for i in range(count):
            name, _, offset, size = struct.unpack_from(">4s3L", data, 12 + 16 * i)
            self.tables[name] = data[offset : offset + size]
        self.maps: dict[tuple[int, int], dict[int, int]] = {}
        cmap = self.tables.get(b"cmap", b"")
        for i in range(struct.unpack_from(">H", cmap, 2)[0] if len(cmap) > 4 else 0):
            platform, kind, offset = struct.unpack_from(">2HL", cmap, 4 + 8 * i)
            try:
                self.maps[platform, kind] = subtable(cmap[offset:])
            except (struct.error, IndexError):
                continue
        self.text: dict[int, str] = {}
        for i, name in enumerate(self.names()):
            if one := glyph(name):
                self.text[i] = one
        for key in ((0, 3), (0, 4), (3, 10), (3, 1)):
            for code, index in sorted(self.maps.get(key, {}).items(), reverse=True):  # of several characters the first
                if index and code not in range(0xE000, 0xF900):
                    self.text[index] = chr(code)

    def names(self) -> list[str]:
        """Glyph names of the table post, by glyph."""
        post = self.tables.get(b"post", b"")
        if post[:4] != b"\0\2\0\0" or len(post) < 34:
            return []
        n = struct.unpack_from(">H", post, 32)[0]
        index = struct.unpack_from(f">{n}H", post, 34) if len(post) >= 34 + 2 * n else ()
        own, at = [], 34 + 2 * n
        while at < len(post):
            own.append(post[at + 1 : at + 1 + post[at]].decode("latin-1"))
            at += 1 + post[at]
        return [own[i - 258] if 258 <= i < 258 + len(own) else standard(i) for i in index]

    def of_code(self, code: int) -> str:
        """The character of a code of a simple font."""
        for key, shift in (((3, 0), 0xF000), ((3, 0), 0), ((1, 0), 0)):
            index = self.maps.get(key, {}).get(code + shift)
            if index and index in self.text:
                return self.text[index]
        return ""


def standard(index: int) -> str:
    """The character, as a name, of a glyph in the usual order of 258: ASCII, then the upper half of an old encoding."""
    if 3 <= index <= 97:
        return f"uni{index + 29:04X}"
    if 98 <= index <= 225:
        return f"uni{ord(bytes([index + 30]).decode('mac_roman')):04X}"
    return ""


def subtable(t: bytes) -> dict[int, int]:
    """Code -> glyph of a table of format 0, 4, 6 or 12."""
    kind = struct.unpack_from(">H", t)[0]
    if kind == 0:
        return {c: g for c, g in enumerate(t[6:262]) if g}
    if kind == 6:
        first, n = struct.unpack_from(">2H", t, 6)
        return {first + i: g for i, g in enumerate(struct.unpack_from(f">{n}H", t, 10)) if g}
    if kind == 12:
        out = {}
        for i in range(struct.unpack_from(">L", t, 12)[0]):
            begin, end, first = struct.unpack_from(">3L", t, 16 + 12 * i)
            for c in range(begin, min(end, begin + 65_535, 0x10FFFF) + 1):
                out[c] = first + c - begin
        return out
    if kind != 4:
        return {}
    n = struct.unpack_from(">H", t, 6)[0] // 2
    ends, starts, deltas, offsets = (struct.unpack_from(f">{n}H", t, 14 + skip + 2 * n * k) for k, skip in ((0, 0), (1, 2), (2, 2), (3, 2)))
    out = {}
    for i in range(n):
        for c in range(starts[i], min(ends[i], 0xFFFE) + 1):
            if not offsets[i]:
                g = c + deltas[i] & 0xFFFF
            else:
                at = 16 + 6 * n + 2 * i + offsets[i] + 2 * (c - starts[i])
                g = struct.unpack_from(">H", t, at)[0] if at + 2 <= len(t) else 0
                g = g + deltas[i] & 0xFFFF if g else 0
            if g:
                out[c] = g
    return out


class Compact:
    """Glyphs of a compact font program (CFF): their characters by name, or the character ids of a font that has no names."""

    def __init__(self, data: bytes):
        self.data = data
        _, at = self.index(data[2])
        tops, at = self.index(at)
        strings, at = self.index(at)
        top = self.dictionary(tops[0])
        self.keyed = 1230 in top
        count = len(self.index(top[17][0])[0])
        ids = self.charset(int(top.get(15, [0])[0]), count)
        names = [s.decode("latin-1") for s in strings]
        self.text: dict[int, str] = {}
        self.ids = dict(enumerate(ids)) if self.keyed else {}
        if not self.keyed:
            for i, sid in enumerate(ids):
                # the first 95 strings are ASCII, with other quotes; those after 390 are the font's own
                one = {39: "’", 96: "‘"}.get(sid + 31, chr(sid + 31)) if 1 <= sid <= 95 else glyph(names[sid - 391]) if 391 <= sid < 391 + len(names) else ""
                if one:
                    self.text[i] = one

    def index(self, at: int) -> tuple[list[bytes], int]:
        n = struct.unpack_from(">H", self.data, at)[0]
        if not n:
            return [], at + 2
        size = self.data[at + 2]
        offsets = [int.from_bytes(self.data[at + 3 + size * i : at + 3 + size * (i + 1)], "big") for i in range(n + 1)]
        base = at + 2 + size * (n + 1)
        return [self.data[base + a : base + b] for a, b in zip(offsets, offsets[1:], strict=False)], base + offsets[-1]

    @staticmethod
    def dictionary(raw: bytes) -> dict[int, list[float]]:
        """Operators with their operands; 12 x is 1200 + x."""
        out, held, at = {}, [], 0
        while at < len(raw):
            b = raw[at]
            at += 1
            if b <= 21:
                if b == 12:
                    b = 1200 + raw[at]
                    at += 1
                out[b], held = held, []
            elif b == 28:
                held.append(struct.unpack_from(">h", raw, at)[0])
                at += 2
            elif b == 29:
                held.append(struct.unpack_from(">l", raw, at)[0])
                at += 4
            elif b == 30:  # a real number: what it is does not matter here
                while raw[at] & 15 != 15:
                    at += 1
                at += 1
                held.append(0)
            elif b >= 247:
                held.append((b - 247) * 256 + raw[at] + 108 if b < 251 else -(b - 251) * 256 - raw[at] - 108)
                at += 1
            else:
                held.append(b - 139)
        return out

    def charset(self, at: int, count: int) -> list[int]:
        """The string (or character) id of each glyph."""
        if at <= 2:  # predefined: in the order of the ids
            return list(range(count))
        kind, out = self.data[at], [0]
        at += 1
        while len(out) < count:
            first = struct.unpack_from(">H", self.data, at)[0]
            more = 0 if kind == 0 else self.data[at + 2] if kind == 1 else struct.unpack_from(">H", self.data, at + 2)[0]
            out += range(first, first + more + 1)
            at += 2 + (0 if kind == 0 else kind)
        return out[:count]


def widths(file, descendant: dict) -> tuple[dict[int, float], float]:
    """Widths of a composite font's characters, in thousandths, and that of all others."""
    out: dict[int, float] = {}
    items = [file.get(x) for x in file.list(descendant.get("W"))]
    at = 0
    while at + 1 < len(items):
        first = int(file.number(items[at]))
        if isinstance(items[at + 1], list):
            out |= {first + i: float(file.number(w, 1000)) for i, w in enumerate(items[at + 1])}
            at += 2
        elif at + 2 < len(items):
            last = min(int(file.number(items[at + 1])), first + 65_535)
            out |= dict.fromkeys(range(first, last + 1), float(file.number(items[at + 2], 1000)))
            at += 3
        else:
            break
    return out, float(file.number(descendant.get("DW"), 1000))


def embedded(file, descriptor: dict) -> TrueType | Compact | None:
    """The font program of a descriptor; None where there is none that can be read."""
    for key in ("FontFile2", "FontFile3"):
        program = file.get(descriptor.get(key))
        if program is None or not hasattr(program, "raw"):
            continue
        try:
            data = file.decoded(program)
            if data[:4] == b"OTTO":
                return Compact(TrueType(data).tables[b"CFF "])
            return TrueType(data) if key == "FontFile2" or data[:4] in (b"\0\1\0\0", b"true") else Compact(data)
        except (struct.error, IndexError, KeyError, ValueError):
            continue
    return None
