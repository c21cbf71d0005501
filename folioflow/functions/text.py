r"""Text expressions. All are columns of built-in functions except nfc().

White space is one explicit class everywhere (what Python's str methods take for it),
because \s means different sets to different engines. The classes below are written so
that Java's and RE2's regular expressions read them alike. Every expression takes time linear in its text: a run of
white space is tried from its first character only, and ends are trimmed without an expression.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: The same as characters.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: White space that does not end a line; and what ends one, besides a return before a line feed.
INLINE = r"[\x{09}\x{1F}\x{20}\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
ENDS = r"[\x{0A}-\x{0D}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
LINE_END = rf"\x{{0D}}\x{{0A}}|{ENDS}"
#: Characters that no file name may hold, and names that devices have.
ILLEGAL = r"""[<>:"/\\|?*\x{00}-\x{1F}\x{7F}]"""
DEVICES = ("CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10)))
MAX_STEM = 120
IMAGE_SUFFIXES = "png|jpe?g|gif|bmp|tiff?|webp|emf|wmf|svg"
UNITS = ("KB", "MB", "GB")


def strip(text: Column, also: str = "") -> Column:
    """text without white space (and the characters in also) at both ends."""
    return F.btrim(text, F.lit(SPACES + also))


def squeezed(text: Column) -> Column:
    """Words joined by single spaces."""
    return strip(F.regexp_replace(text, f"{WHITE}+", " "))


def cleaned(text: Column) -> Column:
    """Lines without white space at their ends, at most one blank line in a row, none at either end of the text."""
    lines = F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), ENDS, "\n")
    lines = F.regexp_replace(lines, rf"(?<!{INLINE}){INLINE}++\n", "\n")
    return strip(F.regexp_replace(lines, r"\n{3,}", "\n\n"))


def cell(text: Column) -> Column:
    """Text for one cell of a Markdown table; null is empty."""
    return strip(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))


def slide_heading(number: Column, title: Column) -> Column:
    title = squeezed(F.coalesce(title, F.lit("")))
    return F.concat(F.lit("## Slide "), number.cast("string"), F.when(title != "", F.concat(F.lit(" — "), title)).otherwise(F.lit("")))


def page_heading(number: Column) -> Column:
    return F.concat(F.lit("## Page "), number.cast("string"))


def base_name(path: Column) -> Column:
    """The last part of a path with either separator."""
    return F.regexp_replace(path, r"(?s)\A.*[/\\]", "")


def extension(path: Column) -> Column:
    """The extension with its dot, in lower case; "" where there is none. A leading dot begins no extension."""
    return F.lower(F.regexp_extract(base_name(path), r"(?s)\A.+(\.[^.]+)\z", 1))


def nfc(text: Column) -> Column:
    """Canonical composition, for which there is no built-in function."""

    @F.pandas_udf("string")
    def composed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))

    return composed(text)


def safe_stem(name: Column) -> Column:
    """A file name without folder and extension that is safe and readable everywhere; never empty."""
    stem = F.regexp_replace(base_name(name), r"(?s)\A(.+)\.[^.]+\z", "$1")
    stem = F.regexp_replace(nfc(stem), ILLEGAL, "_")
    stem = strip(F.regexp_replace(F.regexp_replace(stem, r"\.{2,}", "."), f"{WHITE}+", " "), ".")
    stem = F.regexp_replace(F.substring(stem, 1, MAX_STEM), r"[\x{20}.]+\z", "")
    stem = F.when(F.upper(stem).isin(*DEVICES), F.concat(stem, F.lit("_file"))).otherwise(stem)
    return F.when(stem == "", F.lit("document")).otherwise(stem)


#: White space as browsers take it.
BROWSER = WHITE.replace(r"\x{1C}-\x{20}\x{85}", r"\x{20}\x{FEFF}")


def display_stem(name: Column) -> Column:
    """The browser's form of safe_stem(): white space as browsers take it, at most MAX_STEM units of UTF-16 (no character is split), and all white space trimmed behind a cut."""
    stem = F.regexp_replace(base_name(name), r"(?s)\A(.+)\.[^.]*\z", "$1")
    stem = F.regexp_replace(F.regexp_replace(nfc(stem), ILLEGAL, "_"), r"\.{2,}", ".")
    trimmed = lambda text: F.btrim(text, F.lit("".join(c for c in SPACES if c not in "\x1c\x1d\x1e\x1f\x85") + "\ufeff."))
    stem = trimmed(F.regexp_replace(stem, f"{BROWSER}+", " "))
    units = lambda text: F.char_length(text) + F.char_length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("units"))

    def step(acc: Column, c: Column) -> Column:
        after = acc["units"] + F.when(F.octet_length(c) == 4, 2).otherwise(1)
        return F.struct(F.when(after <= MAX_STEM, F.concat(acc["text"], c)).otherwise(acc["text"]).alias("text"), after.alias("units"))

    cut = F.aggregate(F.split(F.substring(stem, 1, MAX_STEM), ""), start, step, lambda acc: acc["text"])
    stem = F.when(units(stem) > MAX_STEM, F.regexp_replace(cut, rf"(?<!{BROWSER[:-1]}.])(?:{BROWSER[:-1]}.])++\z", "")).otherwise(stem)
    stem = F.when(F.upper(stem).isin(*DEVICES), F.concat(stem, F.lit("_file"))).otherwise(stem)
    return F.when(stem == "", F.lit("document")).otherwise(stem)


def slug(stem: Column) -> Column:
    """An ASCII path segment of at most 80 characters."""
    out = F.regexp_replace(stem, r"[^0-9A-Za-z_\-. ]", "-")
    out = F.regexp_replace(F.regexp_replace(out, f"{WHITE}+", "-"), "-+", "-")
    out = F.substring(F.regexp_replace(F.regexp_replace(out, r"\A[-.]+", ""), r"[-.]+\z", ""), 1, 80)
    return F.when(out == "", F.lit("document")).otherwise(out)


def human_bytes(size: Column) -> Column:
    """A size for people: whole bytes, then KB, MB or GB with one decimal."""
    out = F.format_string("%d B", size.cast("long"))
    for power, unit in enumerate(UNITS, start=1):
        out = F.when(size >= 1024**power, F.format_string(f"%.1f {unit}", size / float(1024**power))).otherwise(out)
    return out


def alt_text(described: Column, otherwise: Column) -> Column:
    """A picture's authored description; one that is only a file name is discarded."""
    text = squeezed(F.coalesce(described, F.lit("")))
    named = text.rlike(rf"(?iU)\A[\w \-.()]+\.({IMAGE_SUFFIXES})\z")
    return F.when((text == "") | named, otherwise).otherwise(text)
