"""Expressions over file content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signatures of formats.
IMAGES = (
    ("89504E470D0A1A0A", ".png"),
    ("FFD8FF", ".jpg"),
    ("474946383761", ".gif"),
    ("474946383961", ".gif"),
    ("424D", ".bmp"),
    ("49492A00", ".tiff"),
    ("4D4D002A", ".tiff"),
)
PDF, ZIP, CFB = "255044462D", "504B0304", "D0CF11E0A1B11AE1"


def begins(content: Column, signature: str) -> Column:
    return F.hex(F.substring(content, 1, len(signature) // 2)) == signature


def image_extension(content: Column, otherwise: Column | str = ".png") -> Column:
    """The extension that the first bytes speak for, whatever the container claims."""
    fallback = F.lit(otherwise) if isinstance(otherwise, str) else otherwise
    out = F.when(begins(content, "52494646") & (F.hex(F.substring(content, 9, 4)) == "57454250"), ".webp").otherwise(fallback)
    for signature, extension in reversed(IMAGES):
        out = F.when(begins(content, signature), extension).otherwise(out)
    return out
