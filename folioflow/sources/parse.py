"""From a document's bytes to its items. Nothing here needs Spark, so that the process of a worker's documents starts quickly."""

from __future__ import annotations

from ..config import Limits
from . import docx, pdf, pptx
from .items import Extract, Failure


def extract(kind: str, content: bytes, limits: Limits) -> Extract:
    """Items of one document; a failure becomes a code and carries no text of the document."""
    try:
        if kind == "pptx":
            return pptx.extract(content, limits.notes, limits.include_media)
        if kind == "docx":
            return docx.extract(content, limits.include_media)
        return pdf.extract(content, limits, limits.include_media)
    except Failure as e:
        return Extract(error_code=e.code)
    except Exception:
        return Extract(error_code="CONVERSION_FAILED")
