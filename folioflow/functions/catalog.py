"""The catalogues of errors, stages and warnings."""

from __future__ import annotations

#: Code, HTTP status, message for readers.
ERRORS = (
    ("UNSUPPORTED_FILE_TYPE", 415, "This file type is not supported. Please upload a Word (.docx), PowerPoint (.pptx) or PDF (.pdf) file."),
    ("FILE_TOO_LARGE", 413, "The maximum supported file size is 100 MB."),
    ("INVALID_FILE_FORMAT", 422, "This file does not appear to be a valid Word, PowerPoint or PDF document. It may be damaged or renamed from another format."),
    ("PASSWORD_PROTECTED", 422, "This document is password protected. Please remove the password and try again."),
    ("OFFICE_ARCHIVE_UNSAFE", 422, "This document could not be processed safely and was rejected."),
    ("DOCUMENT_TOO_COMPLEX", 422, "This document is too complex to convert reliably."),
    ("DOCUMENT_EXPANDS_TOO_LARGE", 413, "This document expands beyond the safe processing limit during conversion."),
    ("DOWNLOAD_FAILED", 502, "The uploaded file could not be retrieved. Please try again."),
    ("CONVERSION_TIMEOUT", 504, "The conversion took too long to complete."),
    ("CONVERSION_FAILED", 500, "The document could not be converted. Please try again."),
    ("RESULT_TOO_LARGE", 413, "The converted result is too large to return safely."),
    ("RESULT_UPLOAD_FAILED", 502, "The converted result could not be saved. Please try again."),
    ("JOB_TOKEN_INVALID", 401, "This conversion request is not valid."),
    ("JOB_TOKEN_EXPIRED", 401, "This conversion request has expired. Please upload the file again."),
    ("BLOB_NOT_FOUND", 404, "The uploaded file could not be found. Please upload it again."),
    ("RATE_LIMITED", 429, "Too many conversions requested. Please wait a few minutes and try again."),
    ("SERVICE_UNAVAILABLE", 503, "The conversion service is temporarily unavailable. Please try again."),
)
#: What each stage shows as progress, in order.
PROGRESS = {"accepted": 0, "downloading": 5, "validating": 25, "converting": 35, "packaging": 80, "uploading": 90, "complete": 100, "failed": 100}
#: Warnings about what a slide or page holds, {n} is its number; and about Word documents, our own.
WARNINGS = {
    "chart": "Slide {n} contains a chart. Chart data is not converted.",
    "diagram": "Slide {n} contains SmartArt. SmartArt is not converted.",
    "media": "Slide {n} contains embedded media. Media is not converted.",
    "embedded": "Slide {n} contains an embedded object. It is not converted.",
    "linked": "Slide {n} contains a linked object. It is not converted.",
    "line": "Slide {n} contains connectors or diagram lines. Spatial relationships may be lost.",
    "slide_image": "Slide {n} contains an image that could not be extracted.",
    "wmf": "Slide {n} contains a WMF image. It was left unconverted.",
    "emf": "Slide {n} contains a EMF image. It was left unconverted.",
    "page_text": "Page {n} text could not be fully extracted.",
    "page_tables": "Page {n} tables could not be extracted.",
    "page_tables_slow": "Table extraction on page {n} exceeded its time budget and was skipped.",
    "tables_stopped": "Table extraction was stopped early to stay within the conversion time limit.",
    "tables_pages": "Table extraction was skipped because the document exceeds the page budget.",
    "page_images": "Page {n} images could not be read.",
    "page_image": "Page {n} contains an image that could not be extracted.",
    "doc_chart": "The document contains a chart. Chart data is not converted.",
    "doc_diagram": "The document contains SmartArt. SmartArt is not converted.",
    "doc_image": "The document contains an image that could not be extracted.",
    "doc_object": "The document contains an embedded object. It is not converted.",
    "doc_part": "The document contains another document. It is not converted.",
    "doc_symbol": "The document contains a symbol that could not be converted.",
    "scanned": "Page {n} may be scanned or image-based. Text extraction may be incomplete.",
}
