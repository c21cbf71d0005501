"""Markdown blocks from arrays, in higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import cell, strip


def line(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def table(rows: Column, numbered_header: bool = False) -> Column:
    """A table from ARRAY<ARRAY<STRING>>, the first row its header; ragged rows are padded, no rows give "".

    numbered_header drops rows without any non-empty cell and names the columns of a
    header whose cells are all blank "Column 1", "Column 2", and so on.
    """
    if numbered_header:
        rows = F.filter(rows, lambda r: F.exists(r, lambda c: F.coalesce(c, F.lit("")) != ""))
    rows = F.transform(rows, lambda r: F.transform(r, cell))

    def rendered(rows: Column) -> Column:
        width = F.array_max(F.transform(rows, F.size))
        padded = F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
        head = F.element_at(padded, 1)
        if numbered_header:
            names = F.transform(head, lambda c, i: F.concat(F.lit("Column "), (i + 1).cast("string")))
            head = F.when(F.forall(head, lambda c: c == ""), names).otherwise(head)
        body = F.transform(F.slice(padded, 2, F.greatest(F.size(padded), F.lit(1))), line)
        return F.array_join(F.concat(F.array(line(head), line(F.array_repeat(F.lit("---"), width))), body), "\n")

    return F.coalesce(F.when(F.size(rows) > 0, F.element_at(F.transform(F.array(rows), rendered), 1)), F.lit(""))


def text_frame(paragraphs: Column) -> Column:
    """A block from ARRAY<STRUCT<level, text>>: nested bullets, or a plain paragraph where there is one line at level 0; "" for none."""
    kept = F.filter(F.transform(paragraphs, lambda p: F.struct(F.coalesce(p["level"], F.lit(0)).alias("level"), strip(F.coalesce(p["text"], F.lit(""))).alias("text"))), lambda p: p["text"] != "")
    bullets = F.transform(kept, lambda p: F.concat(F.repeat(F.lit("  "), p["level"]), F.lit("- "), p["text"]))
    alone = (F.size(kept) == 1) & (F.element_at(kept, 1)["level"] == 0)
    return F.when(F.size(kept) == 0, F.lit("")).when(alone, F.element_at(kept, 1)["text"]).otherwise(F.array_join(bullets, "\n"))


def document(blocks: Column) -> Column:
    """A Markdown file from its blocks in order: each stripped, empty ones dropped, one blank line between, a line end after."""
    kept = F.filter(F.transform(blocks, lambda b: strip(b)), lambda b: b != "")
    return F.concat(strip(F.array_join(kept, "\n\n")), F.lit("\n"))
