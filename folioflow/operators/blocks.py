"""From blocks to Markdown files: one row per block, ordered by an explicit key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import gfm
from ..functions.text import cleaned, slide_heading

#: Places of a part's blocks: rule, heading, then its body.
RULE, HEADING, BODY = 0, 1, 2


def part_blocks(part_no: Column, heading: Column, body: Column) -> Column:
    """ARRAY<STRUCT<part_no, place, idx, text>> of one slide or page: a rule before all but the first, the heading, the body's blocks."""
    block = lambda place, idx, text: F.struct(part_no.cast("long").alias("part_no"), F.lit(place).alias("place"), idx.cast("int").alias("idx"), text.alias("text"))
    head = F.array(block(HEADING, F.lit(0), heading))
    rule = F.array(block(RULE, F.lit(0), F.lit("---")))
    return F.concat(F.when(part_no > 1, F.concat(rule, head)).otherwise(head), F.transform(body, lambda b, i: block(BODY, i, b)))


def render(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, markdown from rows doc, blocks (ARRAY of part_blocks of one part). A document's parts meet in one row, which is the file itself."""
    ordered = F.array_sort(F.flatten(F.collect_list("blocks")))
    return blocks.groupBy(doc).agg(ordered.alias("ordered")).select(doc, gfm.document(F.transform("ordered", lambda b: b["text"])).alias("markdown"))


def conversation_documents(conversations: DataFrame) -> DataFrame:
    """conv_id, markdown: every conversation as a deck, each turn a slide with its role as the title."""
    body = F.array(cleaned(F.coalesce("text", F.lit(""))))
    parts = conversations.select("conv_id", part_blocks(F.col("turn") + 1, slide_heading(F.col("turn") + 1, F.col("role")), body).alias("blocks"))
    return render(parts, "conv_id")


def warning_lists(warnings: DataFrame, doc: str, shown: int = 8) -> DataFrame:
    """doc, warnings (distinct texts by first occurrence), shown (the first of them), more: how many are not shown. warnings has doc, seq, message."""
    firsts = warnings.groupBy(doc, "message").agg(F.min("seq").alias("seq"))
    lists = firsts.groupBy(doc).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "message"))), lambda w: w["message"]).alias("warnings"))
    return lists.select(doc, "warnings", F.slice("warnings", 1, shown).alias("shown"), F.greatest(F.size("warnings") - shown, F.lit(0)).alias("more"))
