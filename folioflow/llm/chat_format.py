"""Chat formatting from an event log.

An event is (conv_id, turn, seq, kind, role, text), and may have a tie that tells messages
of one turn apart (they follow each other by it). Events of a turn and tie are ordered by seq
and folded: ``message`` and ``edit`` set the text (and the role, where one is given),
``delta`` appends to it, ``regenerate`` discards it so that later deltas start anew, and
``delete`` removes the turn until a later event brings it back. The fold of a turn
touches that turn alone, so a conversation that holds a third of all rows is dealt out
by (conv_id, turn, tie) instead of going to one task.

Rendering puts every final message between control strings and escapes what looks like
one inside roles and texts, reversibly. Output is one row per chunk of a conversation:
chunks are bounded, and joined in order they are the formatted conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
CHUNK_CHARS = 1 << 18
LAST = 2**63 - 1
EVENTS = "conv_id long, turn long, seq long, kind string, role string, text string"
CHUNKS = "conv_id long, chunk long, part long, formatted string, mask array<struct<start:int,end:int>>"
PARTS = "conv_id long, chunk long, part long, n_turns long, turns binary, loss binary, loss_chars long, formatted_chars long"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    out, i = [], 0
    while (j := text.find("\\", i)) >= 0:
        out += [text[i:j], "\n" if text[j + 1] == "n" else text[j + 1]]
        i = j + 2
    return "".join([*out, text[i:]])


def fold(events: DataFrame) -> DataFrame:
    """The final messages: conv_id, turn, tie, role, text.

    Null texts count as empty, null roles as "", null kinds as ``message``; a null turn
    sorts first, as turn -1; a missing or null tie is 0. Events with the same seq are taken in the order kind (deltas
    last), role, text, so repeated rows give a defined result. Other columns are not read.
    """
    e = events.select(
        "conv_id",
        F.coalesce("turn", F.lit(-1)).alias("turn"),
        (F.coalesce("tie", F.lit(0)) if "tie" in events.columns else F.lit(0)).cast("long").alias("tie"),
        F.coalesce("seq", F.lit(-1)).alias("seq"),
        F.coalesce("kind", F.lit("message")).alias("kind"),
        "role",
        F.coalesce("text", F.lit("")).alias("text"),
    )
    # of events with the same seq, those that set a text come before deltas
    e = e.withColumn("rank", F.when(F.col("kind") == "delta", 1).otherwise(0))
    before = Window.partitionBy("conv_id", "turn", "tie").orderBy(F.desc("seq"), F.desc("rank"), F.desc("kind"), F.desc("role"), F.desc("text"))
    # counting backwards: 0 until the last event that set or discarded the text has been passed
    sets = F.col("kind") != "delta"
    e = e.withColumn("later", F.sum(sets.cast("int")).over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - sets.cast("int"))
    part = F.when((F.col("later") == 0) & (F.col("kind") != "regenerate") & (F.col("kind") != "delete"), F.struct("seq", "rank", "kind", "role", "text"))
    role = F.when(F.col("role").isNotNull() & (F.col("kind") != "delete"), F.struct("seq", "rank", "kind", "role"))
    return (
        e.groupBy("conv_id", "turn", "tie")
        .agg(F.array_sort(F.collect_list(part)).alias("parts"), F.max(role)["role"].alias("role"), F.max(F.struct("seq", "rank", "kind"))["kind"].alias("last"))
        .where("last != 'delete'")
        .select("conv_id", "turn", "tie", F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))
    )


def render(messages: DataFrame, chunk_chars: int = CHUNK_CHARS, partitions: int | None = None) -> DataFrame:
    """Rows conv_id, chunk, part, formatted, mask: the formatted text of each conversation in bounded chunks.

    ``chunk`` and ``part`` order the chunks of a conversation (the turn and tie that it
    begins with); ``mask`` has the spans, in code points of the chunk, of the assistant's texts.
    """
    spark = messages.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        conv, first, parts, size, mask = None, (0, 0), [], 0, []
        for batch in batches:
            for c, turn, tie, role, text in tuples(batch, ["conv_id", "turn", "tie", "role", "text"]):
                if parts and (c != conv or size >= chunk_chars):
                    done.append((conv, *first, "".join(parts), mask))
                    parts, size, mask = [], 0, []
                if not parts:
                    conv, first = c, (turn, tie)
                head, body = f"{OPEN}{escape_role(role)}\n", escape(text)
                if role == "assistant":
                    mask.append({"start": size + len(head), "end": size + len(head) + len(body)})
                parts += [head, body, CLOSE]
                size += len(head) + len(body) + len(CLOSE)
            if len(done) >= 256:
                yield frame(done, CHUNKS)
                done = []
        if parts:
            done.append((conv, *first, "".join(parts), mask))
        yield frame(done, CHUNKS)

    return messages.repartitionByRange(n, "conv_id", "turn").sortWithinPartitions("conv_id", "turn", "tie").mapInArrow(rows, CHUNKS)


ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<struct<start:int,end:int>>": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))}


def tuples(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple]:
    """The rows of a batch; integers stay what they are, also beside nulls."""
    for at in range(0, batch.num_rows, 1000):
        part = batch.slice(at, 1000)
        yield from zip(*(part.column(n).to_pylist() for n in names), strict=True)


def frame(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, ARROW[k]) for c, k in zip(columns, kinds, strict=True)], list(names))


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """The (role, text) pairs of a formatted chunk."""
    at = 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        end = formatted.index(CLOSE, line)
        yield unescape(formatted[at + len(OPEN) : line]), unescape(formatted[line + 1 : end])
        at = end + len(CLOSE)


def read_back(chunks: DataFrame) -> DataFrame:
    """One row per conversation, read from its chunks: counts and digests of its turns and of what its loss mask covers.

    Chunks are parsed where they are; only their joined texts travel to the task of their
    conversation, which hashes them in order without holding more than a batch.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for c, chunk, part, formatted, mask in tuples(batch, ["conv_id", "chunk", "part", "formatted", "mask"]):
                turns = list(parse(formatted))
                loss = [unescape(formatted[m["start"] : m["end"]]) for m in mask]
                out.append((c, chunk, part, len(turns), "".join(f"{r}\n{t}\n" for r, t in turns).encode(), "".join(loss).encode(), sum(map(len, loss)), len(formatted)))
            yield frame(out, PARTS)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun = None, False
        for batch in batches:
            out = []
            for c, n, turns, loss, loss_chars, chars in tuples(batch, ["conv_id", "n_turns", "turns", "loss", "loss_chars", "formatted_chars"]):
                if not begun or c != now[0]:
                    if begun:
                        out.append(closed(now))
                    now, begun = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0], True
                now[1] += n
                now[2].update(turns)
                now[3] += loss_chars
                now[4].update(loss)
                now[5] += chars
            yield frame(out, DIGESTS)
        if begun:
            yield frame([closed(now)], DIGESTS)

    def closed(x: list) -> tuple:
        return x[0], x[1], x[2].hexdigest(), x[3], x[4].hexdigest(), x[5]

    return chunks.mapInArrow(parts, PARTS).repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "part").mapInArrow(digests, DIGESTS)


def message_events(conversations: DataFrame) -> DataFrame:
    """A log with one ``message`` event per stored row, each a message of its own.

    Rows without a turn come last, as in SQL's order; rows of one turn (also repeated ones)
    follow each other by role (null first), then text.
    """
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(LAST))
    order = Window.partitionBy("conv_id", "turn").orderBy(F.col("unplaced"), "role", "text")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"), F.lit(0).cast("long").alias("seq"), F.col("turn").isNull().alias("unplaced"), F.lit("message").alias("kind"), "role", "text")
    return rows.withColumn("tie", F.row_number().over(order).cast("long")).drop("unplaced")


def streamed(messages: DataFrame) -> DataFrame:
    """The log of message_events() as a chat's server would have written it, which folds to the same messages.

    An assistant's answer begins with a first attempt that is regenerated, and then
    comes in two deltas; what others say is a draft that is edited. Events of a message
    are four rows at most, whatever its length.
    """
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.char_length(text) / 2).cast("int")
    event = lambda seq, kind, role, text: F.struct(F.lit(seq).cast("long").alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))
    none = F.lit(None).cast("string")
    answer = F.array(
        event(0, "message", F.col("role"), F.lit("Well")),
        event(1, "regenerate", none, none),
        event(2, "delta", none, F.substring(text, F.lit(1), half)),
        event(3, "delta", none, F.substring(text, half + 1, F.char_length(text))),
    )
    other = F.array(event(0, "message", F.col("role"), F.lit("draft")), event(1, "edit", none, text))
    rows = messages.withColumn("e", F.explode(F.when(F.col("role") == "assistant", answer).otherwise(other)))
    return rows.select("conv_id", "turn", "tie", "e.*")


def format_chats(events: DataFrame) -> DataFrame:
    """The operator: an event log to formatted chunks."""
    return render(fold(events))
