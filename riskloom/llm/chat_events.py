"""Event-sourced conversations.

A log holds events (conv_id, seq, msg, role, kind, text):

- ``message``: the message's text is this text (a new message, or a whole one);
- ``delta``: a streamed piece, appended to the message's text;
- ``edit``: the message's text becomes this text;
- ``regenerate``: the text so far is dropped, later deltas build a new one;
- ``delete``: the message goes (a later event brings it back).

``msg`` names the message within its conversation; a null msg is a message of
its own. A message stands where its first event stands. The log is partitioned
by conversation and sorted by (place of the message, sequence); Python then
reads it as a stream and folds one message at a time, so memory is bounded by
the longest message and not by the conversation. One conversation with a large
part of all events is one stream in one task: its digests are sequential by
nature. Nothing is ever gathered per conversation.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n`` per message. Texts and
roles are escaped reversibly: between ``<`` and ``|`` a run of backslashes grows by
one, so no control string can occur inside a text; line feeds and backslashes
in roles are written as ``\\n`` and ``\\\\``. The loss mask covers the texts of
``assistant`` messages.

Null text, role and kind count as empty, empty and ``message``. A null sequence
sorts first; ties go by role, kind and text, so repeated events are folded in a
defined order (two equal ``message`` events without msg are two messages). A
null conv_id is a conversation of its own. Empty logs give empty results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import ship_package

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"
RENDERED = "conv_id long, msg_index long, segment string, start long, loss_start long, loss_end long"
READ_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_BATCH_CHARS = 1 << 22


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def ordered_events(log: DataFrame) -> DataFrame:
    """The log by conversation, each message's events together at the place of its first."""
    cols = [F.col("conv_id").cast("long"), F.col("seq").cast("long"), F.col("msg").cast("string"),
            *(F.coalesce(F.col(c).cast("string"), F.lit(d)).alias(c) for c, d in (("role", ""), ("kind", "message"), ("text", "")))]
    events = log.select(*cols)
    # events without msg stand alone: they never gather in one window
    place = Window.partitionBy("conv_id", "msg", F.when(F.col("msg").isNull(), F.col("seq")))
    return (events.repartition("conv_id")
            .withColumn("place", F.when(F.col("msg").isNull(), F.col("seq")).otherwise(F.min("seq").over(place)))
            .sortWithinPartitions("conv_id", "place", "msg", "seq", "role", "kind", "text"))


STEPS = 8  # sequence numbers of a turn
LATE = 3  # turns after which an edit arrives
DRAFT = " [first draft]"


def turn_events(turns: DataFrame) -> DataFrame:
    """A log of streamed, edited and regenerated messages whose final texts are
    those of ``turns`` (conv_id, turn, role, text).

    A turn's text and number decide how it came about: sent whole; streamed in three
    deltas; sent as a draft and edited some turns later; or streamed, dropped and
    streamed again. Rows of one turn stand by role and text, repeated rows are
    messages of their own. A null turn (or one too large to number its events)
    is sent whole and sorts first."""
    lead = F.expr(f"try_multiply(CAST(turn AS long), {STEPS}L)")
    same = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = (turns.repartition("conv_id").withColumn("copy", F.row_number().over(same))
            .select(F.col("conv_id").cast("long").alias("conv_id"), lead.alias("lead"), "role", F.coalesce("text", F.lit("")).alias("text"),
                    F.concat_ws(":", F.coalesce(F.col("turn").cast("string"), F.lit("")), F.lpad(F.col("copy").cast("string"), 10, "0")).alias("msg"),
                    F.pmod(F.xxhash64("turn", "text"), F.lit(4)).alias("way"), F.floor(F.length(F.coalesce("text", F.lit(""))) / 3).cast("int").alias("third")))

    def event(step: int, kind: str, text: Column) -> Column:
        # late edits may pass the end of the numbers; those turns are sent whole
        return F.struct(F.expr(f"try_add(lead, {step}L)").alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))

    text, third = F.col("text"), F.col("third")
    pieces = [F.substring(text, F.lit(1), third), F.substring(text, third + 1, third), F.substring(text, third * 2 + 1, F.length(text))]
    whole = F.array(event(0, "message", text))
    streamed = F.array(*[event(i, "delta", p) for i, p in enumerate(pieces)])
    edited = F.array(event(0, "message", F.concat(pieces[0], F.lit(DRAFT))), event(LATE * STEPS + STEPS - 1, "edit", text))
    again = F.array(event(0, "delta", F.concat(pieces[0], F.lit(DRAFT))), event(1, "regenerate", F.lit("")), event(2, "delta", pieces[0]),
                    event(3, "delta", pieces[1]), event(4, "delta", pieces[2]))
    numbered = F.expr(f"try_add(lead, {(LATE + 1) * STEPS}L)").isNotNull()
    events = F.when(~numbered | (F.col("way") == 0), whole).when(F.col("way") == 1, streamed).when(F.col("way") == 2, edited).otherwise(again)
    return rows.select("conv_id", "msg", "role", F.explode(events).alias("e")).select("conv_id", "e.seq", "msg", "role", "e.kind", "e.text")


class _Message:
    def __init__(self, conv, role):
        self.conv, self.role, self.parts, self.alive = conv, role, [], True

    def apply(self, kind: str, text: str) -> None:
        if kind == "delta":
            self.parts.append(text)
        elif kind == "regenerate":
            self.parts = [text] if text else []
        elif kind in ("message", "edit"):
            self.parts = [text]
        elif kind != "delete":
            raise ValueError(f"unknown event kind {kind!r}")
        self.alive = kind != "delete"


def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, str]]:
    """(conv_id, role, final text) of each message of a sorted stream."""
    key, held = None, None
    for b in batches:
        for conv, msg, role, kind, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "msg", "role", "kind", "text"))):
            if held is None or msg is None or key != (conv, msg):
                if held and held.alive:
                    yield held.conv, held.role, "".join(held.parts)
                key, held = (conv, msg), _Message(conv, role)
            held.apply(kind, text)
    if held and held.alive:
        yield held.conv, held.role, "".join(held.parts)


def _batched(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], size=lambda r: 64) -> Iterator[pa.RecordBatch]:
    out, total = [], 0
    for r in rows:
        out.append(r)
        total += size(r)
        if total > _BATCH_CHARS or len(out) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
            out, total = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


def render_messages(messages: Iterator[tuple[int | None, str, str]]) -> Iterator[tuple]:
    """One row per message: its rendered segment, where that starts in the
    conversation's formatted text, and the span of the segment under the loss mask."""
    conv, index, at, first = None, 0, 0, True
    for c, role, text in messages:
        if first or c != conv:
            conv, index, at, first = c, 0, 0, False
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        segment = f"{head}{body}{END}\n"
        masked = role == LOSS_ROLE
        yield c, index, segment, at, len(head) if masked else 0, len(head) + len(body) if masked else 0
        index, at = index + 1, at + len(segment)


def render(log: DataFrame) -> DataFrame:
    """Rendered messages in order within each conversation's partition: conv_id,
    msg_index, segment, start and the loss span within the segment."""
    ship_package(log.sparkSession)
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(render_messages(fold(batches)), ["conv_id", "msg_index", "segment", "start", "loss_start", "loss_end"], types, lambda r: len(r[2]))

    return ordered_events(log).drop("place", "seq").mapInArrow(run, RENDERED)


_SEGMENT = re.compile(re.escape(START) + r"([^\n]*)\n(.*)" + re.escape(END) + r"\n", re.S)


def read_segment(segment: str) -> tuple[str, str]:
    """(role, text) back from a rendered segment, which must be exactly one message."""
    m = _SEGMENT.fullmatch(segment)
    if not m or segment.count(START) != 1 or segment.count(END) != 1:
        raise ValueError("a segment is not one message")
    return unescape_role(m[1]), unescape(m[2])


def digests(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Per conversation, read back from rendered rows in order: READ_BACK."""
    conv, state = None, None

    def done():
        return (conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

    for c, index, segment, start, a, b in rows:
        if state is None or index == 0:
            if state is not None:
                yield done()
            conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
        if c != conv or start != state[4] or index != state[0]:
            raise ValueError("rendered messages are out of order")
        role, text = read_segment(segment)
        state[0] += 1
        state[1].update(f"{role}\n{text}\n".encode())
        loss = unescape(segment[a:b])
        state[2] += len(loss)
        state[3].update(loss.encode())
        state[4] += len(segment)
    if state is not None:
        yield done()


def read_back(rendered: DataFrame) -> DataFrame:
    """Digests of what ``render`` wrote (same partitions, same order)."""
    ship_package(rendered.sparkSession)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        yield from _batched(digests(rows), names, types)

    return rendered.mapInArrow(run, READ_BACK)


def formatted_texts(rendered: DataFrame) -> DataFrame:
    """conv_id, formatted text and loss spans (start, end) in it, for
    conversations that fit in one value."""
    spans = F.struct((F.col("start") + F.col("loss_start")).alias("start"), (F.col("start") + F.col("loss_end")).alias("end"))
    parts = F.sort_array(F.collect_list(F.struct("msg_index", "segment", spans.alias("span"), (F.col("loss_end") > 0).alias("masked"))))
    return (rendered.groupBy("conv_id").agg(parts.alias("p"))
            .select("conv_id", F.concat_ws("", F.transform("p", lambda x: x.segment)).alias("formatted"),
                    F.transform(F.filter("p", lambda x: x.masked), lambda x: x.span).alias("loss_spans")))
