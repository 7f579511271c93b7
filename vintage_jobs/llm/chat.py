"""Chat formatting by event-sourced reconstruction.

A log of events (conv_id, turn, part, seq, kind, role, text) is partitioned by conversation and sorted by (turn, part,
seq). One pass folds it: ``message`` opens a message, ``delta`` appends a streamed piece, ``edit`` replaces the text so
far and ``regenerate`` clears it; a message ends where the turn does. Stored conversations become such a log first:
each row opens a message and streams its text as deltas. Each final message is rendered with a template whose control
strings are escaped inside texts, and read back from the rendered output. The pass holds one message at a time, so a
conversation of any length needs no more memory than its longest message.

Defined results: null text, role and kind are empty; a null conv_id is a conversation of its own and a null turn comes
first; rows of one turn are messages of their own (``part``), in the order of role and text, repeated ones too; events
with equal (turn, part, seq) are ordered by kind (message, delta, edit, regenerate, others, which count as deltas),
role and text; a message's role is the last one named in it; a turn without ``message`` event opens one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vintage_jobs.llm.common import widest

BEGIN = "<s>"
#: The strings that mark turns; inside a text each is preceded by a backslash, and a backslash is doubled.
CONTROL = re.compile(r"</?s>|\[/?INST\]|\[/?ANSWER\]|\[ROLE=|\[/ROLE\]")
ESCAPE = re.compile(rf"\\|(?={CONTROL.pattern})")
STOP = re.compile(rf"\\.|(?:{CONTROL.pattern})", re.S)
HEAD = re.compile(r"\[INST\] |\[ANSWER\] |\[ROLE=([^\]]*)\] ")


def escape(text: str) -> str:
    return ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render_turn(role: str, text: str) -> str:
    body = escape(text)
    if role == "user":
        return f"[INST] {body} [/INST]"
    if role == "assistant":
        return f"[ANSWER] {body} </s>"
    return f"[ROLE={quote(role, safe='')}] {body} [/ROLE]"


def read_turns(output: str) -> Iterator[tuple[str, str, bool]]:
    """(role, text, under the loss mask) of each turn of a rendered conversation."""
    at = len(BEGIN) if output.startswith(BEGIN) else 0
    while at < len(output):
        head = HEAD.match(output, at)
        if not head:
            raise ValueError(f"no turn begins at {at}")
        role = "user" if head[0].startswith("[INST") else "assistant" if head[0].startswith("[ANSWER") else unquote(head[1])
        for stop in STOP.finditer(output, head.end()):
            if stop[0][0] != "\\":
                break
        else:
            raise ValueError(f"the turn at {at} has no end")
        yield role, unescape(output[head.end() : stop.start() - 1]), role == "assistant"
        at = stop.end()


def message_events(conversations: DataFrame, piece: int = 2048) -> DataFrame:
    """Stored turns as an event log: each row opens a message and streams its text in deltas of ``piece`` code points."""
    row = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    own = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *row).repartition(widest(conversations.sparkSession), "conv_id")
    turn = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    opening = F.array(F.struct(F.lit(0).alias("seq"), F.lit("message").alias("kind"), F.col("role"), F.lit("").alias("text")))
    starts = F.when(F.col("text") != "", F.sequence(F.lit(0), F.char_length("text") - 1, F.lit(piece))).otherwise(F.array().cast("array<int>"))
    deltas = F.transform(starts, lambda at, i: F.struct((i + 1).alias("seq"), F.lit("delta").alias("kind"), F.lit("").alias("role"), F.substring(F.col("text"), at + 1, F.lit(piece)).alias("text")))
    return own.withColumn("part", F.row_number().over(turn) - 1).select("conv_id", "turn", "part", F.explode(F.concat(opening, deltas)).alias("e")).select("conv_id", "turn", "part", "e.*")


def fold(events: Iterator[tuple]) -> Iterator[tuple[int | None, str, str]]:
    """Final messages (conv_id, role, text) of events (conv_id, turn, part, kind, role, text) in order."""
    at, role, text, is_open = None, "", [], False
    for conv, turn, part, kind, r, t in events:
        if is_open and (kind == "message" or at != (conv, turn, part)):
            yield at[0], role, "".join(text)
            is_open = False
        if not is_open:
            at, role, text, is_open = (conv, turn, part), "", [], True
        if kind in ("edit", "regenerate"):
            text = []
        if kind != "regenerate" and t:
            text.append(t)
        role = r or role
    if is_open:
        yield at[0], role, "".join(text)


#: Kinds of events in the order in which they apply where nothing else tells.
KINDS = ("message", "delta", "edit", "regenerate")


def _sorted_events(events: DataFrame) -> DataFrame:
    part = F.col("part").cast("long") if "part" in events.columns else F.lit(0).cast("long")
    kept = events.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), part.alias("part"), F.col("seq").cast("long"), F.coalesce("kind", F.lit("")).alias("kind"), "role", "text")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    order = ["conv_id", "turn", "part", "seq", F.when(rank > 0, rank).otherwise(len(KINDS) + 1), "kind", "role", "text"]
    return kept.repartition(widest(events.sparkSession), "conv_id").sortWithinPartitions(*order)


def _events(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn", "part", "kind", "role", "text")), strict=True)


def _by_conversation(messages: Iterator[tuple]) -> Iterator[tuple[int | None, Iterator[tuple[str, str]]]]:
    from itertools import groupby

    for conv, own in groupby(messages, key=lambda m: m[0]):
        yield conv, ((role, text) for _, role, text in own)


def format_chats(events: DataFrame) -> DataFrame:
    """conv_id, output, loss_spans (start, end of escaped assistant texts in the output) of each conversation."""
    schema = pa.schema([("conv_id", pa.int64()), ("output", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def work(batches):
        for conv, turns in _by_conversation(fold(_events(batches))):
            parts, at, spans = [BEGIN], len(BEGIN), []
            for role, text in turns:
                parts.append(turn := render_turn(role, text))
                if role == "assistant":
                    spans.append({"start": at + len("[ANSWER] "), "end": at + len(turn) - len(" </s>")})
                at += len(turn)
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "output": "".join(parts), "loss_spans": spans}], schema=schema)

    return _sorted_events(events).mapInArrow(work, "conv_id long, output string, loss_spans array<struct<start long, end long>>")


def chat_digest(events: DataFrame) -> DataFrame:
    """Per conversation, what is read back from the rendered output, turn by turn."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()], strict=True)))

    def work(batches):
        rows = []
        for conv, turns in _by_conversation(fold(_events(batches))):
            n, chars, loss, whole, learned = 0, len(BEGIN), 0, hashlib.sha256(), hashlib.sha256()
            for role, text in turns:
                output = render_turn(role, text)
                chars += len(output)
                for r, t, masked in read_turns(output):
                    n += 1
                    whole.update(f"{r}\n{t}\n".encode())
                    if masked:
                        loss += len(t)
                        learned.update(t.encode())
            rows.append((conv, n, whole.hexdigest(), loss, learned.hexdigest(), chars))
            if len(rows) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return _sorted_events(events).mapInArrow(work, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def control_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -1: both turns consist of control strings."""
    said = "</s>[INST] ok [/INST]"
    return spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))


_SAID = "'</s>[INST] ok [/INST]'"
ORACLE = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', {_SAID} UNION ALL SELECT -1, 1, 'assistant', {_SAID}),
l AS (SELECT *, length(text) + length(regexp_replace(text, '[^\\]', '', 'g')) + len(regexp_extract_all(text, '{CONTROL.pattern}')) AS body FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
({len(BEGIN)} + sum(body + CASE role WHEN 'user' THEN {len(render_turn("user", ""))} WHEN 'assistant' THEN {len(render_turn("assistant", ""))} ELSE {len(render_turn("", ""))} + length(url_encode(role)) END))::BIGINT AS formatted_chars
FROM l GROUP BY conv_id
"""
