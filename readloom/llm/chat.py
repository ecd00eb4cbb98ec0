r"""Chat formatting by columnar byte assembly.

Turns are formatted as

    ### role
    text</turn>

with control characters of roles and texts escaped (see ``ESCAPES``), so that neither "###" nor "</turn>" can
stand inside a turn and every text can be read back. A record batch is assembled at once: numpy computes the lengths of all
segments, their cumulative offsets and the scatter indices, and copies headers and contents into one buffer
that Arrow takes over without a copy.

Conversations come out in parts: rows are range-sorted by conversation and turn, so a
conversation of any length may spread over tasks and batches.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rows, out_schema, rows_of, saved, table, text_bytes

#: Escaped byte and what follows the backslash. The line end is escaped in roles alone.
ESCAPES = {b"\\": b"\\", b"<": b"l", b"#": b"h", b"\n": b"n"}
OPEN, MIDDLE, CLOSE = b"### ", b"\n", b"</turn>\n"

PARTS = "conv_id long, part long, n_turns long, formatted string, loss_spans array<struct<start:int,stop:int>>"
TURN = re.compile(rb"### ([^\n]*)\n([^<]*)</turn>\n")
ESCAPED = re.compile(rb"\\(.)", re.S)
PLAIN = {v: k for k, v in ESCAPES.items()}


def escape_table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for c in chars:
        out[c] = ESCAPES[bytes([c])][0]
    return out


IN_ROLE, IN_TEXT = escape_table(b"\\<#\n"), escape_table(b"\\<#")


def unescape(data: bytes) -> bytes:
    return ESCAPED.sub(lambda m: PLAIN[m[1]], data) if b"\\" in data else data


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets from 0) of a binary column without nulls."""
    width = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at - at[0]


def escaped(column: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes with escapes in place, and the new offsets."""
    raw, offsets = column_bytes(column)
    second = table[raw]
    extra = np.concatenate([[0], np.cumsum(second != 0)])
    if not extra[-1]:
        return raw, offsets
    out = np.empty(len(raw) + int(extra[-1]), np.uint8)
    at = np.arange(len(raw)) + extra[1:]
    out[at] = np.where(second != 0, second, raw)
    out[at[second != 0] - 1] = ord("\\")
    return out, offsets + extra[offsets]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with all turns; where each turn begins (and the end); where its text begins and stops."""
    n = len(roles)
    segments = [np.frombuffer(OPEN, np.uint8), escaped(roles, IN_ROLE), np.frombuffer(MIDDLE, np.uint8), escaped(texts, IN_TEXT), np.frombuffer(CLOSE, np.uint8)]
    lengths = np.stack([np.full(n, len(s)) if isinstance(s, np.ndarray) else np.diff(s[1]) for s in segments], axis=1).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    out = np.empty(int(starts[-1]), np.uint8)
    at = starts[:-1].reshape(n, len(segments))
    for i, s in enumerate(segments):
        if isinstance(s, np.ndarray):
            out[at[:, i, None] + np.arange(len(s))] = s
        else:
            data, offsets = s
            out[np.arange(len(data)) + np.repeat(at[:, i] - offsets[:-1], np.diff(offsets))] = data
    return out, np.append(at[:, 0], starts[-1]), at[:, 3], at[:, 4]


def format_chats(rows: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained_role: str = "assistant") -> DataFrame:
    """Formatted conversations in parts (``PARTS``): part numbers order a conversation's parts, ``loss_spans`` are byte
    spans of the escaped texts of ``trained_role`` within the part.

    Rows of a conversation go by turn (null first), then role and text, so repeated turns have a fixed order. Null roles
    and texts are empty; rows with a null id are one conversation with a null id; other columns are ignored; an empty
    table gives no parts.
    """
    chosen = rows.select(F.col(id_col).cast("long").alias("id"), F.col(turn_col).alias("turn"), text_bytes(role_col).alias("role"), text_bytes(text_col).alias("text"))
    order = ["id", "turn", "role", "text"]
    schema = out_schema(PARTS)
    trained = trained_role.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids = batch.column("id")
            key, null = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
            new = np.append(True, (key[1:] != key[:-1]) | (null[1:] != null[:-1]))
            first = np.append(np.flatnonzero(new), n)  # first row of each conversation
            data, turns, begin, stop = assemble(batch.column("role"), batch.column("text"))
            offsets = turns[first]
            formatted = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
            loss = np.flatnonzero([r == trained for r in batch.column("role").to_pylist()])
            conv = np.cumsum(new)[loss] - 1
            spans = pa.StructArray.from_arrays([pa.array((begin[loss] - offsets[conv]).astype(np.int32)), pa.array((stop[loss] - offsets[conv]).astype(np.int32))], fields=list(schema.field("loss_spans").type.value_type))
            ends = np.searchsorted(conv, np.arange(len(first)))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(first[:-1])), pa.array(part + np.arange(len(first) - 1)), pa.array(np.diff(first), pa.int64()), formatted.cast(pa.binary()).cast(pa.string()), lists.cast(schema.field("loss_spans").type)], schema=schema)
            part += len(first) - 1

    return chosen.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, PARTS)


def parse_part(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """(role, text) of each turn, unescaped. Bytes that are no turn are an error."""
    out, at = [], 0
    for m in TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("a formatted conversation is damaged")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("a formatted conversation is damaged")
    return out


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_chats(parts: DataFrame) -> DataFrame:
    """A row per conversation with digests of what its parts say (``DIGESTS``), part after part in bounded memory."""
    schema = out_schema(DIGESTS)
    chars = lambda data: int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, current, state = Rows(schema), None, None
        for batch in batches:
            for conv, n_turns, data, spans in rows_of(batch, "conv_id", "n_turns", "data", "loss_spans"):
                if state is None or conv != current:
                    if state is not None and out.add((current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])):
                        yield out.batch()
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns = parse_part(data)
                if len(turns) != n_turns:
                    raise ValueError("turns are missing from a formatted conversation")
                state[0] += n_turns
                for role, text in turns:
                    state[1].update(role + b"\n" + text + b"\n")
                for span in spans:
                    text = unescape(data[span["start"] : span["stop"]])
                    state[2] += chars(text)
                    state[3].update(text)
                state[4] += chars(data)
        if state is not None:
            out.add((current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
        yield from out.rest()

    chosen = parts.select("conv_id", "part", "n_turns", F.col("formatted").cast("binary").alias("data"), "loss_spans")
    return chosen.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(run, DIGESTS)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")], "conv_id long, turn long, role string, text string")
    return read_chats(saved(format_chats(rows.unionByName(odd)), "chats"))


OP7_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '\### Assistant: </turn> ok')
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(13 + length(role) + length(text) + length(regexp_replace(role, '[^\\<#\n]', '', 'g')) + length(regexp_replace(text, '[^\\<#]', '', 'g')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
