r"""Chat formatting with a grammar round trip.

A turn is rendered by the template

    <s>[INST] role \n text [/INST]</s>

(without the blanks around the line feed).  A deterministic parser reads it back: the opening, the
role up to the first line feed, the text up to the closing, with no bare control string (``<s>``,
``</s>``, ``[INST]``, ``[/INST]``) in either, and then removes escapes.  A turn is first rendered as
it is; while the parser does not give back the same role and text, the conflicting content is
escaped once more.  An escape puts one backslash after the first character of a control string;
control strings that already hold backslashes there gain one too, so removing one is exact.

Turns are rendered and checked row by row wherever they lie; a conversation is its segments in
order, so no conversation is gathered, whatever its length.  ``digests`` reads segments back in
order and keeps one running hash per conversation: rows of a conversation meet in one task (a
sha256 over them is sequential by nature) but only stream through it.

Defined results: a null text or role is empty; turns with the same number follow each other by
role and text, a null turn comes first; rows with a null conv_id form one conversation of their
own; roles other than ``assistant`` carry no loss; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlens.session import materialize

from .common import column, table

OPEN, CLOSE = "<s>[INST] ", " [/INST]</s>"
LOSS_ROLE = "assistant"

_BARE = re.compile(r"</?s>|\[/?INST\]")
_ESCAPABLE = re.compile(r"([<\[])(\\*)(?=/?s>|/?INST\])")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(?=/?s>|/?INST\])")

_SEGMENT = "conv_id long, turn long, role string, segment string, loss_start long, loss_length long"


class Conflict(ValueError):
    """Rendered text that the grammar does not accept."""


def escape(text: str) -> str:
    return _ESCAPABLE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


def parse_raw(segment: str, at: int = 0) -> tuple[str, str, int]:
    """(escaped role, escaped text, end) of the turn that starts at ``at``."""
    if not segment.startswith(OPEN, at):
        raise Conflict("no opening")
    head = segment.find("\n", at)
    end = segment.find(CLOSE, head + 1) if head >= 0 else -1
    if end < 0:
        raise Conflict("no closing")
    role, text = segment[at + len(OPEN):head], segment[head + 1:end]
    if _BARE.search(role) or _BARE.search(text):
        raise Conflict("a bare control string")
    return role, text, end + len(CLOSE)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of formatted text."""
    turns, at = [], 0
    while at < len(formatted):
        role, text, at = parse_raw(formatted, at)
        turns.append((_unescape_role(role), unescape(text)))
    return turns


def render(role: str, text: str) -> tuple[str, int, int]:
    """(segment, start and length of the text in it), such that ``parse`` gives the turn back."""
    shown_role, shown = _escape_role(role), text
    for _ in range(3):
        segment = f"{OPEN}{shown_role}\n{shown}{CLOSE}"
        try:
            if parse(segment) == [(role, text)]:
                return segment, len(OPEN) + len(shown_role) + 1, len(shown)
        except Conflict:
            pass
        shown = escape(shown)
    raise Conflict("a turn that cannot be escaped")


def format_turns(conversations: DataFrame) -> DataFrame:
    """One row per turn (conv_id, turn, role, text): its segment of the formatted conversation and
    the part of it under the loss mask (null for turns without loss)."""
    names = [f.split(" ")[0] for f in _SEGMENT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            segments, starts, lengths, roles = [], [], [], []
            for role, text in zip(column(batch, "role").to_pylist(), column(batch, "text").to_pylist()):
                segment, start, length = render(role or "", text or "")
                segments.append(segment)
                roles.append(role or "")
                starts.append(start if role == LOSS_ROLE else None)
                lengths.append(length if role == LOSS_ROLE else None)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "conv_id").cast(pa.int64()), column(batch, "turn").cast(pa.int64()), pa.array(roles, pa.string()),
                 pa.array(segments, pa.string()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64())], names=names)

    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                 F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return turns.mapInArrow(run, _SEGMENT)


def _text_of(segment: str) -> Column:
    """The unescaped text of a segment column, by which turns of one number and role follow each other."""
    head = F.locate("\n", F.col(segment))
    shown = F.substr(F.col(segment), head + 1, F.length(segment) - head - len(CLOSE))
    return F.regexp_replace(shown, _ESCAPED.pattern, "$1$2")


def digests(segments: DataFrame) -> DataFrame:
    """Per conversation, from its segments alone: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, done = None, None, []

        def out() -> pa.RecordBatch:
            rows = [(c, n, t.hexdigest(), lc, ls.hexdigest(), f) for c, (n, t, lc, ls, f) in done]
            done.clear()
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], ty) for i, ty in enumerate(types)], names=names)

        for batch in batches:
            for c, segment, start, length in zip(*(column(batch, n).to_pylist() for n in ("conv_id", "segment", "loss_start", "loss_length"))):
                if state is None or c != conv:
                    if state is not None:
                        done.append((conv, tuple(state)))
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(segment):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    learnt = unescape(segment[start:start + length])
                    state[2] += len(learnt)
                    state[3].update(learnt.encode())
                state[4] += len(segment)
            if len(done) >= 5000:
                yield out()
        if state is not None:
            done.append((conv, tuple(state)))
        if done:
            yield out()

    ordered = segments.repartition("conv_id").withColumn("text", _text_of("segment"))
    ordered = ordered.sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "segment", "loss_start", "loss_length").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, whose texts are control strings."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return digests(materialize(format_turns(given.unionByName(extra)), "chat"))


#: What a text or role becomes inside a segment, in SQL.
_SQL_ESCAPE = r"""regexp_replace({0}, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')"""
_SQL_ROLE = _SQL_ESCAPE.format(r"replace(replace(role, '\', '\\'), chr(10), '\n')")

SQL = rf"""WITH given AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
shown AS (
  SELECT *, {_SQL_ROLE} AS shown_role,
         CASE WHEN regexp_matches(text, '</?s>|\[/?INST\]|[<\[]\\+(/?s>|/?INST\])') THEN {_SQL_ESCAPE.format('text')} ELSE text END AS shown_text
  FROM given)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = '{LOSS_ROLE}'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = '{LOSS_ROLE}'), '')) AS loss_sha256,
       CAST(sum(length(shown_role) + length(shown_text) + {len(OPEN) + 1 + len(CLOSE)}) AS BIGINT) AS formatted_chars
FROM shown GROUP BY conv_id"""
