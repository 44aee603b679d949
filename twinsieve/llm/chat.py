"""Chat formatting by incremental black-box rendering.

A template is any function from turns to text; nothing is known of its inside. For each conversation
its successive turn prefixes are rendered and consecutive outputs compared: a template that only
appends gives each turn the span by which the output grew; where an earlier output is not a prefix
of the next, the template rewrites history and is reported with the place from which it does. Within
a span the text's own place is found by rendering the same prefix with a marker as last text. All
results are read back from the output by these spans.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Turn = tuple[str, str]
_CONTROL = re.compile(r"(\\|###|</turn>)")
_ESCAPED = re.compile(r"\\(\\|###|</turn>)")
MARK = "mark"


def escape(text: str) -> str:
    """Control strings and backslashes get a backslash before them; ``unescape`` undoes it exactly."""
    return _CONTROL.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def turn_template(turns: list[Turn]) -> str:
    """``### Role: text </turn>`` lines, texts escaped."""
    return "".join(f"### {escape(role).capitalize()}: {escape(text)} </turn>\n" for role, text in turns)


def common_prefix(a: str, b: str) -> int:
    return len(os.path.commonprefix([a, b]))


def locate(turns: list[Turn], template: Callable[[list[Turn]], str] = turn_template, escaped: Callable[[str], str] = escape) -> tuple[str, list[dict]]:
    """The formatted conversation, and per turn: role, start and end of its span, text_start and text_end, rewrites_from (-1: only appended).

    Spans of a turn that rewrites history begin where the outputs part. Text places are -1 where the
    template does not show the text (as its ``escaped`` form).
    """
    before, spans = template([]), []
    for k, (role, text) in enumerate(turns):
        now = template(turns[: k + 1])
        appended = now.startswith(before)
        start = len(before) if appended else common_prefix(before, now)
        marked = template([*turns[:k], (role, MARK)])
        at, shown = marked.find(MARK, start), escaped(text)
        found = at >= 0 and now.startswith(shown, at) and len(now) - len(shown) == len(marked) - len(MARK)
        spans.append({"role": role, "start": start, "end": len(now), "text_start": at if found else -1, "text_end": at + len(shown) if found else -1, "rewrites_from": -1 if appended else start})
        before = now
    return before, spans


SPANS = "array<struct<role:string,start:bigint,end:bigint,text_start:bigint,text_end:bigint,rewrites_from:bigint>>"
_SPANS = pa.list_(pa.struct([("role", pa.string()), *((n, pa.int64()) for n in ("start", "end", "text_start", "text_end", "rewrites_from"))]))


def format_conversations(turns: DataFrame, template: Callable[[list[Turn]], str] = turn_template, escaped: Callable[[str], str] = escape) -> DataFrame:
    """(conv_id, formatted, spans) of every conversation in ``turns`` (conv_id, turn, role, text).

    Turns stand in order of turn, role and text (nulls first); repeated rows are turns of their own.
    Null role or text: empty. Rows of null conv_id form one conversation. One conversation is one
    output row and so meets in one task; an empty table gives no rows; other columns are not read.
    """

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                done = [locate([(t["role"] or "", t["text"] or "") for t in ts], template, escaped) for ts in part.column("turns").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("conv_id"), pa.array([o for o, _ in done], pa.string()), pa.array([s for _, s in done], _SPANS)], ["conv_id", "formatted", "spans"])

    kind = turns.schema["conv_id"].dataType.simpleString()
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return grouped.mapInArrow(render, f"conv_id {kind}, formatted string, spans {SPANS}")


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def conversation_digests(formatted: DataFrame, learn: str = "assistant") -> DataFrame:
    """Digests read back from the formatted text by its spans; the loss mask covers the texts of role ``learn``."""

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                texts = [(s["role"], unescape(r["formatted"][s["text_start"] : s["text_end"]])) for s in r["spans"]]
                loss = "".join(t for role, t in texts if role == learn)
                rows.append((r["conv_id"], len(texts), sha("".join(f"{role}\n{t}\n" for role, t in texts)), len(loss), sha(loss), len(r["formatted"])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(read, DIGESTS)


def with_control_conversation(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """``turns`` and conversation -7, whose texts hold the template's own control strings."""
    text = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)


#: The same digests in DuckDB SQL.
DIGEST_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (SELECT *, '### ' || upper(substr(role, 1, 1)) || lower(substr(role, 2)) || ': '
  || regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g') || ' </turn>' || chr(10) AS line FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(line)) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
