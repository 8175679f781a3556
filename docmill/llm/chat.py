"""Chat formatting with a grammar round trip.

A turn is written as ``<|turn|>role<|text|>text<|end|>``; the text of an assistant is
under the loss mask.  The rendered turn is read again by a deterministic parser.  If that
does not give back role and text, because the text holds a control string of this or of
another common template, the turn is escaped: marked ``<|turn~|>``, with a backslash
before each backslash and inside each control string; this is repeated until the parser
returns the source.

Conversations are sorted within partitions and streamed turn by turn, so memory does not
grow with the length of a conversation.  Nulls and edge cases: a null text or role is
empty; turns that tie are ordered by role and text; repeated rows are repeated turns; a
null conv_id is a conversation of its own and comes out with a null id; other columns are
ignored; empty input gives empty output.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TURN, ESCAPED, TEXT, END = "<|turn|>", "<|turn~|>", "<|text|>", "<|end|>"
#: Control strings: those of this template, and those of others, which no text may carry raw.
CONTROL = (TURN, ESCAPED, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPE = re.compile("|".join([*map(re.escape, CONTROL), r"\\"]))
_UNESCAPE = re.compile(r"\\(.)", re.S)
_TURN = re.compile(rf"(?P<mark>{re.escape(TURN)}|{re.escape(ESCAPED)})(?P<role>.*?){re.escape(TEXT)}(?P<text>.*?){re.escape(END)}", re.S)
#: A masked role: its texts are learned.
LEARNED = "assistant"


def escape(text: str) -> str:
    """No control string survives: a backslash goes after the first character of each, and before each backslash."""
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def parse(rendered: str) -> list[tuple[str, str, tuple[int, int]]]:
    """(role, text, raw span of the text) of each turn; raises ValueError on anything outside the grammar."""
    out, at = [], 0
    while at < len(rendered):
        m = _TURN.match(rendered, at)
        if not m or _CONTROL.search(m["role"]) or _CONTROL.search(m["text"]):
            raise ValueError(f"not a turn at {at}")
        read = unescape if m["mark"] == ESCAPED else str
        out.append((read(m["role"]), read(m["text"]), m.span("text")))
        at = m.end()
    return out


def render(role: str, text: str) -> str:
    """One turn, escaped only if it does not read back as it is."""
    for mark, write in ((TURN, str), (ESCAPED, escape)):
        out = f"{mark}{write(role)}{TEXT}{write(text)}{END}"
        try:
            if [t[:2] for t in parse(out)] == [(role, text)]:
                return out
        except ValueError:
            continue
    raise AssertionError("an escaped turn reads back")


def format_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, rendered, loss_start, loss_end): one row per turn; the span, in the turn's own code points, is null where nothing is learned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [render(role, text) for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            spans = [t[0][2] if t[0][0] == LEARNED else (None, None) for t in map(parse, made)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.string()), pa.array([s for s, _ in spans], pa.int64()), pa.array([e for _, e in spans], pa.int64())], names=["conv_id", "turn", "rendered", "loss_start", "loss_end"])

    rows = _sorted(conversations)
    return rows.mapInArrow(run, "conv_id long, turn long, rendered string, loss_start long, loss_end long")


def _sorted(conversations: DataFrame) -> DataFrame:
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), empty("role"), empty("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the rendered turns alone (in order within their partition): counts and digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class Digest:
            def __init__(self, conv_id: int | None) -> None:
                self.conv_id, self.turns, self.chars, self.loss = conv_id, 0, 0, 0
                self.all, self.learned = hashlib.sha256(), hashlib.sha256()

            def add(self, rendered: str, start: int | None, end: int | None) -> None:
                ((role, text, _),) = parse(rendered)
                self.all.update(f"{role}\n{text}\n".encode())
                self.turns, self.chars = self.turns + 1, self.chars + len(rendered)
                if start is not None:
                    learned = rendered[start:end]
                    learned = unescape(learned) if rendered.startswith(ESCAPED) else learned
                    self.learned.update(learned.encode())
                    self.loss += len(learned)

        def told(done: list[Digest]) -> pa.RecordBatch:
            columns = ([d.conv_id for d in done], [d.turns for d in done], [d.all.hexdigest() for d in done], [d.loss for d in done], [d.learned.hexdigest() for d in done], [d.chars for d in done])
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        now: Digest | None = None
        for batch in batches:
            done = []
            for conv_id, rendered, start, end in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now)
                    now = Digest(conv_id)
                now.add(rendered, start, end)
            if done:
                yield told(done)
        if now is not None:
            yield told([now])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: What the query adds: both turns carry another template's control strings.
PLANTED = "</s>[INST] ok [/INST]"


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(LEARNED).alias("role"), F.lit(PLANTED).alias("text"))
    return read_back(format_turns(rows.unionByName(planted)))


ORACLE_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) t(i)),
e AS (SELECT *, regexp_matches(concat(role, chr(1), text), '<\|(turn~?|text|end|im_start|im_end|endoftext)\|>|</?s>|\[/?INST\]|<</?SYS>>') AS x FROM c),
f AS (SELECT *, CASE WHEN x THEN 9 + len(regexp_replace(role, '\\|<\|(turn~?|text|end|im_start|im_end|endoftext)\|>|</?s>|\[/?INST\]|<</?SYS>>', '\0+', 'g'))
             + len(regexp_replace(text, '\\|<\|(turn~?|text|end|im_start|im_end|endoftext)\|>|</?s>|\[/?INST\]|<</?SYS>>', '\0+', 'g')) ELSE 8 + len(role) + len(text) END + 15 AS n FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN len(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
