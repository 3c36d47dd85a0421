r"""Chat formatting (operator 10): grammar round trip.

    conversation = { turn }
    turn         = "### " role ": " text " </turn>" newline

A control string is ``###`` or ``</turn>``.  In a formatted text a control
string with an odd number of backslashes before it is content: 2k+1 of them
stand for k and the string itself.  Text is first rendered as it is and parsed
again; only if the turns do not come back identical is the content escaped, by
2k+1 backslashes for k before every control string, and parsed once more.  The
offsets of each assistant text make up the loss mask.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.session import ship

#: A run of backslashes is tried from its first one only, so a text is read once whatever its marks.
CONTROL = re.compile(r"(?<!\\)(\\*)(###|</turn>)")
ROLE = re.compile(r"### ((?:[^\\:\n]|\\[\\:n])*): ")
PLAIN_ROLE = re.compile(r"[^\\:\n]*")
END = " </turn>\n"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" * (2 * len(m[1]) + 1) + m[2], text)


def unescape(text: str) -> str:
    """Undoes escape; a control string with an even number of backslashes is left as it is."""
    return CONTROL.sub(lambda m: "\\" * (len(m[1]) // 2) + m[2] if len(m[1]) % 2 else m[0], text)


def _role(role: str) -> str:
    return role if PLAIN_ROLE.fullmatch(role) else role.replace("\\", "\\\\").replace(":", "\\:").replace("\n", "\\n")


def _unrole(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)


def render(turns: list[tuple[str, str]], escaped: bool) -> tuple[str, list[tuple[int, int, int]]]:
    """The formatted text, and (turn, start, end) of each turn's text in it."""
    out, spans, at = [], [], 0
    for i, (role, text) in enumerate(turns):
        head, body = f"### {_role(role)}: ", escape(text) if escaped else text
        spans.append((i, at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def parse(text: str) -> list[tuple[str, str, int, int]] | None:
    """(role, text, start, end) of each turn; None if the text is not of the grammar."""
    turns, at = [], 0
    while at < len(text):
        head = ROLE.match(text, at)
        if not head:
            return None
        end = head.end()
        while True:  # the next end mark that no backslash makes content
            end = text.find("</turn>", end)
            if end < 0:
                return None
            if text[end - 1] == " " and end - 1 >= head.end() and text[end + 7 : end + 8] == "\n":
                break
            end += 1
        turns.append((_unrole(head[1]), unescape(text[head.end() : end - 1]), head.end(), end - 1))
        at = end + 8
    return turns


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, int]]]:
    """The formatted text and spans; escaped only where the plain text does not come back."""
    for escaped in (False, True):
        text, spans = render(turns, escaped)
        back = parse(text)
        if back is not None and [(r, t) for r, t, _, _ in back] == turns and [(a, b) for *_, a, b in back] == [(a, b) for _, a, b in spans]:
            return text, spans
    raise ValueError("a conversation does not come back from its format")


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """One row for each conversation: conv_id, formatted (string) and loss_spans
    (array of (start, end), in code points of formatted), the texts of role ``learn``.

    Rows are in order of turn, null first; ties, by role and text.  Null role or
    text: empty.  Repeated rows are turns of their own.  Null conv_id: one
    conversation.  Empty table: empty result.  Further columns are ignored.  A
    conversation is one text, however long, so its turns meet in one task."""
    ship(turns.sparkSession)
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).alias("x"))
    lists = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    lists = lists.select("conv_id", F.transform("x", lambda x: x["role"]).alias("roles"), F.transform("x", lambda x: x["text"]).alias("texts"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            formatted, spans = [], []
            for roles, texts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                whole, at = format_turns(list(zip(roles, texts, strict=True)))
                formatted.append(whole)
                spans.append([{"start": a, "end": b} for i, a, b in at if roles[i] == learn])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(formatted, pa.string()), pa.array(spans, kind)], names=["conv_id", "formatted", "loss_spans"])

    kind = turns.schema[conv_id].dataType.simpleString()
    return lists.mapInArrow(run, f"conv_id {kind}, formatted string, loss_spans array<struct<start:int,end:int>>")


def digest_chats(formatted: DataFrame) -> DataFrame:
    """What reads back from the output of format_chats: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars.

    One row for each row, so null and repeated conv_ids stay.  An empty text has no
    turns; a text that is not of the grammar, null included, is an error.  Empty or
    null spans: no loss characters.  Very long texts are read once.  Empty table: empty
    result.  Further columns are ignored."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = None if text is None else parse(text)
                if turns is None:
                    raise ValueError("a formatted text is not of the grammar")
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans or [])
                whole = "".join(f"{r}\n{t}\n" for r, t, _, _ in turns)
                out.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    ship(formatted.sparkSession)
    formatted = formatted.select("conv_id", "formatted", "loss_spans")
    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op10_chat(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for all conversations and conversation -7."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    return digest_chats(format_chats(rows.union(more)))
