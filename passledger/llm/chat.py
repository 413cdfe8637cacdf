"""Conversations as training text with a mask of what the model said.

A compiled template turns a conversation's messages into text. Control strings inside
texts are broken by a mark that can be taken out again, so the text can be read back.
A conversation is formatted turn by turn: whatever its length, a task holds one turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passledger.llm.template import Piece, compiled

#: The control strings of the template. None holds the mark.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
_MARK = "\\"
_ANY = re.compile("|".join(re.escape(c) for c in CONTROLS))

TEMPLATE = (
    "{% for m in messages %}{{ '<s>' }}"
    "{% if m.role == 'user' %}{{ '[INST]' + ' ' }}{{ m.text | guard }}{{ ' ' + '[/INST]' }}"
    "{% elif m.role == 'assistant' %}{% generation %}{{ m.text | guard }}{% endgeneration %}"
    "{% else %}[ROLE]{{ m.role | guard }}[/ROLE]{{ m.text | guard }}{% endif %}"
    "{{ '</s>' }}{% endfor %}"
)


def guard(text: str) -> str:
    """Doubles marks and puts one behind the first character of each control string."""
    return _ANY.sub(lambda m: m[0][0] + _MARK + m[0][1:], text.replace(_MARK, _MARK * 2))


def unguard(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def read_turn(chunk: str) -> tuple[str, str]:
    """Role and text of one formatted turn, control strings in place again."""
    body = chunk[len("<s>") : -len("</s>")]
    if body.startswith("[INST] "):
        return "user", unguard(body[len("[INST] ") : -len(" [/INST]")])
    if body.startswith("[ROLE]"):
        role, _, text = body[len("[ROLE]") :].partition("[/ROLE]")
        return unguard(role), unguard(text)
    return "assistant", unguard(body)


def turns_of(pieces: Iterator[Piece]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Formatted turns with the (start, end) spans of model output in them."""
    parts, spans, size = [], [], 0
    for text, marked in pieces:
        # a folded text may end one turn and begin the next
        for part in re.split(r"(?<=</s>)", text) if not marked else [text]:
            if marked:
                spans.append((size, size + len(part)))
            if part:
                parts.append(part)
                size += len(part)
            if not marked and part.endswith("</s>"):
                yield "".join(parts), spans
                parts, spans, size = [], [], 0
    if parts:
        raise ValueError("the template leaves a turn open")


def digest(turns: Iterable[tuple[str, list[tuple[int, int]]]]) -> tuple[int, str, int, str, int]:
    """n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read from the output."""
    count = loss = size = 0
    of_turns, of_loss = hashlib.sha256(), hashlib.sha256()
    for chunk, spans in turns:
        role, text = read_turn(chunk)
        of_turns.update(f"{role}\n{text}\n".encode())
        for start, end in spans:
            said = unguard(chunk[start:end])
            loss += len(said)
            of_loss.update(said.encode())
        count += 1
        size += len(chunk)
    return count, of_turns.hexdigest(), loss, of_loss.hexdigest(), size


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    def rows():
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c) for c in ("conv_id", "role", "text"))):
                yield conv.as_py(), {"role": role.as_py(), "text": text.as_py()}

    for conv, group in groupby(rows(), key=lambda r: r[0]):
        yield conv, (m for _, m in group)


def _ordered(messages: DataFrame) -> DataFrame:
    """Rows of a conversation together and by turn; of equal turns by role, then text."""
    return (
        messages.select(
            F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        )
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )


def formatted(messages: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """The formatted turns of ``messages`` (conv_id, turn, role, text).

    Returns conv_id, place (from 0), chunk and spans: a conversation is the chunks in
    the order of place, and spans are the parts of a chunk under the loss mask. Null
    roles and texts count as empty, null turns come first, rows without a conv_id are
    one conversation, repeated rows stay. One conversation is one stream through one
    task, which holds a turn at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render, held, size = compiled(template, {"guard": guard}), [], 0
        for conv, found in _conversations(batches):
            for place, (chunk, spans) in enumerate(turns_of(render(found))):
                held.append((conv, place, chunk, [{"start": a, "end": b} for a, b in spans]))
                size += len(chunk)
                if size > 4_000_000:
                    yield _chunks(held)
                    held, size = [], 0
        if held:
            yield _chunks(held)

    return _ordered(messages).mapInArrow(run, "conv_id bigint, place bigint, chunk string, spans array<struct<start:bigint,end:bigint>>")


def _chunks(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["conv_id", "place", "chunk", "spans"])


def conversation_digests(messages: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """One row for each conversation with what can be read back from its formatted text."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render, held = compiled(template, {"guard": guard}), []
        for conv, found in _conversations(batches):
            held.append((conv, *digest(turns_of(render(found)))))
            if len(held) == 5_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)

    return _ordered(messages).mapInArrow(
        run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )


def hostile(spark: SparkSession) -> DataFrame:
    """Conversation -7: texts that look like the template's own control strings."""
    text = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
