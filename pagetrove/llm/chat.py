"""Conversations formatted by a compiled template, with the spans a model is trained on.

Turns are brought together by conversation and sorted; each task then renders its conversations one
after the other as a stream, see ``templates``. What comes out is in parts of about PART characters, cut
between segments of the template, so a conversation of any length passes through a task turn by
turn and a short one is one row. Reading back parses the parts, in their order, into turns and
loss texts, equally a stream. The order of turns and a digest over them make one conversation one
sequence: the longest one bounds the time of its task, not its memory.

A null text or role is empty. Turns are ordered by turn, then role and text, nulls first;
repeated rows are turns of their own. Rows with a null id are one conversation. Empty tables give
empty results. Other columns are not read.
"""

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame

from .shipping import map_arrow
from .templates import Segment, Template

PART = 1 << 16
OUT_ROWS = 256

# The strings that structure a formatted conversation, and the template that writes them.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[TEXT]")
TURNS = """
{%- for m in messages -%}
{%- if m.role == 'user' -%}
  {{ '<s>' ~ '[INST] ' }}{{ m.text | guard }}{{ ' [/INST]' }}
{%- elif m.role == 'assistant' -%}
  {% generation %}{{ m.text | guard }}{% endgeneration %}</s>
{%- else -%}
  <s>[ROLE]{{ m.role | guard }}[TEXT]{{ m.text | guard }}[/ROLE]
{%- endif -%}
{%- endfor -%}
"""

_TURN = re.compile(
    r"(?s)<s>\[INST\] (?P<user>.*?) \[/INST\]|<s>\[ROLE\](?P<role>.*?)\[TEXT\](?P<other>.*?)\[/ROLE\]"
    r"|(?!<s>)(?P<assistant>.*?)</s>")

FORMATTED = "part int, start long, text string, spans array<struct<start: long, stop: long>>"
DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64())])


def _parts(segments: Iterator[Segment]) -> Iterator[tuple[int, int, str, list[tuple[int, int]]]]:
    """(part, start, text, spans) rows; spans count characters from the start of the conversation."""
    part, start, size, texts, spans = 0, 0, 0, [], []
    for text, marked in segments:
        if marked and text:
            at = start + size
            if spans and spans[-1][1] == at:
                at = spans.pop()[0]
            spans.append((at, start + size + len(text)))
        texts.append(text)
        size += len(text)
        if size >= PART:
            yield part, start, "".join(texts), spans
            part, start, size, texts, spans = part + 1, start + size, 0, [], []
    if size or not part:
        yield part, start, "".join(texts), spans


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[column.to_pylist() for column in batch.columns])


def _batches(rows: Iterator[tuple], kinds: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of bounded numbers of rows and characters."""
    held, size = [], 0

    def made() -> pa.RecordBatch:
        columns = zip(*held) if held else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds)], names=[n for n, _ in kinds])

    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, str))
        if len(held) == OUT_ROWS or size > 64 * PART:
            yield made()
            held, size = [], 0
    yield made()


def format_chats(
    turns: DataFrame, source: str = TURNS, control: tuple[str, ...] = CONTROL, keys: tuple[str, ...] = ("conv_id",)
) -> DataFrame:
    """``keys``, part, start, text, spans: the formatted text of each conversation in parts.

    ``spans`` are the parts of the text under the generation mark. Rows come sorted by keys and part
    within a partition, a conversation in one. The keys are integers or strings.
    """
    Template(source, control)  # faults show here, not in a task
    width = len(keys)
    kept = turns.select(*keys, "turn", "role", "text").repartition(*keys)
    ordered = kept.sortWithinPartitions(*keys, "turn", "role", "text")
    schema = "".join(f"`{k}` {kept.schema[k].dataType.simpleString()}, " for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(source, control)

        def parts() -> Iterator[tuple]:
            for key, rows in groupby(_rows(batches), key=itemgetter(slice(width))):
                messages = ({"role": r[width + 1] or "", "text": r[width + 2] or ""} for r in rows)
                for row in _parts(template.render(messages)):
                    yield (*key, *row)

        kinds = [("part", pa.int32()), ("start", pa.int64()), ("text", pa.string()), ("spans", pa.list_(_SPAN))]
        yield from _batches(parts(), [*own, *kinds])

    own = [(k, _arrow(kept.schema[k].dataType.simpleString())) for k in keys]
    return map_arrow(ordered, run, schema + FORMATTED)


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}.get(kind, pa.string())


class Reader:
    """Takes formatted text piece by piece and gives the turns that are complete."""

    def __init__(self, control: tuple[str, ...] = CONTROL):
        self.unmask, self.rest = Template("", control).guard.unmask, ""

    def feed(self, text: str) -> Iterator[tuple[str, str]]:
        self.rest += text
        at = 0
        while match := _TURN.match(self.rest, at):
            at = match.end()
            kind = match.lastgroup
            role = match["role"] if kind == "other" else kind
            yield self.unmask(role), self.unmask(match[kind])
        self.rest = self.rest[at:]


def read_back(formatted: DataFrame, keys: tuple[str, ...] = ("conv_id",), in_order: bool = False) -> DataFrame:
    """Digest of each conversation, from the text and spans that ``format_chats`` gave by TURNS.

    ``in_order`` says that the rows are as they came from it; else they are brought in order first.
    """
    kept = formatted.select(*keys, "part", "start", "text", "spans")
    if not in_order:
        kept = kept.repartition(*keys).sortWithinPartitions(*keys, "part")
    width = len(keys)
    schema = "".join(f"`{k}` {kept.schema[k].dataType.simpleString()}, " for k in keys)
    own = [(k, _arrow(kept.schema[k].dataType.simpleString())) for k in keys]

    def digest(rows: Iterator[tuple]) -> tuple:
        reader, turns, loss = Reader(), hashlib.sha256(), hashlib.sha256()
        n_turns = loss_chars = chars = 0
        for row in rows:
            _, start, text, spans = row[width:]
            chars += len(text)
            for role, said in reader.feed(text):
                n_turns += 1
                turns.update(f"{role}\n{said}\n".encode())
            for span in spans:
                learnt = reader.unmask(text[span["start"] - start : span["stop"] - start])
                loss_chars += len(learnt)
                loss.update(learnt.encode())
        if reader.rest:
            raise ValueError(f"not a formatted conversation: {reader.rest[:80]!r}")
        return n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                 ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
        found = ((*key, *digest(rows)) for key, rows in groupby(_rows(batches), key=itemgetter(slice(width))))
        yield from _batches(found, [*own, *kinds])

    return map_arrow(kept, run, schema + DIGEST)
