"""Conversations as training text: a compiled template renders the turns of each conversation and marks what a model shall learn.

Turns are sorted over ranges of (conv_id, turn, ..), so that no conversation, however long, is one task's; each task cuts what it has into
pieces of bounded size.  A conversation that ends up in several pieces gets their places from a scan over the pieces, which are few, and
each piece is rendered on its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, saved
from .template import ChatTemplate

#: Control strings: user and assistant turns have their own, other roles are named.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ANSWER]", "[/ANSWER]", "[ROLE]", "[TEXT]", "[/ROLE]")
TEMPLATE = """
{%- for m in messages -%}
  {%- if loop.first %}<s>{% endif -%}
  {%- if m.role == 'user' -%} [INST] {{- m.text | escape -}} [/INST]
  {%- elif m.role == 'assistant' -%} [ANSWER] {%- generation %}{{ m.text | escape }}{% endgeneration -%} [/ANSWER]
  {%- else -%} [ROLE] {{- m.role | escape -}} [TEXT] {{- m.text | escape -}} [/ROLE]
  {%- endif -%}
  {%- if loop.last %}</s>{% endif -%}
{%- endfor -%}
"""
_FREE = r"((?:[^\\<\[]|\\[\\<\[])*+)"
_TURN = re.compile(rf"(?:<s>)?(?:\[INST\]{_FREE}\[/INST\]|\[ANSWER\]{_FREE}\[/ANSWER\]|\[ROLE\]{_FREE}\[TEXT\]{_FREE}\[/ROLE\])(?:</s>)?")

#: A piece ends with the turn that takes it to this many code points or turns.
PIECE_CHARS, PIECE_TURNS = 1 << 18, 4096
_PIECE = "conv_id long, part int, seq long, open boolean, n_turns long, roles array<string>, texts array<string>"
_FORMATTED = "conv_id long, piece long, first_turn long, n_turns long, last boolean, text string, generated array<struct<start:long,end:long>>"


def template() -> ChatTemplate:
    return ChatTemplate(TEMPLATE, CONTROLS)


def _pieces(most_chars: int, most_turns: int):
    """Cuts sorted turns (conv_id, role, text) into pieces.  ``open`` are those that may not be a whole conversation: they have siblings, or
    stand at an end of the partition."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        conv, roles, texts, size, opened, begun, held = None, [], [], 0, True, False, 0
        ready: list[tuple] = []

        def put(is_open: bool) -> None:
            nonlocal roles, texts, size, seq
            ready.append((conv, part, seq, is_open, len(texts), roles, texts))
            roles, texts, size, seq = [], [], 0, seq + 1

        def batch() -> pa.RecordBatch:
            types = [pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string())]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ready), types)], ["conv_id", "part", "seq", "open", "n_turns", "roles", "texts"])
            ready.clear()
            return out

        for block in batches:
            for at in range(0, block.num_rows, 256):
                for name, role, text in zip(*(c.to_pylist() for c in block.slice(at, 256).columns)):
                    if begun and name != conv:
                        if texts:
                            put(opened)
                        opened = False
                    elif size >= most_chars or len(texts) >= most_turns:
                        opened = True
                        put(True)
                    conv, begun = name, True
                    roles.append(role)
                    texts.append(text)
                    size += len(text)
                    held += len(text) + 32
                if held >= 4 * most_chars and ready:
                    held = 0
                    yield batch()
        if texts:
            put(True)
        if ready:
            yield batch()

    return scan


def _render(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    compiled = template()
    for batch in batches:
        for at in range(0, batch.num_rows, 16):
            rows = batch.slice(at, 16)
            done = []
            for first, total, roles, texts in zip(*(rows.column(rows.schema.get_field_index(c)).to_pylist() for c in ("first_turn", "total", "roles", "texts"))):
                text, spans = compiled.render([{"role": r, "text": t} for r, t in zip(roles, texts)], first, total)
                done.append((first + len(texts) == total, text, [{"start": a, "end": b} for a, b in spans]))
            last, text, spans = zip(*done)
            spans = pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            columns = [*(rows.column(rows.schema.get_field_index(c)) for c in ("conv_id", "piece", "first_turn", "n_turns")), pa.array(last), pa.array(text, pa.string()), spans]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "piece", "first_turn", "n_turns", "last", "text", "generated"])


def formatted(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations of one piece, and the pieces of the others, rendered from ``turns`` (conv_id, turn, role, text, any other columns).

    Both have (conv_id, piece, first_turn, n_turns, last, text, generated): ``generated`` are the spans of ``text``, in code points, that a model
    shall learn.  Turns are ordered by turn (null last), then role, then text; a repeated row is a turn of its own; null texts and roles are
    empty ones; turns without a conv_id make up a conversation without one.  No turn gives no row.
    """
    columns = [F.col("conv_id").cast("long").alias("conv_id"), "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text"))]
    order = [F.col("conv_id").asc(), F.col("turn").asc_nulls_last(), F.col("role").asc(), F.col("text").asc()]
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = turns.select(*columns).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    pieces = saved(map_arrow(ranged.select("conv_id", "role", "text"), _pieces(PIECE_CHARS, PIECE_TURNS), _PIECE))
    whole = pieces.where("not open").select("conv_id", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("first_turn"), "n_turns", F.col("n_turns").alias("total"), "roles", "texts")
    some = Window.partitionBy("conv_id")
    along = some.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, 0)
    places = pieces.where("open").select("conv_id", "part", "seq", "n_turns")
    places = places.select("part", "seq", (F.sum("n_turns").over(along) - F.col("n_turns")).alias("first_turn"), (F.count("*").over(along) - 1).alias("piece"), F.sum("n_turns").over(some).alias("total"))
    others = pieces.where("open").join(places, ["part", "seq"]).select("conv_id", "piece", "first_turn", "n_turns", "total", "roles", "texts")
    return map_arrow(whole, _render, _FORMATTED), map_arrow(others, _render, _FORMATTED)


class _Reading:
    """What is read back from the pieces of one conversation, in order."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, text: str, spans: list[dict]) -> None:
        end = 0
        while end < len(text):
            if not (turn := _TURN.match(text, end)):
                raise ValueError("no turn where one should begin")
            end = turn.end()
            user, assistant, role, other = turn.groups()
            who, said = ("user", user) if user is not None else ("assistant", assistant) if assistant is not None else (role, other)
            self.turns.update(f"{ChatTemplate.unescape(who)}\n{ChatTemplate.unescape(said)}\n".encode("utf-8", "surrogatepass"))
            self.n_turns += 1
        for span in spans:
            learned = ChatTemplate.unescape(text[span["start"] : span["end"]])
            self.loss.update(learned.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(learned)
        self.chars += len(text)

    def row(self, conv_id: int | None) -> tuple:
        return conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def digest(whole: DataFrame, pieces: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from both parts of :func:`formatted`.

    A digest takes the pieces of a conversation one after the other; a piece at a time is in memory.
    """

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reading, conv, done = None, None, []
        for block in batches:
            for at in range(0, block.num_rows, 16):
                for name, piece, text, spans in zip(*(c.to_pylist() for c in block.slice(at, 16).columns)):
                    if piece == 0:
                        if reading:
                            done.append(reading.row(conv))
                        reading, conv = _Reading(), name
                    reading.add(text, spans)
            if len(done) >= 1000:
                yield batch(done)
                done = []
        if reading:
            yield batch([*done, reading.row(conv)])

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    columns = ["conv_id", "piece", "text", "generated"]
    in_order = pieces.select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return map_arrow(whole.select(*columns), scan, schema).unionByName(map_arrow(in_order, scan, schema))
