"""Chat formatting: conversations rendered by a compiled template, with generation markers, and read back.

Turns are brought together by one shuffle on the conversation and sorted by turn, and then stream through the
template: a task holds one turn at a time, so a conversation with a third of all rows needs no more memory than
others. The result is a table of pieces in order; ``read_back`` follows it in the same tasks, without a shuffle.

Texts cannot forge the template's control strings: ``escape`` doubles each backslash and breaks each control string
with a backslash after its first character; ``unescape`` undoes exactly that.

Defined cases: null text and null role count as empty; turns with equal numbers are ordered by role, then text;
null turns come first; rows with a null conversation form one conversation; repeated rows are turns of their own; an
empty table gives no conversation. Other columns of the input are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieve.llm.common import lean, ship
from sieve.llm.template import compile_template

# Control strings that a text must not contain unbroken.
CONTROL = (
    "<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[GEN]", "[/GEN]", "<<SYS>>", "<</SYS>>",
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>",
)
TEMPLATE = (
    "{% for m in messages %}<s>[ROLE]{{ m.role | escape }}[/ROLE]"
    "{% if m.role == 'assistant' %}[GEN]{% generation %}{{ m.text | escape }}{% endgeneration %}[/GEN]"
    "{% else %}[INST]{{ m.text | escape }}[/INST]{% endif %}</s>\n{% endfor %}"
)
_control = re.compile("|".join(map(re.escape, CONTROL)))
_turn = re.compile(r"\n?<s>\[ROLE\](.*?)\[/ROLE\](?:\[GEN\](.*?)\[/GEN\]|\[INST\](.*?)\[/INST\])\Z", re.S)
END = "</s>"


def escape(text: str) -> str:
    if "\\" in text:
        text = text.replace("\\", "\\\\")
    if "<" in text or "[" in text:
        text = _control.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text) if "\\" in text else text


class Reader:
    """Reads a formatted conversation piece by piece: its turns, and the text under the loss mask."""

    def __init__(self) -> None:
        self.turns, self.chars, self.loss_chars = 0, 0, 0
        self.all_turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self._pending: list[str] = []
        self._masked: list[str] = []

    def feed(self, piece: str, generated: bool) -> None:
        """A piece holds whole control strings, as the template's constant text does."""
        self.chars += len(piece)
        if generated:
            self._masked.append(piece)
        elif self._masked:
            self._flush()
        self._pending.append(piece)
        if END in piece:
            *turns, rest = "".join(self._pending).split(END)
            for turn in turns:
                m = _turn.match(turn)
                if not m:
                    raise ValueError(f"not a turn: {turn[:80]!r}")
                role, text = unescape(m[1]), unescape(m[2] if m[2] is not None else m[3])
                self.all_turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                self.turns += 1
            self._pending = [rest]

    def _flush(self) -> None:
        text = unescape("".join(self._masked))
        self.loss_chars += len(text)
        self.loss.update(text.encode("utf-8", "surrogatepass"))
        self._masked = []

    def close(self) -> dict:
        self._flush()
        if "".join(self._pending).strip("\n"):
            raise ValueError("the conversation ends inside a turn")
        return {
            "n_turns": self.turns,
            "turns_sha256": self.all_turns.hexdigest(),
            "loss_chars": self.loss_chars,
            "loss_sha256": self.loss.hexdigest(),
            "formatted_chars": self.chars,
        }


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            yield from zip(*(c.to_pylist() for c in batch.slice(start, 1024).columns))


def _groups(rows: Iterator[tuple]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Like itertools.groupby on the first column, nulls being equal."""
    import itertools

    return itertools.groupby(rows, key=lambda r: r[0])


def _render(template: str, kind: pa.DataType, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, {"escape": escape})
        out: list[list] = [[], [], [], []]
        size = 0
        for conv, turns in _groups(_rows(batches)):
            messages = ({"role": role, "text": text} for _, role, text in turns)
            for seq, (piece, generated) in enumerate(render({"messages": messages})):
                for column, value in zip(out, (conv, seq, piece, generated)):
                    column.append(value)
                size += len(piece) + 64
                if size >= chunk:
                    yield _batch(out, kind)
                    out, size = [[], [], [], []], 0
        if out[0]:
            yield _batch(out, kind)

    return lean(run)


def _batch(out: list[list], kind: pa.DataType) -> pa.RecordBatch:
    types = (kind, pa.int64(), pa.string(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["conv_id", "seq", "piece", "generated"])


def format_pieces(conversations: DataFrame, template: str = TEMPLATE, chunk: int = 4 << 20) -> DataFrame:
    """conv_id, seq, piece, generated: the formatted conversations, each one's pieces together and in order."""
    ship(conversations.sparkSession)
    base = conversations.select(
        "conv_id",
        F.col("turn").alias("__turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    # The hash of the key keeps conversations together; sorting by it first makes a conversation one run of rows.
    laid = base.repartition("conv_id").sortWithinPartitions("conv_id", "__turn", "role", "text").drop("__turn")
    kind = laid.schema["conv_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    return laid.mapInArrow(
        _render(template, to_arrow_type(kind), chunk), f"conv_id {kind.simpleString()}, seq long, piece string, generated boolean"
    )


def _read(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for conv, pieces in _groups(_rows(batches)):
            reader = Reader()
            for _, _, piece, generated in pieces:
                reader.feed(piece, generated)
            found.append({"conv_id": conv} | reader.close())
            if len(found) >= 4096:
                yield pa.RecordBatch.from_pylist(found, _digests(kind))
                found = []
        yield pa.RecordBatch.from_pylist(found, _digests(kind))

    return lean(run)


def _digests(kind: pa.DataType) -> pa.Schema:
    s, n = pa.string(), pa.int64()
    return pa.schema(
        [("conv_id", kind), ("n_turns", n), ("turns_sha256", s), ("loss_chars", n), ("loss_sha256", s), ("formatted_chars", n)]
    )


def read_back(pieces: DataFrame) -> DataFrame:
    """What ``format_pieces`` wrote with the standard template, read again: a row of counts and digests a conversation."""
    kind = pieces.schema["conv_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    return pieces.mapInArrow(
        _read(to_arrow_type(kind)),
        f"conv_id {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, formatted, loss_spans (start, end in code points): whole conversations, where each fits in memory."""
    pieces = format_pieces(conversations, template)
    kind = pieces.schema["conv_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("conv_id", to_arrow_type(kind)), ("formatted", pa.string()), ("loss_spans", spans)])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, own in _groups(_rows(batches)):
            text, at, marked = [], 0, []
            for _, _, piece, generated in own:
                if generated and marked and marked[-1]["end"] == at:
                    marked[-1]["end"] = at + len(piece)
                elif generated:
                    marked.append({"start": at, "end": at + len(piece)})
                text.append(piece)
                at += len(piece)
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "formatted": "".join(text), "loss_spans": marked}], schema)

    return pieces.mapInArrow(lean(whole), f"conv_id {kind.simpleString()}, formatted string, loss_spans array<struct<start:long,end:long>>")
