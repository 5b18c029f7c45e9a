"""Chat formatting of typed content parts.

A turn's content is a list of parts: text, image, audio or document. A visitor walks
them in order and flattens them into one body in which every attachment is an ordered
placeholder; it records the attachment's reference and how many tokens the placeholder
stands for. The template marks turns with control strings; wherever a control string
occurs inside a role, a text or a reference it is broken by an escape character, so
the output can be read back exactly.

Every turn becomes one piece by itself, without a shuffle; a conversation's formatted
text is its pieces in order.
"""

from __future__ import annotations

import hashlib
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ESCAPE = "␛"
TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>\n"
#: Control strings of this and of common other templates, and the escape itself.
_CONTROL = re.compile(rf"{ESCAPE}|</?s>|\[/?INST\]|<</?SYS>>|<\|")
_ESCAPED = re.compile(rf"{ESCAPE}({ESCAPE}?)")
_SLOT = re.compile(r"<\|(image|audio|document):(\d+)\|>")
_PIECE = re.compile(rf"{re.escape(TURN)}(.*?){re.escape(SAYS)}(.*?){re.escape(END)}", re.DOTALL)

PARTS = "array<struct<kind: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>>"
ATTACHMENTS = "array<struct<kind: string, slot: int, ref: string, tokens: bigint>>"
PIECES = (
    "conv_id bigint, turn bigint, role string, piece string, loss_start int, loss_end int, "
    f"attachments {ATTACHMENTS}, text_tokens bigint, tokens bigint"
)

#: Tokens per attachment: image patches of 14 x 14 pixels, 25 frames a second, 600 a page.
PATCH, FRAMES, PAGE = 14, 25, 600


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: ESCAPE * 2 if m[0] == ESCAPE else m[0][0] + ESCAPE + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Flattener:
    """Visits the parts of one turn. A part of unknown kind is an error, not a silent loss."""

    def __init__(self) -> None:
        self.body: list[str] = []
        self.attachments: list[dict] = []
        self.text_tokens = 0

    def visit(self, part: dict) -> None:
        method = getattr(self, f"visit_{part['kind'] or 'text'}", None)
        if method is None:
            raise ValueError(f"unknown content part: {part['kind']}")
        method(part)

    def visit_text(self, part: dict) -> None:
        text = part["text"] or ""
        self.text_tokens += len(text.split())
        self.body.append(escape(text))

    def visit_image(self, part: dict) -> None:
        across, down = (math.ceil((part[side] or 0) / PATCH) for side in ("width", "height"))
        self._attach("image", part, max(1, across * down))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, max(1, math.ceil((part["seconds"] or 0.0) * FRAMES)))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(1, (part["pages"] or 0) * PAGE))

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        slot = len(self.attachments)
        self.body.append(f"<|{kind}:{slot}|>")
        self.attachments.append({"kind": kind, "slot": slot, "ref": part["ref"], "tokens": tokens})


def format_turn(role: str | None, parts: list[dict]) -> tuple[str, int, int, Flattener]:
    """The piece, and where its body starts and ends in it."""
    flat = Flattener()
    for part in parts:
        flat.visit(part)
    head, body = f"{TURN}{escape(role or '')}{SAYS}", "".join(flat.body)
    return f"{head}{body}{END}", len(head), len(head) + len(body), flat


def read_turn(piece: str) -> tuple[str, str]:
    """Role and text of a piece; placeholders stay where they are."""
    found = _PIECE.fullmatch(piece)
    if not found:
        raise ValueError("not a formatted turn")
    return unescape(found[1]), unescape(found[2])


def slots_of(piece: str) -> list[tuple[str, int]]:
    return [(kind, int(slot)) for kind, slot in _SLOT.findall(piece)]


def _format(batches):
    import pyarrow as pa

    kinds = pa.list_(
        pa.struct([("kind", pa.string()), ("slot", pa.int32()), ("ref", pa.string()), ("tokens", pa.int64())])
    )
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            roles, contents = part.column("role").to_pylist(), part.column("parts").to_pylist()
            made = [format_turn(role, parts or []) for role, parts in zip(roles, contents)]
            learnt = [role == "assistant" for role in roles]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("conv_id"),
                    part.column("turn"),
                    part.column("role"),
                    pa.array([m[0] for m in made], pa.string()),
                    pa.array([m[1] if on else None for m, on in zip(made, learnt)], pa.int32()),
                    pa.array([m[2] if on else None for m, on in zip(made, learnt)], pa.int32()),
                    pa.array([m[3].attachments for m in made], kinds),
                    pa.array([m[3].text_tokens for m in made], pa.int64()),
                    pa.array([m[3].text_tokens + sum(a["tokens"] for a in m[3].attachments) for m in made], pa.int64()),
                ],
                names=["conv_id", "turn", "role", "piece", "loss_start", "loss_end", "attachments", "text_tokens", "tokens"],
            )


def text_parts(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, parts`` of turns that have only a text. Null text is empty."""
    empty = [F.lit(None).cast(kind).alias(name) for name, kind in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    part = F.struct(F.lit("text").alias("kind"), F.coalesce("text", F.lit("")).alias("text"), *empty)
    return turns.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def format_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, parts`` to one formatted piece per turn.

    ``loss_start`` and ``loss_end`` bound the body (code points of the piece) of assistant
    turns and are null for others; ``tokens`` counts words and expanded attachments.
    Null roles are empty, null parts no content. Extra columns are ignored, repeated rows
    give repeated pieces, an empty table gives an empty result.
    """
    return turns.select("conv_id", "turn", "role", F.col("parts").cast(PARTS).alias("parts")).mapInArrow(_format, PIECES)


def join_pieces(pieces: DataFrame) -> DataFrame:
    """``conv_id, formatted``: whole conversations, for those that fit one value."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "piece")))
    return pieces.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda p: p["piece"]), "").alias("formatted"))


class _Reader:
    """Reads one conversation back, piece by piece, in constant memory."""

    def __init__(self) -> None:
        self.turns = self.loss_chars = self.chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: str, start: int | None, end: int | None) -> None:
        role, text = read_turn(piece)
        self.turns += 1
        self.chars += len(piece)
        self.all.update(f"{role}\n{text}\n".encode())
        if start is not None:
            learnt = unescape(piece[start:end])
            self.loss_chars += len(learnt)
            self.loss.update(learnt.encode())

    def row(self, conv) -> tuple:
        return conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


_DIGESTS = [
    ("conv_id", "bigint"),
    ("n_turns", "bigint"),
    ("turns_sha256", "string"),
    ("loss_chars", "bigint"),
    ("loss_sha256", "string"),
    ("formatted_chars", "bigint"),
]


def _read_back(batches):
    import pyarrow as pa

    def told(rows):
        kinds = {"bigint": pa.int64(), "string": pa.string()}
        columns = [pa.array(values, kinds[kind]) for values, (_, kind) in zip(zip(*rows), _DIGESTS)]
        return pa.RecordBatch.from_arrays(columns, names=[name for name, _ in _DIGESTS])

    conv, reader = None, None
    for batch in batches:
        done = []
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512).to_pydict()
            for c, piece, start, end in zip(part["conv_id"], part["piece"], part["loss_start"], part["loss_end"]):
                if reader is None or c != conv:
                    if reader is not None:
                        done.append(reader.row(conv))
                    conv, reader = c, _Reader()
                reader.add(piece, start, end)
        if done:
            yield told(done)
    if reader is not None:
        yield told([reader.row(conv)])


def digests(pieces: DataFrame) -> DataFrame:
    """One row per conversation, read back from its pieces in the order of turns.

    Turns with equal numbers are ordered by their piece. The rows of a conversation
    stream through one task; none is held whole.
    """
    ordered = (
        pieces.select("conv_id", "turn", "piece", "loss_start", "loss_end")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "piece")
    )
    return ordered.mapInArrow(_read_back, ", ".join(f"{n} {k}" for n, k in _DIGESTS))


def op9_chat_formatting(spark, folder: str) -> DataFrame:
    turns = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return digests(format_turns(text_parts(turns.unionByName(extra))))


OP9_SQL = """
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(t))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(coalesce(role, '')) + 24 + length(replace(text, '␛', '␛␛'))
    + len(regexp_extract_all(text, '</?s>|\\[/?INST\\]|<</?SYS>>|<\\|'))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""
