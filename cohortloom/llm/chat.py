"""Chat formatting at token level.

Each turn's text is escaped and encoded by itself; reserved ids, which no text can produce,
are spliced around it. A conversation's ids are the concatenation of its turns, and the loss
mask (the text of assistant turns) follows from prefix sums of the pieces' lengths.

Template, per turn: open id of the role, text ids, close id. A role without its own id is
opened by ROLE, its encoded name, and TEXT. As text, the reserved ids read as the strings
of MARKS, so formatted conversations are plain strings too. Control strings inside a text
are broken by a backslash after their first character and backslashes are doubled, which
`unescape` undoes exactly.

Defined results: null text is empty, a null role is the role "". Turns are ordered by turn
(null first), then role, then text; repeated rows are repeated turns. Rows whose conv_id
is null form one conversation. Encoding happens before the shuffle; a conversation is then
read as a stream in turn order, so only one batch of a long one is in memory.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stored import partitions
from .vocab import default_path

# Fixed values of the template.
MARKS = {"system": "<<SYS>>", "user": "<s>[INST]", "assistant": "[/INST]", "tool": "<<TOOL>>"}
ROLE, TEXT, CLOSE = "<<ROLE>>", "<<TEXT>>", "</s>"
CONTROL = ("<<SYS>>", "<<TOOL>>", "<<ROLE>>", "<<TEXT>>", "</s>", "<s>", "[/INST]", "[INST]")
LOSS_ROLE = "assistant"

_SPELLED = re.compile("|".join(map(re.escape, CONTROL)))
# The spliced strings in the order of their ids, which follow the vocabulary's own.
SPLICED = (*MARKS.values(), ROLE, TEXT, CLOSE)


def escape(text: str) -> str:
    return _SPELLED.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


@lru_cache(maxsize=2)
def encoding(path: str | None):
    """Byte-level vocabulary; any text is encoded, and decoded without loss."""
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path or default_path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def reserved(path: str | None) -> dict[str, int]:
    """Ids of the spliced strings: after the vocabulary and its one free id."""
    first = encoding(path).n_vocab + 1
    return {mark: first + i for i, mark in enumerate(SPLICED)}


def _turn_ids(role: str, text: str, path: str | None) -> tuple[np.ndarray, int, int]:
    """(ids, where the text's ids begin, where they end)."""
    ids, model = reserved(path), encoding(path)
    if role in MARKS:
        head = [ids[MARKS[role]]]
    else:
        head = [ids[ROLE], *model.encode_ordinary(escape(role)), ids[TEXT]]
    body = model.encode_ordinary(escape(text))
    return np.array([*head, *body, ids[CLOSE]], "<u4"), len(head), len(head) + len(body)


_TURNS = "conv_id long, turn long, role string, text string, ids binary, text_from int, text_to int"
_BATCH = 512


def encode_turns(conversations: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per turn, encoded by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, _BATCH):
                batch = whole.slice(low, _BATCH)
                made = [_turn_ids(r, t, vocabulary) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
                more = [pa.array([x.tobytes() for x, _, _ in made], pa.binary())]
                more += [pa.array([m[i] for m in made], pa.int32()) for i in (1, 2)]
                yield pa.record_batch([*batch.columns, *more], [f.split()[0] for f in _TURNS.split(", ")])

    blank = F.lit("")
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), blank).alias("role"), F.coalesce(F.col("text").cast("string"), blank).alias("text"),
    ).mapInArrow(run, _TURNS)


def _in_order(turns: DataFrame) -> DataFrame:
    n = partitions(turns.sparkSession)
    return turns.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "ids", "text_from", "text_to")


FORMATTED = "conv_id long, part long, ids binary, loss_mask binary, first_token long"
# A conversation is written in parts of about so many tokens.
PART_TOKENS = 1 << 16


def format_chats(conversations: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) and loss mask (a byte per id) of each
    conversation. One longer than PART_TOKENS comes in numbered parts of whole turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, part, first, held, ids, spans = None, 0, 0, 0, [], []

        def flush() -> pa.RecordBatch:
            tokens = np.concatenate(ids)
            # Mask by prefix sums: +1 where a loss-bearing text begins, -1 where it ends.
            edge = np.zeros(len(tokens) + 1, np.int8)
            base = np.concatenate([[0], np.cumsum([len(x) for x in ids])[:-1]])
            for begin, (low, high) in zip(base, spans, strict=True):
                edge[begin + low] += 1
                edge[begin + high] -= 1
            mask = np.cumsum(edge[:-1]).astype(np.uint8)
            row = [pa.array([v], t) for v, t in ((key, pa.int64()), (part, pa.int64()), (tokens.tobytes(), pa.binary()), (mask.tobytes(), pa.binary()), (first, pa.int64()))]
            return pa.record_batch(row, [f.split()[0] for f in FORMATTED.split(", ")])

        opener = reserved(vocabulary)[MARKS[LOSS_ROLE]]
        for whole in batches:
            for low in range(0, whole.num_rows, _BATCH):
                for conv, raw, begin, end in zip(*(c.to_pylist() for c in whole.slice(low, _BATCH).columns), strict=True):
                    if ids and (conv != key or held >= PART_TOKENS):
                        yield flush()
                        part, first = (0, 0) if conv != key else (part + 1, first + held)
                        held, ids, spans = 0, [], []
                    key = conv
                    tokens = np.frombuffer(raw, "<u4")
                    held += len(tokens)
                    ids.append(tokens)
                    spans.append((begin, end) if tokens[0] == opener else (0, 0))
        if ids:
            yield flush()

    return _in_order(encode_turns(conversations, vocabulary)).mapInArrow(run, FORMATTED)


class _Reader:
    """Reads one conversation back from its ids and mask, part by part."""

    def __init__(self, conv_id: int | None, vocabulary: str | None):
        self.conv_id, self.model, ids = conv_id, encoding(vocabulary), reserved(vocabulary)
        self.spelled = {i: mark for mark, i in ids.items()}
        self.first = min(self.spelled)
        self.role_of = {ids[mark]: role for role, mark in MARKS.items()}
        self.role, self.text, self.close = ids[ROLE], ids[TEXT], ids[CLOSE]
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def read(self, ids: np.ndarray, mask: np.ndarray) -> None:
        marks = np.flatnonzero(ids >= self.first).tolist()
        role = ""
        for at, after in zip(marks, [*marks[1:], len(ids)], strict=True):
            mark = int(ids[at])
            raw = self.model.decode(ids[at + 1 : after].tolist())
            self.formatted_chars += len(self.spelled[mark]) + len(raw)
            if mark == self.close:
                continue
            plain = unescape(raw)
            if mark == self.role:
                role = plain
                continue
            if mark != self.text:
                role = self.role_of[mark]
            self.n_turns += 1
            for piece in (role, "\n", plain, "\n"):
                self.turns.update(piece.encode())
            borne = ids[at + 1 : after][mask[at + 1 : after] > 0]
            learned = unescape(self.model.decode(borne.tolist()))
            self.loss_chars += len(learned)
            self.loss.update(learned.encode())

    def row(self) -> tuple:
        return (self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars)


DIGESTS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("n_turns", T.LongType()),
        T.StructField("turns_sha256", T.StringType()),
        T.StructField("loss_chars", T.LongType()),
        T.StructField("loss_sha256", T.StringType()),
        T.StructField("formatted_chars", T.LongType()),
    ]
)


def read_back(formatted: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Digests of turns and loss text of each conversation, decoded from `format_chats`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, rows = None, []
        for whole in batches:
            for low in range(0, whole.num_rows, _BATCH):
                for conv, part, ids, mask in zip(*(c.to_pylist() for c in whole.slice(low, _BATCH).columns), strict=True):
                    if part == 0:
                        rows += [reader.row()] if reader else []
                        reader = _Reader(conv, vocabulary)
                    reader.read(np.frombuffer(ids, "<u4"), np.frombuffer(mask, np.uint8))
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(DIGESTS.fieldNames(), r, strict=True)) for r in rows], _arrow())
                    rows = []
        if reader:
            yield pa.RecordBatch.from_pylist([dict(zip(DIGESTS.fieldNames(), reader.row(), strict=True))], _arrow())

    def _arrow() -> pa.Schema:
        return pa.schema([(f.name, pa.int64() if f.dataType == T.LongType() else pa.string()) for f in DIGESTS.fields])

    # The parts of a conversation leave format_chats together and in order.
    return formatted.select("conv_id", "part", "ids", "loss_mask").mapInArrow(run, DIGESTS)
