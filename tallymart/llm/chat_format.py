"""Chat formatting by token-level assembly.

Each turn becomes ``<|im_start|>`` role ``<|im_sep|>`` text ``<|im_end|>``. Role and text are encoded separately and the
marks are spliced in as reserved ids above the vocabulary, so that no text can produce a mark. Positions and the loss
mask come from prefix sums over the segment lengths; the mask covers the texts of one role. In the formatted string
a control string inside a role or text gets a backslash after ``<|``; a control string that already
has backslashes gets one more, which makes the escape reversible.

A conversation may be of any length: turns are sorted by Spark and read as a stream, each is a row of the result with its place in
the conversation, and digests are carried on from turn to turn. No task ever holds more than some hundred turns.

Edge cases: null roles and texts are empty; turns are ordered by turn, role, text (nulls first), and repeated turns are
all kept. A null conv_id is a conversation of its own. No conversations give no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tallymart.llm.common import slices
from tallymart.llm.tokens import byte_bpe

MARKS = ["<|im_start|>", "<|im_sep|>", "<|im_end|>"]
#: Strings that are escaped inside texts.
CONTROL = ["im_start", "im_sep", "im_end", "endoftext"]
LOSS_ROLE = "assistant"
_FOUND = re.compile(r"<\|(\\*(?:" + "|".join(CONTROL) + r")\|>)")
_ESCAPED = re.compile(r"<\|\\(\\*(?:" + "|".join(CONTROL) + r")\|>)")


def escape(text: str) -> str:
    return _FOUND.sub(r"<|\\\1", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<|\1", text)


def formatted_turn(role: str, text: str) -> str:
    return f"{MARKS[0]}{escape(role)}{MARKS[1]}{escape(text)}{MARKS[2]}"


def assemble(turns: list[tuple[str, str]], path: str, loss_role: str = LOSS_ROLE) -> tuple[str, np.ndarray, np.ndarray]:
    """Formatted string, ids and loss mask of (role, text) turns."""
    bpe = byte_bpe(path)
    start, sep, end = range(bpe.size, bpe.size + 3)
    segments, learned = [], []
    for role, text in turns:
        segments += [bpe.encode(escape(role)), bpe.encode(escape(text))]
        learned += [False, role == loss_role]
    sizes = np.array([len(s) // 4 for s in segments], np.int64)
    # A mark before each segment, and one more after each text.
    marks = 1 + np.arange(len(segments)) + np.arange(len(segments)) // 2
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]]) + marks if segments else marks
    total = int(sizes.sum()) + 3 * len(turns)
    ids = np.empty(total, np.uint32)
    delta = np.zeros(total + 1, np.int64)
    content = np.ones(total, bool)
    ids[begin[0::2] - 1], ids[begin[1::2] - 1], ids[begin[1::2] + sizes[1::2]] = start, sep, end
    for at in (begin[0::2] - 1, begin[1::2] - 1, begin[1::2] + sizes[1::2]):
        content[at] = False
    ids[content] = np.frombuffer(b"".join(segments), np.uint32)
    loss = np.array(learned, bool)
    np.add.at(delta, begin[loss], 1)
    np.add.at(delta, (begin + sizes)[loss], -1)
    formatted = "".join(formatted_turn(r, t) for r, t in turns)
    return formatted, ids, np.cumsum(delta)[:-1] > 0


def read_back(ids: np.ndarray, mask: np.ndarray, path: str) -> tuple[list[tuple[str, str]], list[str]]:
    """The turns that ids hold, and the texts under the mask, both unescaped."""
    bpe = byte_bpe(path)

    def text(a: int, b: int) -> str:
        return unescape(bpe.decode(ids[a:b].tolist()))

    start, sep, end = (np.flatnonzero(ids == bpe.size + k) for k in range(3))
    turns = [(text(a + 1, b), text(b + 1, c)) for a, b, c in zip(start, sep, end, strict=True)]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return turns, [text(a, b) for a, b in zip(edge[0::2], edge[1::2])]


def format_chats(conversations: DataFrame, path: str, loss_role: str = LOSS_ROLE) -> DataFrame:
    """conv_id, nth (turn, from 0), begin (tokens of the conversation before it), formatted, ids (array of int), loss_mask (array of
    boolean); a row for each turn.

    All turns of a conversation come one after another in one partition.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()
    plain = [F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]
    order = ["conv_id", "turn", "role", "text"]
    turns = conversations.select("conv_id", "turn", *plain).repartition("conv_id").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nth, tokens = object(), 0, 0
        for batch in slices(batches):
            said = list(zip(batch.column("role").to_pylist(), batch.column("text").to_pylist()))
            _, ids, mask = assemble(said, path, loss_role)
            cuts = np.append(np.flatnonzero(ids == byte_bpe(path).size), len(ids))
            places = []
            for conv, size in zip(batch.column("conv_id").to_pylist(), np.diff(cuts).tolist()):
                if conv != now:
                    now, nth, tokens = conv, 0, 0
                places.append((nth, tokens))
                nth, tokens = nth + 1, tokens + size
            offsets = pa.array(cuts, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv_id"),
                    *(pa.array([x[k] for x in places], pa.int64()) for k in (0, 1)),
                    pa.array([formatted_turn(r, t) for r, t in said], pa.string()),
                    pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(mask)),
                ],
                ["conv_id", "nth", "begin", "formatted", "ids", "loss_mask"],
            )

    return turns.mapInArrow(
        run, f"conv_id {kind}, nth long, begin long, formatted string, ids array<int>, loss_mask array<boolean>"
    )


class _Digest:
    """What is known of a conversation after some of its turns."""

    def __init__(self):
        self.turns = self.loss_chars = self.chars = 0
        self.whole, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, role: str, text: str, learned: str, formatted: str) -> None:
        self.turns += 1
        self.whole.update(f"{role}\n{text}\n".encode())
        self.loss.update(learned.encode())
        self.loss_chars += len(learned)
        self.chars += len(formatted)

    def row(self) -> tuple:
        return self.turns, self.whole.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def digests(formatted: DataFrame, path: str) -> DataFrame:
    """The rows of :func:`format_chats`, as it returned them, read back from the ids and the mask: a row of digests for each conversation."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(done: list[tuple], conv_type: pa.DataType) -> pa.RecordBatch:
            kinds = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)

        now, digest, conv_type = None, None, None
        for batch in slices(batches):
            conv_type, done = batch.schema.field("conv_id").type, []
            ids = batch.column("ids").flatten().to_numpy().astype(np.uint32)
            mask = batch.column("loss_mask").flatten().to_numpy(zero_copy_only=False)
            turns, learned = read_back(ids, mask, path)
            # A turn has one text under the mask, or none.
            sums, ends = np.concatenate([[0], np.cumsum(mask)]), np.cumsum(pc.list_value_length(batch.column("ids")).to_numpy())
            counts, texts = np.diff(sums[ends], prepend=0).tolist(), iter(learned)
            for conv, nth, (role, text), masked, form in zip(
                batch.column("conv_id").to_pylist(), batch.column("nth").to_pylist(), turns, counts, batch.column("formatted").to_pylist()
            ):
                if nth == 0:
                    if digest is not None:
                        done.append((now, *digest.row()))
                    now, digest = conv, _Digest()
                digest.add(role, text, next(texts) if masked else "", form)
            if done:
                yield made(done, conv_type)
        if digest is not None:
            yield made([(now, *digest.row())], conv_type)

    return formatted.mapInArrow(
        run,
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
