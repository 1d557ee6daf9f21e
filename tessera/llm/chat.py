"""Chat formatting: budgeted windows of whole turns, with the system turn, a little history and a loss mask.

A window is the system turn, the last turns of the window before (both without loss) and as many new turns as the budget
holds: the last end that a binary search in the prefix sums of the turns' tokens finds under it. An assistant's turn has
loss in the window in which it's new. Tokens are those of the unigram tokenizer.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._store import rows_of
from tessera.llm.tokens import Counter, load

#: Tokens of a window, with three for the marks of each turn.
BUDGET = 1024
#: Budgets of turns that are gathered before they're cut into windows.
AHEAD = 8
#: Turns of the window before that are repeated, if half the budget holds them.
HISTORY = 2
_MARKS = 3
#: Fixed marks of the template: a turn is OPEN role MIDDLE text CLOSE.
OPEN, MIDDLE, CLOSE = "<s>[INST ", "]", "</s>\n"
#: Fixed escapes: with these no mark can occur inside a role or a text.
ESCAPES = (("\\", "\\\\"), ("<", "\\l"), ("[", "\\b"), ("]", "\\e"))


def escape(text: str) -> str:
    for raw, safe in ESCAPES:
        text = text.replace(raw, safe)
    return text


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    back = {safe[1]: raw for raw, safe in ESCAPES}
    out, at = [], 0
    while (next_at := text.find("\\", at)) >= 0:
        out += [text[at:next_at], back[text[next_at + 1]]]
        at = next_at + 2
    return "".join(out) + text[at:]


class _Writer:
    """The windows of one conversation; holds AHEAD budgets of turns and one more turn at most."""

    def __init__(self, budget: int, history: int, count: Callable[[str], int]) -> None:
        self.budget, self.history, self.count = budget, history, count
        self.system: tuple | None = None
        self.repeated: list[tuple] = []
        self.waiting: list[tuple] = []
        self.sums = [0]  # prefix sums of the waiting turns' tokens
        self.seen = self.number = 0

    def again(self) -> list[tuple]:
        """What the next window repeats. A system turn of over half the budget is in the first window alone."""
        return ([self.system] if self.system and self.number else []) + self.repeated

    def add(self, role: str, text: str) -> Iterator[tuple]:
        """Takes a turn; gives the windows that are sure once it's there."""
        turn = (role, text, self.count(text) + _MARKS)
        if not self.waiting and not self.number and role == "system" and turn[2] <= self.budget // 2:
            self.system = turn
        self.waiting.append(turn)
        self.sums.append(self.sums[-1] + turn[2])
        if self.sums[-1] > AHEAD * self.budget:
            yield from self.cut(self.budget)

    def cut(self, left: int) -> Iterator[tuple]:
        """Windows, until `left` tokens or fewer wait. A turn over budget is a window's only new turn."""
        at = 0
        while at < len(self.waiting) and self.sums[-1] - self.sums[at] > left:
            room = self.budget - sum(t[2] for t in self.again())
            to = max(at + 1, bisect_right(self.sums, self.sums[at] + room, at) - 1)
            yield self.close(self.waiting[at:to])
            at = to
        self.waiting = self.waiting[at:]
        self.sums = [x - self.sums[at] for x in self.sums[at:]]

    def close(self, turns: list[tuple]) -> tuple:
        """window, turn_from, n_turns, n_repeated, text, loss: spans of the texts with loss."""
        again = self.again()
        text, at, loss = [], 0, []
        for k, (role, said, _) in enumerate([*again, *turns]):
            head, body = OPEN + escape(role) + MIDDLE, escape(said)
            if k >= len(again) and role == "assistant":
                loss.append({"from": at + len(head), "to": at + len(head) + len(body)})
            text.append(head + body + CLOSE)
            at += len(text[-1])
        out = (self.number, self.seen, len(again) + len(turns), len(again), "".join(text), loss)
        last = [t for t in turns[-self.history :] if t is not self.system] if self.history else []
        while last and sum(t[2] for t in last) + (self.system[2] if self.system else 0) > self.budget // 2:
            last = last[1:]
        self.repeated = last
        self.seen += len(turns)
        self.number += 1
        return out


WINDOWS = "window long, turn_from long, n_turns long, n_repeated long, text string, loss array<struct<from: long, to: long>>"
_NAMES = ("window", "turn_from", "n_turns", "n_repeated", "text", "loss")
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))]


def format_chats(chats: DataFrame, *, vocabulary: list[tuple[str, float]] | None = None, budget: int = BUDGET, history: int = HISTORY, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The windows of all conversations in order: conv_id, window, turn_from (the first new turn), n_turns, n_repeated (the
    first turns without loss that an earlier window has), text, and loss, the spans of text (characters) under the loss.

    Rows go by conversation to a partition each and stream through it sorted by turn (null first), role and text, so a
    conversation of any length holds some windows in memory. Null roles and texts are empty; null is a conversation too;
    repeated rows are turns of their own; other columns aren't read. conv_col can't be named as a column of the windows.
    """
    if conv_col.lower() in _NAMES:
        raise ValueError(f"{conv_col} is also a column of the windows")
    shared = chats.sparkSession.sparkContext.broadcast(Counter(load() if vocabulary is None else vocabulary))
    rows = chats.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("said"))
    rows = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "said")
    kind = rows.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, current, out, held, conv_type = None, None, [], 0, None

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], conv_type), *(pa.array([x[1][k] for x in out], t) for k, t in enumerate(_KINDS))], ["conv", "window", "turn_from", "n_turns", "n_repeated", "text", "loss"])

        for batch in batches:
            conv_type = rows_of(batch, "conv").type
            for conv, role, said in zip(*(rows_of(batch, c).to_pylist() for c in ("conv", "role", "said")), strict=True):
                if writer is None or conv != current:
                    if writer:
                        out += [(current, x) for x in writer.cut(0)]
                    writer, current = _Writer(budget, history, shared.value.count), conv
                for done in writer.add(role, said):
                    out.append((conv, done))
                    held += len(done[4])
                if held > 4 << 20 or len(out) > 10_000:
                    yield batch_of()
                    out, held = [], 0
        if writer:
            out += [(current, x) for x in writer.cut(0)]
            yield batch_of()

    return rows.mapInArrow(run, f"conv {kind}, {WINDOWS}").withColumnRenamed("conv", conv_col)


def parse(text: str, loss: list[dict]) -> Iterator[tuple[str, str, bool]]:
    """The turns of a window: role, text, and whether the loss mask covers the text."""
    covered = {(x["from"], x["to"]) for x in loss}
    at = 0
    while at < len(text):
        if not text.startswith(OPEN, at):
            raise ValueError("a window without the mark of a turn")
        middle = text.index(MIDDLE, at)
        end = text.index(CLOSE, middle)
        yield unescape(text[at + len(OPEN) : middle]), unescape(text[middle + 1 : end]), (middle + 1, end) in covered
        at = end + len(CLOSE)


def read_chats(windows: DataFrame, *, conv_col: str = "conv_id") -> DataFrame:
    """Reads the windows of format_chats back, stored and dealt in whatever order: for each conversation n_turns, turns_sha256
    (over role, newline, text, newline of each turn), loss_chars and loss_sha256 (of the texts under the loss mask, joined)
    and formatted_chars (of all windows). Windows go by conversation to a partition each and stream through it in order, so
    that digests go on from window to window; no conversation is held."""
    windows = windows.repartition(conv_col).sortWithinPartitions(conv_col, "window")
    kind = windows.schema[conv_col].dataType.simpleString()
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current, out, conv_type = None, None, [], None

        def close() -> None:
            out.append((current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def batch_of() -> pa.RecordBatch:
            kinds = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], [conv_col, *names])

        for batch in batches:
            conv_type = rows_of(batch, conv_col).type
            columns = (rows_of(batch, c).to_pylist() for c in (conv_col, "n_repeated", "text", "loss"))
            for conv, repeated, text, loss in zip(*columns, strict=True):
                if state is None or conv != current:
                    if state:
                        close()
                    state, current = [0, hashlib.sha256(), 0, hashlib.sha256(), 0], conv
                for k, (role, said, masked) in enumerate(parse(text, loss)):
                    if k >= repeated:
                        state[0] += 1
                        state[1].update(f"{role}\n{said}\n".encode())
                    if masked:
                        state[2] += len(said)
                        state[3].update(said.encode())
                state[4] += len(text)
            if len(out) > 5000:
                yield batch_of()
                out = []
        if state:
            close()
            yield batch_of()

    return windows.mapInArrow(run, f"{conv_col} {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
