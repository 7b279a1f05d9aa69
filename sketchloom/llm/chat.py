"""Chat formatting in budgeted windows.

A conversation's turns, in order, become one or more windows of formatted text. Prefix
sums of the turns' tokens choose spans of whole turns that fit ``budget``; every window
but the first repeats the leading system turn and up to ``history`` tokens of the turns
just before it; repeated turns are outside the loss mask, so each assistant text is
learnt once. The budget comes first: where the system turn doesn't fit beside the next turn, that window goes without it.
A turn longer than the budget has a window of its own: nothing is cut.

The template is ``<turn INDEX ROLE>\\nTEXT\\n</turn>\\n``. Inside roles and texts ``\\`` becomes
``\\\\``, ``<`` becomes ``\\l`` and ``>`` becomes ``\\g``, in roles a line feed ``\\n``; so no text can hold a
marker, and :func:`unescape` gives the text back.

Rows are dealt by conversation, sorted on disk by Spark and read as a stream: a task
keeps one window and the history, never a whole conversation. (Where a turn's window
starts depends on all turns before it, so one conversation is one sequence.)

Defined results: a null text or role is empty; null conversation ids form one
conversation; turns are ordered by turn (null first), then role, then text, so ties and
repeated rows have one order and all count; very long texts stay whole; an empty table
gives no windows; other columns are not used.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUDGET, HISTORY = 512, 128
#: Tokens that a turn's own markers count as.
MARKERS = 8

WINDOW = "conv_id long, window long, text string, first_turn long, last_turn long, n_tokens long, loss array<struct<start:long,end:long>>"
_ARROW = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("text", pa.string()), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("n_tokens", pa.int64()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
_PARTS = {"\\": "\\\\", "<": "\\l", ">": "\\g"}
_BACK = {"\\": "\\", "l": "<", "g": ">", "n": "\n"}
_TURN = re.compile(r"<turn (\d+) ([^>\n]*)>\n([^<]*)\n</turn>\n")


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\l").replace(">", "\\g")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], text, flags=re.S) if "\\" in text else text


def words(text: str) -> int:
    return len(text.split())


class Windows:
    """Turns of one conversation in; closed windows out."""

    def __init__(self, conv: int | None, budget: int, history: int, count: Callable[[str], int]):
        self.conv, self.budget, self.limit, self.count = conv, budget, history, count
        self.system: tuple[str, int] | None = None
        self.recent: deque[tuple[str, int, int]] = deque()  # rendered, prefix sum before, after
        self.total = self.window = self.turn = 0
        self._open()

    def _open(self) -> None:
        self.parts: list[str] = []
        self.chars = 0
        self.loss: list[dict] = []
        self.first = self.turn
        self.used = 0
        self.fresh = 0

    def _put(self, rendered: str, tokens: int) -> None:
        self.parts.append(rendered)
        self.chars += len(rendered)
        self.used += tokens

    def add(self, role: str, text: str) -> Iterator[dict]:
        head = f"<turn {self.turn} {escape(role).replace(chr(10), chr(92) + 'n')}>\n"
        body = escape(text)
        rendered, tokens = f"{head}{body}\n</turn>\n", self.count(text) + MARKERS
        if self.fresh and self.used + tokens > self.budget:
            yield self.close()
            self._repeat(tokens)
        if role == "assistant":
            start = self.chars + len(head)
            self.loss.append({"start": start, "end": start + len(body)})
        self._put(rendered, tokens)
        self.fresh += 1
        if self.turn == 0 and role == "system":
            self.system = (rendered, tokens)
        else:
            self.recent.append((rendered, self.total, self.total + tokens))
        self.total += tokens
        self.turn += 1
        while self.recent and self.total - self.recent[0][1] > self.limit:  # what no later window can repeat
            self.recent.popleft()

    def _repeat(self, tokens: int) -> None:
        """Start a window with the system turn and as much history as fits beside the next turn."""
        self._open()
        if self.system and self.system[1] + tokens <= self.budget:
            self._put(*self.system)
        room = min(self.limit, self.budget - self.used - tokens)
        for rendered, before, after in self.recent:
            if self.total - before <= room:
                self._put(rendered, after - before)

    def close(self) -> dict:
        out = {"conv_id": self.conv, "window": self.window, "text": "".join(self.parts), "first_turn": self.first, "last_turn": self.turn - 1, "n_tokens": self.used, "loss": self.loss}
        self.window += 1
        return out


def _packed(rows: Iterator[dict], schema: pa.Schema, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row.get("text") or "") + 100
        if size >= chars:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, count: Callable[[str], int] = words) -> DataFrame:
    """One row for each window; ``loss`` holds code-point spans of ``text``, end exclusive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            at: Windows | None = None
            for batch in batches:
                for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    if at is None or conv != at.conv:
                        if at is not None:
                            yield at.close()
                        at = Windows(conv, budget, history, count)
                    yield from at.add(role, text)
            if at is not None:
                yield at.close()

        return _packed(rows(), _ARROW)

    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", empty("role"), empty("text"))
    turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return turns.select("conv_id", "role", "text").mapInArrow(run, WINDOW)


def parse(text: str) -> list[tuple[int, str, str]]:
    """The turns in a window's text: index, role and text, as they were before formatting."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((int(m[1]), unescape(m[2]), unescape(m[3])))
        at = m.end()
    return out


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the windows hold: all turns once, and all text under the loss mask.

    Reads a conversation's windows in order, as :func:`windows` gives them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            now: dict | None = None

            def done() -> dict:
                return now | {"turns_sha256": now["turns_sha256"].hexdigest(), "loss_sha256": now["loss_sha256"].hexdigest()}

            for batch in batches:
                for conv, window, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "window", "text", "loss")), strict=True):
                    if now is None or window == 0:
                        if now is not None:
                            yield done()
                        now = {"conv_id": conv, "n_turns": 0, "turns_sha256": hashlib.sha256(), "loss_chars": 0, "loss_sha256": hashlib.sha256(), "formatted_chars": 0, "n_windows": 0}
                    for index, role, said in parse(text):
                        if index >= now["n_turns"]:  # else a repeated one
                            now["n_turns"] += 1
                            now["turns_sha256"].update(f"{role}\n{said}\n".encode())
                    for span in loss:
                        learnt = unescape(text[span["start"] : span["end"]])
                        now["loss_chars"] += len(learnt)
                        now["loss_sha256"].update(learnt.encode())
                    now["formatted_chars"] += len(text)
                    now["n_windows"] += 1
            if now is not None:
                yield done()

        return _packed(rows(), _DIGEST)

    return formatted.mapInArrow(run, DIGEST)


def digest(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The contract's rows, over all conversations and one whose texts look like a template."""
    tricky = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(more)
    return read_back(windows(every))
