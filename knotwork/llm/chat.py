"""Chat formatting in budgeted windows, with loss on each assistant text once.

Turns stand between control strings, and any control string inside a role or text is
escaped so that it can be undone. Prefix sums of the turns' token counts, kept as turns
arrive, choose spans of whole turns: a window takes the system turn (if the conversation begins with one),
then as much of the history before the span as ``history`` tokens allow, then new
turns until the budget is used; a turn longer than the budget gets a window of its own
with no history. Assistant texts among the new turns are under the loss mask; what a
window repeats, and the system turn it retains, is masked out.

Conversations are read in order of (conv_id, turn) and written window by window, so a
very long conversation never stands in memory whole.

Defined results: a null text or role counts as empty; rows of one conversation with
the same turn are ordered by role, then text; a null turn comes first; rows with a
null conv_id form one conversation; an empty table gives no window.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .tokens import Encoder

START, END = "<|im_start|>", "<|im_end|>"
BUDGET, HISTORY = 1024, 256
_OPEN = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    """Puts a backslash more between "<" and "|", so that no control string is left."""
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def formatted(role: str, text: str) -> str:
    return f"{START}{escape_role(role)}\n{escape(text)}{END}\n"


def windows(turns, budget: int, history: int):
    """Windows of one conversation from an iterator of (role, text, size): lists of (role, text, is_new).

    Holds one window and the history before it."""
    system, past, new, used, any_before = None, [], [], 0, False

    def emit():
        return [*([(system[0], system[1], False)] if system and any_before else []), *((r, t, False) for r, t, _ in past), *((r, t, True) for r, t, _ in new)]

    for number, turn in enumerate(turns):
        if new and used + turn[2] > budget:
            yield emit()
            tail, total = [], 0
            body = [*past, *(new if any_before or system is None else new[1:])]
            for old in reversed(body):
                if total + old[2] > history:
                    break
                tail.insert(0, old)
                total += old[2]
            any_before, past, new = True, tail, []
            kept = system[2] if system else 0
            while past and kept + total + turn[2] > budget:
                total -= past.pop(0)[2]
            used = kept + total
        if number == 0 and turn[0] == "system":
            system = turn
        new.append(turn)
        used += turn[2]
    if new:
        yield emit()


_WINDOWS = "conv_id long, window long, text string, loss array<struct<start:long,end:long>>, n_repeated int"


def format_chats(turns: DataFrame, tokenizer: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows of ``turns(conv_id, turn, role, text)``: text, the spans under the loss, repeated turns."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = pa.schema(
        [("conv_id", pa.int64()), ("window", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("n_repeated", pa.int32())]
    )

    def run(it):
        encoder = Encoder(tokenizer)

        def flat():
            for batch in it:
                for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                    yield conv, (role, text, len(encoder.ids(formatted(role, text))))

        rows, waiting = flat(), []

        def conversation(conv):
            while waiting or not done:
                if not waiting:
                    if (row := next(rows, None)) is None:
                        done.append(1)
                        return
                    waiting.append(row)
                if waiting[0][0] != conv:
                    return
                yield waiting.pop()[1]

        done: list = []
        if (row := next(rows, None)) is not None:
            waiting.append(row)
        block: list = []
        while waiting:
            conv = waiting[0][0]
            for number, window in enumerate(windows(conversation(conv), budget, history)):
                text, loss, at = [], [], 0
                for role, body, is_new in window:
                    piece = formatted(role, body)
                    if is_new and role == "assistant":
                        head = at + len(START) + len(escape_role(role)) + 1
                        loss.append({"start": head, "end": head + len(escape(body))})
                    at += len(piece)
                    text.append(piece)
                block.append((conv, number, "".join(text), loss, sum(not n for _, _, n in window)))
                if len(block) >= 256:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, b)) for b in block], schema=schema)
                    block = []
        if block:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, b)) for b in block], schema=schema)

    return saved(ordered.mapInArrow(run, _WINDOWS))


def digests(chats: DataFrame) -> DataFrame:
    """Reads windows back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars.

    A digest follows a conversation from its first turn to its last, so its windows meet in one task,
    where they are read one after the other."""
    ordered = chats.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(it):
        state, out = None, []

        def close():
            conv, n, turns, chars, loss, size = state
            out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))

        for batch in it:
            for conv, window, text, loss, repeated in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "window", "text", "loss", "n_repeated"))):
                if window == 0:
                    if state:
                        close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for number, found in enumerate(_TURN.finditer(text)):
                    if number >= repeated:
                        state[1] += 1
                        state[2].update(f"{unescape_role(found[1])}\n{unescape(found[2])}\n".encode("utf-8", "surrogatepass"))
                for span in loss:
                    target = unescape(text[span["start"] : span["end"]])
                    state[3] += len(target)
                    state[4].update(target.encode("utf-8", "surrogatepass"))
                state[5] += len(text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=names)
                out.clear()
        if state:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names=names)

    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
