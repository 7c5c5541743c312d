"""Restoring tokens in event streams whose tokens are split between events.

The work is two steps.  Re-cutting needs a stream's order and a little state, but
no vault: text that may be the beginning of a token waits for the event that
goes on with it, so afterwards every token stands whole in one event, between
marks.  ``FIELDS`` says for each kind of event where its texts stand, which of
them go on in one another, and what event tells a rest; one walker reads it.
Looking values up needs the vault but no state: ``put_values`` is a join over the
marked tokens, so no worker holds the vault, however large it is, and a running
stream joins each of its batches with the vault as it is then.
"""

from __future__ import annotations

import json
import re
import string
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from operator import or_
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from .. import fixed
from ..operators import restore, spans
from ..session import dropped, scratch, stored

#: Marks around a token to look up, and the escape that keeps such characters of the stream itself apart.
OPEN, CLOSE, ESCAPE = spans.OPEN, spans.CLOSE, "\ue002"
_SAVED = {ESCAPE: ESCAPE + "2", OPEN: ESCAPE + "0", CLOSE: ESCAPE + "1"}
_RUN = string.ascii_uppercase + string.digits + "_"
_TOKEN = re.compile(rf"{fixed.PRIVATE_TOKEN_BARE}|(?:EMAIL|PHONE|IBAN|CR|TAX_ID|GOV_ID|PERSON|ORG|ADDRESS)_[A-F0-9]{{16}}")


class Field(NamedTuple):
    """A text of an event: its path ("*" is every list item), and by the items on the way its channel and the event of a rest.

    ``rest`` gives that event with None in the text's place, and the path there; without it a rest is told by the stream itself.
    """

    path: tuple[str, ...]
    channel: Callable[[dict, Sequence[tuple[int, dict]]], list]
    rest: Callable[[dict, Sequence[tuple[int, dict]]], tuple[dict, list]] | None = None
    where: tuple[tuple[str, ...], str] | None = None


def whole(value, default: int) -> int:
    """A whole JSON number; anything else (a bool, a string, a fraction) is the default."""
    return value if type(value) is int else default


def _block(kind: str, name: str) -> Field:
    at = lambda e: whole(e.get("index"), 0)
    return Field(("delta", name), lambda e, _: ["block", at(e)], lambda e, _: ({"type": "content_block_delta", "index": at(e), "delta": {"type": kind, name: None}}, ["delta", name]), (("delta", "type"), kind))


def _choice(delta: dict, path: list, by: Sequence[tuple[int, dict]]) -> tuple[dict, list]:
    return {"object": "chat.completion.chunk", "choices": [{"index": whole(by[0][1].get("index"), 0), "delta": delta, "finish_reason": None}]}, ["choices", 0, "delta", *path]


_SAME = ("item_id", "output_index", "content_index", "summary_index")
FIELDS: dict[str, list[Field]] = {
    "content_block_delta": [_block(kind, name) for kind, name in fixed.DELTA_FIELD.items()],
    **{kind: [Field(("delta",), lambda e, _: ["response", e["type"], *map(e.get, _SAME)])] for kind in fixed.RESPONSE_DELTAS},
    "choices": [
        Field(("choices", "*", "delta", "content"), lambda e, by: ["chat", whole(by[0][1].get("index"), 0)], lambda e, by: _choice({"content": None}, ["content"], by)),
        Field(
            ("choices", "*", "delta", "tool_calls", "*", "function", "arguments"),
            lambda e, by: ["call", whole(by[0][1].get("index"), 0), by[1][0]],
            lambda e, by: _choice({"tool_calls": [{"index": whole(by[1][1].get("index"), by[1][0]), "function": {"arguments": None}}]}, ["tool_calls", 0, "function", "arguments"], by),
        ),
    ],
}


def kind_of(event: dict) -> str:
    """What names an event's fields: its type, ``whole`` where all its texts are complete, or ``choices``."""
    kind = event.get("type")
    if kind in FIELDS and kind != "choices":
        return kind
    if isinstance(kind, str) and kind.startswith("response."):
        return "whole" if kind.endswith(".done") or kind == "response.completed" else ""
    return "choices"


def _at(node, path) -> list[tuple[dict, str, tuple]]:
    """(holder, key, items on the way) of every text at a path."""
    *way, key = path
    found = [(node, ())]
    for step in way:
        if not found:
            return found
        if step == "*":
            found = [(item, (*by, (i, item))) for n, by in found if isinstance(n, list) for i, item in enumerate(n) if isinstance(item, dict)]
        else:
            found = [(n[step], by) for n, by in found if isinstance(n, dict) and step in n]
    return [(n, key, by) for n, by in found if isinstance(n, dict) and isinstance(n.get(key), str)]


#: What a JSON object begins with.
_BEGINS = ("{", " ", "\t", "\n", "\r")
#: An event from and as JSON; both are made once, not for each event.
_read = json.JSONDecoder().raw_decode
_written = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode


def _loaded(body: str):
    """A JSON text with space around it; None for anything else."""
    try:
        return json.loads(body)
    except ValueError:
        return None


def _each(node, change):
    """A JSON value with every string (keys stay) changed."""
    if isinstance(node, dict):
        return {k: _each(v, change) for k, v in node.items()}
    return [_each(v, change) for v in node] if isinstance(node, list) else change(node) if isinstance(node, str) else node


def _saved(text: str) -> str:
    return text if text.isascii() or not any(c in text for c in _SAVED) else "".join(_SAVED.get(c, c) for c in text)


def marked(text: str) -> str:
    return _TOKEN.sub(rf"{OPEN}\g<0>{CLOSE}", text) if "_" in text else text


def hold(text: str) -> int:
    """How much of a text may leave: a last run that may be a token in the making stays, unless it is too long for one."""
    n = len(text) - len(text.rstrip(_RUN))
    return len(text) if n > fixed.CARRY_LIMIT else len(text) - n


#: Lines without a text (pings, counts, ends), which are written the same in every stream, and how they are written.
_silent: dict[str, str] = {}


def _remembered(line: str, out: str) -> str:
    if len(line) <= 256:
        if len(_silent) >= 1024:
            _silent.clear()
        _silent[line] = out
    return out


class Recutter:
    """One stream: what waits in each channel, and the event that would tell it."""

    def __init__(self, state: str | None = None):
        self.waits: dict[str, list] = json.loads(state) if state else {}
        self.met = 0  # texts so far

    def state(self) -> str:
        return json.dumps(self.waits)

    def event(self, event: dict) -> dict:
        kind = kind_of(event)
        if kind == "whole":
            self.met += 1
            return _each(event, marked)
        for field in FIELDS.get(kind, ()):
            if field.where and not any(h[k] == field.where[1] for h, k, _ in _at(event, field.where[0])):
                continue
            for holder, key, by in _at(event, field.path):
                self.met += 1
                channel = json.dumps(field.channel(event, by))
                told = self.waits.get(channel)
                if told is None:
                    told = self.waits[channel] = ["", field.rest(event, by) if field.rest else None]
                text = told[0] + holder[key]
                n = hold(text)
                told[0], holder[key] = text[n:], marked(text[:n])
        return event

    def line(self, line: str) -> str:
        if (out := _silent.get(line)) is not None:
            return out
        head = "data: " if line.startswith("data: ") else "data:" if line.startswith("data:") else ""
        body = line[len(head) :]
        value = None
        if head and body[:1] in _BEGINS:
            try:
                value, end = _read(body)
            except ValueError:
                end = -1
            if end != len(body):
                value = _loaded(body)
        if not isinstance(value, dict):
            return _remembered(line, _saved(line))
        if _saved(body) != body or ("\\" in body and "\\ue00" in body.lower()):
            value = _each(value, _saved)
        met = self.met
        out = head + _written(self.event(value))
        return out if self.met != met else _remembered(line, out)

    def block(self, block: str) -> str:
        """An event block with its data lines rewritten; lines end at LF alone."""
        return "\n".join(map(self.line, block.split("\n")))

    def rests(self) -> list[str]:
        """What still waits, as events of the stream's own kind; nothing the second time."""
        out = []
        for told in self.waits.values():
            text, told[0] = told[0], ""
            if text and told[1]:
                event, path = json.loads(json.dumps(told[1]))
                holder = event
                for k in path[:-1]:
                    holder = holder[k]
                holder[path[-1]] = marked(text)
                out.append("data: " + _written(event))
        return out

    def blocks(self, block: str) -> list[str]:
        """A block's output: before a last event comes what still waits."""
        return [*(self.rests() if ends(block) else []), self.block(block)]


#: What a last event holds, unless it is written with escapes.
_ENDS = ("[DONE]", *fixed.STREAM_ENDS)
_MAY_END = re.compile("|".join(map(re.escape, ("\\", *_ENDS))))


def ends(block: str) -> bool:
    """Whether a block ends its stream."""
    if not _MAY_END.search(block):
        return False
    for line in block.split("\n"):
        body = line[5:].lstrip() if line.startswith("data:") else ""
        try:
            value = json.loads(body) if body and body != "[DONE]" else None
        except ValueError:
            continue
        if body == "[DONE]" or (isinstance(value, dict) and value.get("type") in fixed.STREAM_ENDS):
            return True
    return False


def is_last(block: Column) -> Column:
    """``ends`` as a Column."""
    bodies = F.transform(F.filter(F.split(block, "\n", -1), lambda s: s.startswith("data:")), lambda s: F.regexp_replace(s, r"(?U)\Adata:\s*", ""))
    last = F.exists(bodies, lambda b: (b == "[DONE]") | F.coalesce(F.get_json_object(b, "$.type").isin(*fixed.STREAM_ENDS), F.lit(False)))
    may = reduce(or_, (block.contains(end) for end in ("\\", *_ENDS)))
    return F.when(~may, F.lit(False)).otherwise(last)


def event_blocks(streams: DataFrame, raw_col: str = "raw") -> DataFrame:
    """(stream_id, seq, block) of whole streams: blocks end at a blank line; a rest without one is a block."""
    parts = F.split(raw_col, "\n\n", -1)
    return streams.select("stream_id", F.posexplode(parts).alias("seq", "block")).where("block <> ''").select("stream_id", F.col("seq").cast("long").alias("seq"), "block")


_OUT = "stream_id string, seq long, part int, block string"
#: A character that JSON may write otherwise, or a mark.
_UNLIKE_JSON = r"[^ !#-\[\]-~]"


def recut_batch(events: DataFrame) -> DataFrame:
    """All events (stream_id, seq, block) of bounded streams, tokens whole and marked; what is left at a stream's end follows its last event."""

    def items(column: pa.Array) -> list:  # without a Python object of Arrow's for each item
        return column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, stream, seq, part = None, None, None, 0
        rest = lambda: [(stream, seq, part + 1 + i, b) for i, b in enumerate(cutter.rests())] if cutter else []
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.string(), pa.int64(), pa.int32(), pa.string()), strict=True)], names=["stream_id", "seq", "part", "block"])
        for batch in batches:
            rows = []
            for s, n, block in zip(*map(items, batch.columns), strict=True):
                if cutter is None or s != stream:
                    rows += rest()
                    cutter, stream = Recutter(), s
                cut = cutter.blocks(block)
                rows += [(s, n, i, b) for i, b in enumerate(cut)]
                seq, part = n, len(cut) - 1
            yield table(rows)
        yield table(rest())

    # streams one after the other in one task: a call for each stream takes longer than its events;
    # the number is given, as partitions joined by their size would not be as many for each core
    ordered = events.select(F.col("stream_id").cast("string"), F.col("seq").cast("long"), "block").repartition(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), "stream_id").sortWithinPartitions("stream_id", F.asc_nulls_last("seq"))
    return ordered.mapInArrow(run, _OUT)


def recut_stream(events: DataFrame, idle: str = "10 minutes") -> DataFrame:
    """The same for a streaming table.

    Blocks that arrive early wait until the gap before them is filled.  A stream
    that stays idle gives all it has, the waiting blocks in their order and then
    the rests, and is forgotten; blocks that come later still are a new stream,
    which gives them in order when it is idle in turn.
    """
    import pandas as pd  # here, as bounded streams' workers start sooner without it
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        due, early, last, waits = state.get if state.exists else (0, "{}", 0, None)
        cutter, waiting, rows = Recutter(waits), {int(k): v for k, v in json.loads(early).items()}, []
        if state.hasTimedOut:
            for seq in sorted(waiting):
                rows += [(key[0], seq, i, b) for i, b in enumerate(cutter.blocks(waiting[seq]))]
                last = seq
            rows += [(key[0], last, 1000 + i, b) for i, b in enumerate(cutter.rests())]
            state.remove()
        else:
            for pdf in frames:
                waiting |= {int(s): b for s, b in zip(pdf.seq, pdf.block, strict=True) if s >= due}
            while due in waiting:
                rows += [(key[0], due, i, b) for i, b in enumerate(cutter.blocks(waiting.pop(due)))]
                last, due = due, due + 1
            state.update((due, json.dumps(waiting), last, cutter.state()))
            state.setTimeoutDuration(wait)
        yield pd.DataFrame(rows, columns=["stream_id", "seq", "part", "block"])

    return events.select("stream_id", "seq", "block").groupBy("stream_id").applyInPandasWithState(run, _OUT, "due long, early string, last long, waits string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def put_values(blocks: DataFrame, vault: DataFrame, fuzzy: bool = True) -> DataFrame:
    """The marked tokens of re-cut blocks replaced by their values, escaped as JSON; others become plain again. Only blocks with marks are joined."""
    holds = F.coalesce(F.col("block").contains(OPEN), F.lit(False))
    # a split at one character needs no pattern
    between = F.split(F.replace("block", F.lit(CLOSE), F.lit(OPEN)), OPEN, -1)
    asked = blocks.where(holds).withColumn("__asked", F.filter(between, lambda p, i: i % 2 == 1))
    out = restore.look_up(asked, F.array_join("__asked", " "), vault, fuzzy, tokens=F.array_distinct("__asked"))

    def value(v):
        saved = v
        for c, put in _SAVED.items():
            saved = F.replace(saved, F.lit(c), F.lit(put))
        escaped = F.regexp_replace(F.to_json(F.struct(saved.alias("v"))), r'(?s)\A\{"v":"|"\}\z', "")
        return F.when(v.rlike(_UNLIKE_JSON), escaped).otherwise(v)

    known = lambda p: F.get(F.transform(F.filter("__found", lambda f: f["token"] == p), lambda f: value(f["value"])), F.lit(0))
    put = out.withColumn("block", F.array_join(F.transform(between, lambda p, i: F.when(i % 2 == 1, F.coalesce(known(p), p)).otherwise(p)), "")).drop("__asked", "__found")
    text = F.col("block")
    for saved, c in (("1", CLOSE), ("0", OPEN), ("2", ESCAPE)):
        text = F.replace(text, F.lit(ESCAPE + saved), F.lit(c))
    return put.unionByName(blocks.where(~holds)).withColumn("block", F.when(F.col("block").contains(ESCAPE), text).otherwise(F.col("block")))


def restore_batch(events: DataFrame, vault: DataFrame, fuzzy: bool = True) -> DataFrame:
    """All events of bounded streams with their tokens restored. The re-cut events are stored: the look-up reads them more than once."""
    return put_values(stored(recut_batch(events), "recut"), vault, fuzzy)


def restore_stream(events: DataFrame, vault: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], idle: str = "10 minutes", fuzzy: bool = True) -> DataStreamWriter:
    """A writer for a streaming table of events: each batch is joined with the vault that ``vault()`` reads then, and given to ``write``."""
    return recut_stream(events, idle).writeStream.outputMode("append").foreachBatch(_each_batch(lambda batch, found: put_values(batch, found, fuzzy), vault, write))


def _each_batch(change: Callable[[DataFrame, DataFrame], DataFrame], vault: Callable[[], DataFrame], write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """What a running stream does with a batch; the tables that it stores on the way go with it."""

    def run(batch: DataFrame, n: int) -> None:
        found = vault()
        try:
            with scratch() as made:
                out = change(stored(batch, "batch"), found)
            write(out, n)
        finally:
            for table in made:
                dropped(table)

    return run


def redact_stream(events: DataFrame, text_col: str, secret: str, **options) -> DataFrame:
    """Anonymises a stream's texts; stateless, as tokens depend on values alone."""
    from ..operators.tokens import anonymize

    return anonymize(events, text_col, secret, **options)


def follow(messages: DataFrame, vault: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], text_col: str = "text") -> DataStreamWriter:
    """A writer for a streaming table of messages, restored with the vault as it is at each batch."""
    return messages.writeStream.outputMode("append").foreachBatch(_each_batch(lambda batch, found: restore.restore(batch, found, text_col), vault, write))
