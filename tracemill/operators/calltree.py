"""Activations of traces of any length, and call depths over their tree.

A trace is cut into chunks of events. What a chunk does to the call stack below it is
reduced to the events that can matter to it: calls still open at its end, and events of
functions that no call in the chunk has opened. Reduced chunks are joined and reduced
again, ``FAN`` at a time, up to the whole trace; then the stack with which each chunk
begins comes down the same tree, and one pass over all chunks at once gives the
activations. A trace of n chunks takes 2 log(n) + 1 rounds, each written to the shared
folder, and no task holds more than a chunk, or the reduced events of ``FAN`` of them,
and a stack. A trace that runs in and out of functions which it never calls does not
reduce; its summaries are as long as its chunks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.dealt import dealt
from ..sources.shared import written
from .prefix import row_numbers

#: Events of a trace that one worker holds at a time; summaries that are joined in one step.
ACTIVATION_CHUNK = 100_000
FAN = 16
#: Events of a task of the last pass, which holds one stack at a time.
EVENTS_A_TASK = 200_000

_EVENT = "trace_id long, node long, seq long, func string, event string"
_OPEN = "trace_id long, node long, func string, call_seq long, parent_seq long, depth int, orphan boolean"
_DONE = "trace_id long, func string, call_seq long, parent_seq long, depth int, end_seq long, orphan boolean, closed boolean"


class Stack:
    """Open activations as [func, call_seq, parent_seq, depth, orphan]; finds the nearest one of a function at once."""

    def __init__(self, entries: Iterable[list] = ()) -> None:
        self.entries: list[list] = []
        self.places: dict[str, list[int]] = {}
        for e in entries:
            self._push(e)

    def _push(self, entry: list) -> None:
        self.places.setdefault(entry[0], []).append(len(self.entries))
        self.entries.append(entry)

    def _pop(self) -> list:
        entry = self.entries.pop()
        self.places[entry[0]].pop()
        return entry

    def take(self, seq: int, func: str, event: str) -> list[tuple[list, bool]]:
        """One event: a return closes the nearest activation of its function, any event all those above it, and one of
        a function that is not open begins an orphan. The closed activations, and whether by their own return."""
        places = self.places.get(func)
        closed = []
        if event == "call" or not places:
            top = self.entries[-1] if self.entries else None
            self._push([func, seq, top[1] if top else None, len(self.entries) + 1, event != "call"])
        else:
            while len(self.entries) - 1 > places[-1]:
                closed.append((self._pop(), False))
        if event == "return":
            closed.append((self._pop(), True))
        return closed


def reduced(events: Iterable[tuple[int, str, str]]) -> list[tuple[int, str, str]]:
    """Events (seq, func, event) that leave any stack as all of them do."""
    kept: list[tuple[int, str, str]] = []
    base = 0  # calls from here on are open for certain
    for seq, func, event in events:
        if event == "call":
            kept.append((seq, func, event))
            continue
        at = next((i for i in range(len(kept) - 1, base - 1, -1) if kept[i][1] == func), None)
        if at is not None:
            del kept[at + (event != "return") :]
        elif base and kept[base - 1][1] == func and kept[base - 1][2] != "return":
            del kept[base:]  # the function on top of what is not known
            if event == "return":
                kept[base - 1] = (kept[base - 1][0], func, event)
        else:
            kept.append((seq, func, "return" if event == "return" else "line"))
            base = len(kept)
    return kept


def _rows(pdf: pd.DataFrame) -> list[tuple[int, str, str]]:
    pdf = pdf.sort_values("seq")
    return list(zip(pdf["seq"].tolist(), pdf["func"].tolist(), pdf["event"].tolist()))


def _stack(pdf: pd.DataFrame) -> Stack:
    rows = pdf.sort_values("depth").astype(object)
    rows = rows.where(rows.notna(), None)
    return Stack(rows[["func", "call_seq", "parent_seq", "depth", "orphan"]].values.tolist())


def _summary(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    rows = reduced(_rows(pdf))
    return _frame([(*key, *row) for row in rows], _EVENT, ("seq",))


def _open_rows(trace: int, node: int, stack: Stack) -> list[list]:
    return [[trace, node, *e] for e in stack.entries]


def _frame(rows: list, schema: str, whole: tuple[str, ...]) -> pd.DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    return pd.DataFrame(rows, columns=names, dtype=object).astype({c: "Int64" for c in whole})


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The activations that end in each chunk; chunks follow each other, the stack before the events of each."""
    schema = pa.schema([("trace_id", pa.int64()), ("func", pa.string()), ("call_seq", pa.int64()), ("parent_seq", pa.int64()), ("depth", pa.int32()),
                        ("end_seq", pa.int64()), ("orphan", pa.bool_()), ("closed", pa.bool_())])
    now, stack, seq, final, some = None, Stack(), 0, False, False

    def ended() -> list[tuple]:
        return [(now[0], *e[:4], seq, e[4], False) for e in stack.entries] if final and some else []

    def packed(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*done)) or [[]] * len(schema), schema)], schema=schema)

    for batch in batches:
        done: list[tuple] = []
        for trace, node, at, func, event, last, depth, call_seq, parent_seq, orphan in zip(*(c.to_pylist() for c in batch.columns)):
            if (trace, node) != now:
                done += ended()
                now, stack, some = (trace, node), Stack(), False
            if event is None:
                stack._push([func, call_seq, parent_seq, depth, orphan])
            else:
                seq, final, some = at, last, True
                done += [(trace, *e[:4], seq, e[4], own) for e, own in stack.take(seq, func, event)]
        yield packed(done)
    yield packed(ended())


def activations(events: DataFrame, chunk: int = ACTIVATION_CHUNK, fan: int = FAN) -> DataFrame:
    """trace_id, activation, func, parent, depth, call_seq, end_seq, orphan, closed: one row an activation.

    ``events``: trace_id, seq, func, event; rows without a trace, number, function or
    event take no part. ``activation`` counts starts in a trace, ``parent`` is the
    activation below, null at the bottom; what is open at the end ends with the last event.
    """
    own = events.select("trace_id", "seq", "func", "event").where("trace_id is not null and seq is not null and func is not null and event is not null")
    placed = row_numbers(own, ["trace_id"], [F.asc("seq"), F.asc("func"), F.asc("event")], "r")
    placed = placed.select("trace_id", F.floor((F.col("r") - 1) / chunk).cast("long").alias("node"), "seq", "func", "event")
    placed = written(placed, "chunks")
    top = placed.agg(F.max("node")).first()[0] or 0
    ups = [written(placed.groupBy("trace_id", "node").applyInPandas(_summary, _EVENT), "summaries")] if top else []
    n = top
    while n >= fan:
        above = ups[-1].withColumn("node", F.floor(F.col("node") / fan).cast("long"))
        ups.append(written(above.groupBy("trace_id", "node").applyInPandas(_summary, _EVENT), "summaries"))
        n //= fan

    def down(key: tuple, opened: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        """The stacks with which the children of a node begin."""
        trace, parent = key
        stack, out = _stack(opened), []
        by_child = {k: _rows(g) for k, g in pdf.groupby("node")}
        for child in range(parent * fan, parent * fan + fan):
            out += _open_rows(trace, child, stack)
            for row in by_child.get(child, ()):
                stack.take(*row)
        return _frame(out, _OPEN, ("call_seq", "parent_seq", "depth"))

    begun = events.sparkSession.createDataFrame([], _OPEN)
    for summary in reversed(ups):
        below = summary.withColumn("parent", F.floor(F.col("node") / fan).cast("long"))
        opened = begun.withColumn("parent", F.col("node"))
        begun = written(opened.groupBy("trace_id", "parent").cogroup(below.groupBy("trace_id", "parent")).applyInPandas(down, _OPEN), "stacks")
    ends = placed.groupBy("trace_id").agg(F.max("node").alias("last_node"))
    last = placed.join(ends, "trace_id") if top else placed.withColumn("last_node", F.lit(0).cast("long"))
    # the stack with which a chunk begins stands before its events
    entries = begun.select("trace_id", "node", F.lit(None).cast("long").alias("seq"), "func", F.lit(None).cast("string").alias("event"), F.lit(False).alias("last"), "depth", "call_seq", "parent_seq", "orphan")
    own = last.select("trace_id", "node", "seq", "func", "event", (F.col("last_node") == F.col("node")).alias("last"),
                      *[F.lit(None).cast(kind).alias(c) for c, kind in (("depth", "int"), ("call_seq", "long"), ("parent_seq", "long"), ("orphan", "boolean"))])
    lined = dealt(entries.unionByName(own), "trace_id", "node", counted=placed, each=EVENTS_A_TASK)
    lined = lined.sortWithinPartitions("trace_id", "node", F.col("event").isNotNull(), "depth", "seq", "func", "event")
    found = written(lined.mapInArrow(_resolved, _DONE), "ended")  # dealing by ranges reads it twice
    numbered = written(row_numbers(found, ["trace_id"], [F.asc("call_seq")], "activation"), "activations")
    parents = numbered.select("trace_id", F.col("call_seq").alias("parent_seq"), F.col("activation").alias("parent"))
    return numbered.join(parents, ["trace_id", "parent_seq"], "left").select(
        "trace_id", "activation", "func", "parent", "depth", "call_seq", "end_seq", "orphan", "closed")


UPSTREAM = -1


def call_depths(frames: DataFrame, target: Column, library: Column) -> DataFrame:
    """trace_id, activation, call_depth of every frame, by pointer doubling over the parent links.

    A frame of the target has depth 0; below one, a frame of the repository is one deeper
    than its caller and one of a library as deep; frames without a target above are
    upstream, -1. A parent that is not in the table counts as none. Each round doubles
    the links, so a tree of depth d takes log(d) rounds.
    """
    flags = frames.select("trace_id", "activation", "parent", target.alias("t"), F.when(library, 0).otherwise(1).alias("w"))
    known = flags.select("trace_id", F.col("activation").alias("parent")).withColumn("there", F.lit(True))
    flags = flags.join(known, ["trace_id", "parent"], "left")
    root = F.col("there").isNull()
    state = written(flags.select(
        "trace_id", "activation", F.when(~F.col("t") & ~root, F.col("parent")).alias("up"),
        F.when(F.col("t"), 0).when(root, UPSTREAM).otherwise(F.col("w")).cast("int").alias("sum")), "depths")
    while not state.where("up is not null").isEmpty():
        at = state.select("trace_id", F.col("activation").alias("up"), F.col("up").alias("further"), F.col("sum").alias("more"))
        met = state.where("up is not null").join(at, ["trace_id", "up"])
        total = F.when(F.col("further").isNull() & (F.col("more") == UPSTREAM), UPSTREAM).otherwise(F.col("sum") + F.col("more"))
        state = written(state.where("up is null").unionByName(met.select("trace_id", "activation", F.col("further").alias("up"), total.cast("int").alias("sum"))), "depths")
    return state.select("trace_id", "activation", F.col("sum").alias("call_depth"))


def least_depths(frames: DataFrame, target: Column, library: Column, by: list[str]) -> DataFrame:
    """``by``, call_depth: the least depth of each repository function below a target, -1 where it ran upstream only."""
    depths = call_depths(frames, target, library)
    reached = F.min(F.when(F.col("call_depth") >= 0, F.col("call_depth")))
    own = frames.where(~F.coalesce(library, F.lit(False))).join(depths, ["trace_id", "activation"])
    return own.groupBy(*by).agg(F.coalesce(reached, F.lit(UPSTREAM)).alias("call_depth"))
