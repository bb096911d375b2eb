"""State of resumable loops: the last payload of each loop and its newest memories.

``events(loop_id, seq, kind, iteration, payload)``: ``seq`` numbers the events
of a loop, ``kind`` is ``loop`` (replaces the payload) or ``memory`` (is
remembered).  Events may come late, twice or again after a restart: a payload
is replaced by one of greater ``seq`` only, a memory counts once for its
``seq``, so both forms give the same state in any order of arrival.  Events
with a null loop or number are left out; of events with one number the
greatest payload stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATES = "loop_id string, last_seq long, payload string, memories array<struct<seq:bigint,iteration:bigint,payload:string>>"
_KEPT = "last_seq long, payload string, seqs array<bigint>, iterations array<bigint>, payloads array<string>"


def _usable(events: DataFrame) -> DataFrame:
    x = events.filter("loop_id is not null and seq is not null and kind in ('loop', 'memory')")
    return x.select(F.col("loop_id").cast("string").alias("loop_id"), F.col("seq").cast("long").alias("seq"), "kind", F.col("iteration").cast("long").alias("iteration"), F.coalesce(F.col("payload").cast("string"), F.lit("")).alias("payload"))


def loop_states(events: DataFrame, newest: int = 20) -> DataFrame:
    """``STATES`` of a table of events; memories from the newest on.

    A loop of many events shuffles one partial payload a task and at most
    ``newest`` memories a task (the rank limit is applied before the shuffle).
    """
    x = _usable(events)
    last = x.filter("kind = 'loop'").groupBy("loop_id").agg(F.max("seq").alias("last_seq"), F.max_by("payload", F.struct("seq", "payload")).alias("payload"))
    m = x.filter("kind = 'memory'")
    once = m.groupBy("loop_id", "seq").agg(F.max(F.struct("payload", "iteration")).alias("e"))
    kept = once.withColumn("r", F.row_number().over(Window.partitionBy("loop_id").orderBy(F.desc("seq")))).filter(F.col("r") <= newest)
    held = kept.groupBy("loop_id").agg(F.sort_array(F.collect_list(F.struct("seq", F.col("e.iteration").alias("iteration"), F.col("e.payload").alias("payload"))), asc=False).alias("memories"))
    none = F.array().cast("array<struct<seq:bigint,iteration:bigint,payload:string>>")
    return last.join(held, "loop_id", "full").select("loop_id", "last_seq", "payload", F.coalesce("memories", none).alias("memories"))


def loop_stream(events: DataFrame, newest: int = 20) -> DataFrame:
    """The same over a stream, in update mode: the whole state of each loop that had events.

    State of a loop is one payload and ``newest`` memories, whatever the
    number of its events.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, payload, seqs, iterations, payloads = state.get if state.exists else (None, None, [], [], [])
        held = dict(zip(seqs, zip(payloads, iterations)))
        for f in frames:
            for n, kind, iteration, text in zip(f["seq"], f["kind"], f["iteration"], f["payload"]):
                n, iteration = int(n), None if pd.isna(iteration) else int(iteration)
                if kind == "loop":
                    if seq is None or (n, text) > (seq, payload):
                        seq, payload = n, text
                elif n not in held or (text, -1 if iteration is None else iteration) > (held[n][0], -1 if held[n][1] is None else held[n][1]):
                    held[n] = (text, iteration)
            held = {n: held[n] for n in sorted(held, reverse=True)[:newest]}
        order = sorted(held, reverse=True)
        state.update((seq, payload, order, [held[n][1] for n in order], [held[n][0] for n in order]))
        memories = [{"seq": n, "iteration": held[n][1], "payload": held[n][0]} for n in order]
        yield pd.DataFrame({"loop_id": [key[0]], "last_seq": pd.array([seq], "Int64"), "payload": [payload], "memories": [memories]})

    return _usable(events).groupBy("loop_id").applyInPandasWithState(step, STATES, _KEPT, "update", GroupStateTimeout.NoTimeout)


def recall(events: DataFrame, limit: int = 20, most: int = 200) -> DataFrame:
    """The newest memories of all loops, ``limit`` of them in 1 to ``most``; ties of ``seq`` by loop."""
    m = _usable(events).filter("kind = 'memory'").groupBy("loop_id", "seq").agg(F.max(F.struct("payload", "iteration")).alias("e"))
    return m.select("loop_id", "seq", "e.iteration", "e.payload").orderBy(F.desc("seq"), "loop_id").limit(max(1, min(limit, most)))
