"""State of loops: stream with replays, table, and plain Python give the same."""

import random

from pyspark.sql import functions as F

from lodestone.streaming import loops

EVENTS = "loop_id string, seq long, kind string, iteration long, payload string"


def want(rows, newest):
    out = {}
    for loop, seq, kind, iteration, payload in rows:
        if loop is None or seq is None or kind not in ("loop", "memory"):
            continue
        last, memories = out.setdefault(loop, [None, {}])
        event = (payload or "", iteration)
        if kind == "loop":
            out[loop][0] = max(last, (seq, event[0])) if last else (seq, event[0])
        else:
            memories[seq] = max(memories.get(seq, event), event, key=lambda e: (e[0], -1 if e[1] is None else e[1]))
    return {k: (*(last or (None, None)), [(s, m[s][1], m[s][0]) for s in sorted(m, reverse=True)[:newest]]) for k, (last, m) in out.items()}


def states(rows):
    return {r["loop_id"]: (r["last_seq"], r["payload"], [tuple(m) for m in r["memories"]]) for r in rows}


def drawn(n=300):
    rng = random.Random(5)
    rows = [(rng.choice(["hot"] * 5 + ["a", "b", None]), rng.choice([None] + list(range(1, 60))), rng.choice(["loop", "memory", "memory", "memory", "other"]), rng.choice([None, 1, 2]), rng.choice([None, "", "p", "{\"x\": 1}", "é"])) for _ in range(n)]
    return rows + [("only-loop", 1, "loop", None, "x"), ("only-memory", 1, "memory", None, None)]


def test_table_against_plain(spark):
    rows = drawn()
    df = spark.createDataFrame(rows + rows[:50], EVENTS).withColumn("extra", F.lit(1))
    assert states(loops.loop_states(df, 4).collect()) == want(rows, 4)
    assert loops.loop_states(df.limit(0)).collect() == []
    got = [tuple(r) for r in loops.recall(df, 7).collect()]
    memories = sorted(((-s, k, i, p) for k, (_, _, m) in want(rows, 10**6).items() for s, i, p in m), key=lambda x: x[:2])
    assert [(k, s) for k, s, _, _ in got] == [(k, -s) for s, k, _, _ in memories[:7]]
    assert len(loops.recall(df, 0).collect()) == 1


def test_stream_with_replays(spark, tmp_path):
    rows = drawn()
    source, out = f"{tmp_path}/in", f"{tmp_path}/state"

    def put(part, seen):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(source)
        stream = loops.loop_stream(spark.readStream.schema(EVENTS).parquet(source), 4)
        latest = {}

        def keep(df, _):
            latest.update({r["loop_id"]: r for r in df.collect()})

        stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", out).trigger(availableNow=True).start().awaitTermination()
        return seen | latest

    # out of order, with the second batch holding the first again
    seen = put(rows[150:], {})
    seen = put(rows[:200] + rows[150:160], seen)
    assert states(seen.values()) == want(rows, 4)
