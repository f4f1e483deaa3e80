"""Scope growth against plain rounds; slots and budgets on tables and on a stream with a restart."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from graphloom.operators import scope as S
from graphloom.streaming import slots as B


def plain(seeds, offers, eligible, caps, most, hops, similar=None, annotated=None, least=0.25):
    scope = {s: (0, 1.0, "seed") for s in seeds}
    front = set(seeds)
    for hop in range(1, hops + 1):
        room = min(caps[min(hop, len(caps)) - 1], most - len(scope))
        best = {}
        for a, b, s, r in offers:
            if a in front and b not in scope and b in eligible:
                best[b] = min(best.get(b, (-s, r)), (-s, r))
        if similar is not None:
            core = [x for x in seeds if x in annotated]
            for b in list(best):
                if b in annotated and core and max(similar.get((b, c), similar.get((c, b), 0.0)) for c in core) < least or b not in annotated and not best[b][1].startswith("gene"):
                    del best[b]
        front = {b for b, _ in sorted(best.items(), key=lambda x: (x[1][0], x[0]))[: max(0, room)]}
        scope |= {b: (hop, -best[b][0], best[b][1]) for b in front}
    return scope


def test_scope_equals_plain_rounds(spark):
    rnd = random.Random(3)
    offers = [(rnd.randrange(60), rnd.randrange(60), rnd.choice([0.5, 0.7, 1.0]), rnd.choice(["gene 1", "gene 2", "pathway 3"])) for _ in range(260)]
    df = spark.createDataFrame(offers, "source long, target long, score double, reason string")
    ids = lambda x: spark.createDataFrame([(i,) for i in x], "id long")
    eligible = {i for i in range(60) if i % 7}
    got = lambda d: {r["id"]: (r["hop"], r["score"], r["reason"]) for r in d.collect()}
    for caps, most, hops in (([8, 5], 100, 3), ([50], 12, 2), ([3], 3, 2)):
        assert got(S.expand(ids([0, 1, 14, 14]), df, ids(eligible), caps, most, hops)) == plain([0, 1, 14], offers, eligible, caps, most, hops)
    similar = {(a, b): rnd.random() / 2 for a in range(0, 60, 2) for b in (0, 14) if a != b}
    annotated = set(range(0, 60, 2))
    args = {"similar": spark.createDataFrame([(a, b, s) for (a, b), s in similar.items()], "a long, b long, score double"), "annotated": ids(annotated), "least": 0.25, "trusted": "gene"}
    assert got(S.expand(ids([0, 1, 14]), df, ids(eligible), [9], 100, 2, args)) == plain([0, 1, 14], offers, eligible, [9], 100, 2, similar, annotated)
    assert S.expand(ids([]), df, None, [9], 100).collect() == []


START = datetime(2024, 3, 1, 22, 0)


def requests(n=400):
    rnd = random.Random(5)
    at, out = START, []
    for i in range(n):
        at += timedelta(seconds=rnd.choice([0, 5, 60, 300, 900]))
        out.append((i, rnd.choice([1, 1, 2, 3]), at, "x"))
    return out


def verdicts(rows, capacity, minutes, daily):
    held, used, out = {}, {}, {}
    for i, u, at, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        live = [e for e in held.get(u, []) if e > at]
        if len(live) >= capacity:
            out[i] = "busy"
        elif used.get((u, at.date()), 0) >= daily:
            out[i] = "budget"
        else:
            out[i], live = "granted", [*live, at + timedelta(minutes=minutes)]
            used[u, at.date()] = used.get((u, at.date()), 0) + 1
        held[u] = live
    return out


SCHEMA = "event_id long, user_id long, ts timestamp, extra string"


def test_grants_of_a_table(spark):
    rows = requests()
    df = spark.createDataFrame([*rows, (900, None, START, "x"), (901, 1, None, "x")], SCHEMA).repartition(5)
    got = {r["event_id"]: r["verdict"] for r in B.granted(df, 2, 15, 40).collect()}
    assert got == verdicts(rows, 2, 15, 40) and set(got.values()) == {"granted", "busy", "budget"}
    assert B.granted(df.limit(0)).collect() == []


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    rows = requests(240)
    df = spark.createDataFrame(rows, SCHEMA)
    schema, source = df.schema, str(tmp_path / "in")

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        B.granted_stream(stream, 2, 15, 40).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(200)

    for k in range(2):  # the second run starts from the first one's checkpoint
        df.where((F.col("event_id") >= 120 * k) & (F.col("event_id") < 120 * (k + 1))).coalesce(1).write.mode("append").parquet(source)
        run()
    got = {r["event_id"]: r["verdict"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == verdicts(rows, 2, 15, 40)
