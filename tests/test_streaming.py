"""States smoothed on a stream equal those of the batch operator, point by point."""

import random

import pytest
from pyspark.sql import functions as F

from tidewake.operators.smoothing import smooth
from tidewake.streaming.smoothing import Runs, smooth_stream

BASE = 1_700_000_000_000_000
SCHEMA = "trip_id long, event_id long, t_us long, is_fishing int"


def batch(spark, rows, least=3):
    df = smooth(spark.createDataFrame(rows, SCHEMA), least=least)
    return {r.event_id: r.is_fishing for r in df.collect()}


def tracks(seed, trips=12, most=60):
    rng, rows, n = random.Random(seed), [], 0
    for t in range(trips):
        at, state = BASE + rng.randrange(3_600_000_000), rng.randrange(2)
        for _ in range(rng.randrange(1, most)):
            state = 1 - state if rng.random() < 0.4 else state
            at += rng.choice([0, 30_000_000, 60_000_000])
            rows.append((t, n, at, state))
            n += 1
    return rows


@pytest.mark.parametrize("least", [2, 3, 5])
def test_runs_equal_the_batch_operator(spark, least):
    rows = tracks(least)
    want, got = batch(spark, rows, least), {}
    for t in {r[0] for r in rows}:
        runs = Runs(least)
        for _, e, u, s in sorted((r for r in rows if r[0] == t), key=lambda r: (r[2], r[1])):
            got |= {p[1]: p[2] for p in runs.add((u, e), s)}
            assert len(runs.held) < least
            runs = Runs(least, *runs.to_list())
        got |= {p[1]: p[2] for p in runs.end()}
    assert got == want


def test_micro_batches_out_of_order(spark, tmp_path):
    rows = tracks(9)
    order = sorted(rows, key=lambda r: r[2] + random.Random(r[1]).randrange(600_000_000))  # ten minutes out of order at most
    order.append((None, -1, BASE, 1))
    parts = [order[i : i + 90] for i in range(0, len(order), 90)] + [[(999, 10**6, BASE + 10**12, 0)], [(999, 10**6 + 1, BASE + 2 * 10**12, 0)]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{i:03}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    out = smooth_stream(stream.withColumn("seen", F.timestamp_micros("t_us")), "seen", late="30 minutes", gap="2 hours")
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None and not q.isActive
    got = [r for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.trip_id != 999]
    assert len(got) == len(rows) and {r.event_id: r.is_fishing for r in got} == batch(spark, rows)
    when = {r[1]: r[2] for r in rows}
    assert all(int(r.seen.timestamp() * 1e6 + 0.5) == when[r.event_id] for r in got)
