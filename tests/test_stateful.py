"""Streams with state: against loops over the rows, restarted in between, with late lines and odd rows."""

import random

import numpy as np
import pytest

from lodestone.streaming import stateful as S

LOG = "session_id string, tool string, ts bigint, ord bigint, result string"
LINES = "run_id bigint, source string, at bigint"


def by_loop(rows, limit):
    out, n = [], {}
    for s, t, ts, o, r in rows:
        n[s, t] = n.get((s, t), 0) + 1 if r == "error" else 0
        if n[s, t]:
            out.append((s, t, ts, o, n[s, t], n[s, t] >= limit))
    return sorted(out)


def drain(df, top, once=None):
    df.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{top}/state").format("parquet").option("path", f"{top}/out").start().awaitTermination(200)
    return sorted(tuple(r) for r in df.sparkSession.read.schema(df.schema).parquet(f"{top}/out").collect())


def test_streaks_of_numbers():
    rng = random.Random(1)
    for _ in range(200):
        failed = np.array([rng.random() < 0.6 for _ in range(rng.randint(1, 20))])
        n, want = (before := rng.randint(0, 4)), []
        for f in failed:
            n = n + 1 if f else 0
            want.append(n)
        assert S.streaks(failed, before).tolist() == want


def test_streaks_go_on_after_a_restart(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b"]), rng.choice(["t", "u"]), 1000 * (n // 3), n, rng.choice(["error", "error", "ok"])) for n in range(300)]
    for k, part in enumerate((rows[:150], rows[150:])):
        shuffled = rng.sample(part, len(part))
        spark.createDataFrame(shuffled, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        got = drain(S.failure_streaks(spark.readStream.schema(LOG).parquet(str(tmp_path / "log")), 3, ord="ord"), str(tmp_path))
        assert got == by_loop(rows[: 150 * (k + 1)], 3)


@pytest.mark.parametrize("rows", [1, 10_000])
def test_late_lines_in_both_streams(spark, tmp_path, rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)  # chunks of one row, and all in one
    first = [(1, "stdout", 100), (1, "stderr", 150), (2, "stdout", 90), (3, "stdout", 10), (1, "stdout", 1600), (1, "exit", 1000), (1, "exit", 5000), (4, "exit", 300), (5, "other", 1), (None, "stdout", 1), (6, "stdout", None)]
    second = [(1, "stdout", 1500), (1, "stderr", 1501), (1, "stderr", 1700), (2, "exit", 800), (2, "stderr", 1301), (2, "stdout", 1300), (3, "stderr", 20)]
    top = str(tmp_path)
    stream = lambda: S.drained(spark.readStream.schema(LINES).parquet(f"{top}/lines"), 500, 1000, "60 seconds")
    for part in (first, second):
        spark.createDataFrame(part, LINES).coalesce(1).write.mode("append").parquet(f"{top}/lines")
        assert drain(stream(), top) == []
    spark.createDataFrame([(9, "stdout", 10_000_000)], LINES).write.mode("append").parquet(f"{top}/lines")
    assert drain(stream(), top) == [(1, 2, 1, 1, 2, True), (2, 2, 0, 0, 1, True), (4, 0, 0, 0, 0, False)]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
