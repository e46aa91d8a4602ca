from collections import Counter
from datetime import datetime, timedelta

from recollect.plans.queries import QUERIES
from recollect.streaming import pipelines as P

DIR = "/root/testdata/sf0.001"


def events(spark):
    return [(r["user_id"], r["ts"], r["event_type"]) for r in spark.sql(f"SELECT user_id, CAST(ts AS timestamp) AS ts, event_type FROM parquet.`{DIR}/events.parquet`").collect()]


def test_feedback_windows_are_those_of_a_batch(spark):
    want = Counter()
    for user, ts, kind in events(spark):
        day = datetime(ts.year, ts.month, ts.day)
        if kind == "error":
            want.update((str(day - timedelta(days=k)), user) for k in range(30))
    got = QUERIES["stream_feedback"](spark, DIR).collect()
    assert len(got) == len(want) and {(r["start"], r["user_id"]): r["negatives"] for r in got} == dict(want)


def test_sessions_are_those_of_a_batch(spark):
    by: dict[int, list] = {}
    for user, ts, _ in events(spark):
        by.setdefault(user, []).append(ts)
    want = []
    for user, times in by.items():
        times.sort()
        start, end, n = times[0], times[0], 0
        for t in times:
            if t - end >= timedelta(hours=2):
                want.append((user, start, n))
                start, n = t, 0
            end, n = t, n + 1
        want.append((user, start, n))
    got = QUERIES["stream_sessions"](spark, DIR).collect()
    assert Counter((r["user_id"], datetime.fromisoformat(r["start"]), r["n"]) for r in got) == Counter(want)


def test_last_state_counts_every_file_once(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(1, datetime(2024, 1, 1, i), "error")], "user_id long, ts timestamp, event_type string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/e")
    out = P.run_once(P.session_stream(P.source(spark, f"file://{tmp_path}/e", per_trigger=1)), "three", "complete").collect()
    assert [(r["user_id"], r["n"]) for r in out] == [(1, 3)]


def folded(rows):
    """Values of each memory after (memory, ts, ord, signal) in order, and when it retired."""
    out = {}
    for m, ts, _, signal in sorted(rows):
        v = out.setdefault(m, {"v": [0.5, 0.5, 5], "n": [0, 0], "bad": [], "at": None})
        if signal == "positive":
            v["v"] = [min(1.0, v["v"][0] + 0.1), min(1.0, v["v"][1] + 0.05), min(10, v["v"][2] + 1)]
            v["n"][0] += 1
        elif signal == "negative":
            v["v"] = [max(0.0, v["v"][0] - 0.15), max(0.0, v["v"][1] - 0.1), max(1, v["v"][2] - 1)]
            v["n"][1] += 1
            v["bad"] = [t for t in v["bad"] if t >= ts - timedelta(days=30)] + [ts]
            if len(v["bad"]) >= 3 and v["at"] is None:
                v["at"] = ts
    return {m: (round(v["v"][0], 6), round(v["v"][1], 6), v["v"][2], *v["n"], v["at"]) for m, v in out.items()}


def test_feedback_kept_as_state_is_that_of_a_batch(spark, tmp_path):
    """Three files, one run each: late signals within a day find their place, state outlives the runs, old negatives go."""
    day = lambda d, h=0: datetime(2024, 1, 1) + timedelta(days=d, hours=h)
    parts = [
        [(1, day(0), 1, "negative"), (1, day(1), 2, "positive"), (2, day(0), 3, "negative"), (2, day(1), 4, "negative"), (3, day(1), 5, "neutral")],
        [(1, day(0, 12), 6, "positive"), (1, day(20), 7, "negative"), (2, day(20), 8, "positive"), (4, day(20), 9, "negative"), (4, day(20), 10, "negative"), (4, day(20), 11, "negative")],
        [(1, day(45), 12, "negative"), (1, day(44, 20), 13, "positive"), (2, day(45), 14, "negative"), (2, day(46), 15, "negative"), (2, day(46), 16, "negative"), (1, day(45), 17, "negative")],
    ]
    every = []
    for i, part in enumerate(parts):
        spark.createDataFrame(part, "memory_id long, ts timestamp, ord long, signal string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        every += part
        stream = P.feedback_values(P.source(spark, f"file://{tmp_path}/in"))
        got = P.last_values(stream, "memory_id", "values", f"file://{tmp_path}/state", f"file://{tmp_path}/out")
        assert {r["memory_id"]: tuple(r)[1:] for r in got.collect()} == folded(every), i
