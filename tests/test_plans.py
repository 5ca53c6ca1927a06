"""Single-use plans of a stream that comes in several batches."""

import datetime as dt
import random

from veilspark.streaming import plans

SCHEMA = "key long, event_id long, ts timestamp, kind string, extra string"
START = dt.datetime(2024, 1, 1)


def brute(rows, minutes):
    out, plan = set(), {}
    for key, event_id, ts, kind, _ in sorted((r for r in rows if r[0] is not None and r[2] is not None and r[3] in ("view", "buy")), key=lambda r: (r[2], r[1])):
        if kind == "view":
            plan[key] = ts
        else:
            made = plan.pop(key, None)
            used = made is not None and ts - made <= dt.timedelta(minutes=minutes)
            out.add((key, event_id, "used" if used else "refused", int((ts - made).total_seconds()) if used else None))
    return out


def test_plans_over_batches(spark, tmp_path):
    """Batches follow each other in time; their own rows don't."""
    rng, rows, folder = random.Random(2), [], f"file://{tmp_path}/events"
    for batch in range(4):
        part = []
        for _ in range(150):
            at = START + dt.timedelta(minutes=batch * 100 + rng.randrange(100), seconds=rng.randrange(60))
            part.append((rng.choice((1, 2, 3, 4, 5, None)), len(rows) + len(part), at if rng.random() > 0.02 else None, rng.choice(("view", "buy", "other", None)), "x"))
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        rows += part
    # A plan of exactly 30 minutes holds; one second more doesn't.
    edge = [(9, 10_000, START + dt.timedelta(minutes=500), "view", ""), (9, 10_001, START + dt.timedelta(minutes=530), "buy", ""), (8, 10_002, START + dt.timedelta(minutes=500), "view", ""), (8, 10_003, START + dt.timedelta(minutes=530, seconds=1), "buy", "")]
    spark.createDataFrame(edge, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    got = plans.run(spark, plans.uses(stream, "view", "buy"), "plans").select("key", "event_id", "outcome", "age_s").collect()
    want = brute(rows + edge, 30)
    assert {tuple(r) for r in got} == want and len(got) == len(want) and sum(o == "used" for _, _, o, _ in want) > 20


def test_no_events(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    spark.createDataFrame([], SCHEMA).write.parquet(folder)
    assert plans.run(spark, plans.uses(spark.readStream.schema(SCHEMA).parquet(folder), "view", "buy"), "plans").collect() == []
