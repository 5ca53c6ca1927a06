"""Single-use plans: a preview makes a plan, which the next use consumes unless its time is over.

Each key has one open plan at most, kept in the stream's state: a new preview replaces it, a use takes it, and a
timer by event time removes what nobody used, so the state holds the keys of the last minutes only, however
long the stream runs. A use without an open plan that is in time is refused, whether
the plan was used, is too old or never was; so results don't depend on when timers ran.

Defined cases: within a batch the events of a key are taken in order of time and then id, whatever their files; an
event that is older than the state of its key counts when it comes. Events of other kinds, without a key or
without a time are passed by. A plan is in time up to and including `minutes`. An empty stream has no uses. Events
that repeat are each a use. Replaying a batch gives its results again from the state before it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..storage import work_folder

RESULT = "key long, event_id long, at timestamp, outcome string, age_s long"


def uses(events: DataFrame, makes: str, takes: str, minutes: int = 30) -> DataFrame:
    """key, event_id, at, outcome (used, refused) and age_s (of the plan that is used, else null) of the uses in the
    stream of events (key, event_id, ts, kind)."""
    limit = minutes * 60_000_000

    def of_key(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        plan = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values(["us", "event_id"], kind="stable")
        out = []
        for event_id, us, ts, kind in zip(rows["event_id"], rows["us"], rows["ts"], rows["kind"], strict=True):
            if kind == makes:
                plan = int(us)
                continue
            age = None if plan is None or int(us) - plan > limit else int(us) - plan
            out.append((key[0], event_id, ts, "refused" if age is None else "used", None if age is None else age // 1_000_000))
            plan = None
        if plan is None:
            if state.exists:
                state.remove()
        else:
            state.update((plan,))
            # What is over already can only be told by a use; it goes with the next watermark.
            state.setTimeoutTimestamp(max((plan + limit) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        frame = pd.DataFrame(out, columns=["key", "event_id", "at", "outcome", "age_s"])
        frame["age_s"] = frame["age_s"].astype("Int64")
        yield frame

    rows = events.filter(F.col("kind").isin(makes, takes) & F.col("key").isNotNull() & F.col("ts").isNotNull())
    rows = rows.select(F.col("key").cast("long"), F.col("event_id").cast("long"), F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "kind")
    return rows.withWatermark("ts", "0 seconds").groupBy("key").applyInPandasWithState(of_key, RESULT, "plan long", "append", GroupStateTimeout.EventTimeTimeout)


def run(spark: SparkSession, found: DataFrame, name: str) -> DataFrame:
    """All that is there now, as a table in the shared folder; its checkpoint makes each batch count once."""
    path = f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"
    found.writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{path}/rows")
