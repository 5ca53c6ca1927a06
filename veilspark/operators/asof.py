"""As-of join: for each row the last row of another table at or before it, and what a ledger says by it.

Both tables are written once, as one, and dealt by key. Keys may be hot: their rows are dealt by range of key and
time, so a key's rows lie in many parts, are merged in each, and the last row of a part is carried to the parts
behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import HOT_KEYS, ROWS_OF_A_TASK, dimension_join, kept, shuffled
from .lineage import views


#: Keys that are watched to find the hot ones; as many as this that a key of 1 / HOT_KEYS of all rows can't be missed.
WATCHED_KEYS = 10_000
#: Rows up to which a key isn't hot, whatever its share.
HOT_ROWS = ROWS_OF_A_TASK


def _hot(parts: DataFrame, key: Column) -> list[int]:
    """The hashes key of parts, a table, that have more than 1 / HOT_KEYS of its rows. Each task counts on its own."""
    tops = F.call_function("approx_top_k", key, F.lit(HOT_KEYS), F.lit(WATCHED_KEYS)).alias("tops")
    n, found = parts.agg(F.count("*"), tops).first()
    return [r["item"] for r in found or () if r["count"] > max(n / HOT_KEYS, HOT_ROWS)]


def as_of(rows: DataFrame, past: DataFrame, keys: list[str], at: str, ties: list[str], strictly: bool = False) -> DataFrame:
    """rows with `found`: the row of past (a struct of its columns) with equal keys and the largest `at`
    not after theirs (with strictly: before theirs), of equal ones that with the largest `ties`; null if
    there is none. Both tables have the columns keys and at.

    Rows with a null key or time find nothing and stay; rows of past with one are never found. Repeated
    rows stay repeated, and an empty table of either kind is fine. Columns of both tables may share names."""
    # Keys and times are written once; rows, and what they find, get them back.
    def lean(df: DataFrame) -> Column:
        return F.struct(*[df[c] for c in df.columns if c not in (*keys, at)] or [F.lit(True).alias("_there")])

    whole, here = lean(past), lean(rows)
    key, time = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], F.col(at).alias("_at")
    names = [f"_k{i}" for i in range(len(keys))]
    key_of = {c: F.col(n) for c, n in zip(keys, names, strict=True)}
    able = F.expr(" AND ".join(f"{n} IS NOT NULL" for n in (*names, "_at")))
    side = lambda n: F.lit(n).cast("byte").alias("_side")
    mine = rows.select(*key, time, side(0 if strictly else 1), F.lit(None).cast(past.select(whole.alias("s")).schema[0].dataType).alias("_past"), here.alias("_row"))
    theirs = past.select(*key, time, side(1 if strictly else 0), whole.alias("_past"), F.lit(None).cast(mine.schema["_row"].dataType).alias("_row")).filter(able)
    parts = kept(mine.unionByName(theirs), "as-of")

    def filled(df: DataFrame, s: str, time: str) -> Column:
        return F.struct(*[(key_of[c] if c in key_of else F.col(time).cast(df.schema[at].dataType) if c == at else F.col(s)[c]).alias(c) for c in df.columns])

    def with_found(df: DataFrame, seen: str) -> DataFrame:
        return df.select(filled(rows, "_row", "_at").alias("_row"), F.when(F.col(seen).isNotNull(), filled(past, f"{seen}.past", f"{seen}.at")).alias("found"))

    order = ["_at", "_side", *[F.col("_past")[c] for c in ties if c not in (*keys, at)]]
    there = F.when(F.col("_past").isNotNull(), F.struct(F.col("_at").alias("at"), F.col("_past").alias("past")))

    def last_seen(df: DataFrame, *group: str) -> DataFrame:
        w = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
        return df.withColumn("_seen", F.last(there, ignorenulls=True).over(w)).filter("_row IS NOT NULL")

    none = parts.filter(~F.coalesce(able, F.lit(False))).withColumn("_seen", F.lit(None).cast(parts.select(there.alias("s")).schema[0].dataType))
    one = F.xxhash64(*names)
    hot = _hot(parts.filter(able), one)
    is_hot = one.isin(hot) if hot else F.lit(False)
    # Dealt before the window, which would have its order and what it looks for dealt as further columns.
    out = with_found(last_seen(parts.filter(able & ~is_hot).repartition(*names), *names), "_seen").unionByName(with_found(none, "_seen"))
    if hot:
        dealt = kept(parts.filter(able & is_hot).repartitionByRange(*names, *order).withColumn("_part", F.spark_partition_id()), "as-of")
        # A row for each key of a part: parts are as many as the shuffle has, however hot a key is.
        ends = dealt.groupBy(*names, "_part").agg(F.max_by(there, F.when(F.col("_past").isNotNull(), F.struct(*order))).alias("_end"))
        carried = F.last("_end", ignorenulls=True).over(W.partitionBy(*names).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
        carried = ends.select(*names, "_part", carried.alias("_carried")).filter("_carried IS NOT NULL")
        met = dimension_join(last_seen(dealt.repartition("_part", *names), "_part", *names), carried, [*names, "_part"], "left")
        out = out.unionByName(with_found(met.withColumn("_seen", F.coalesce("_seen", "_carried")), "_seen"))
    return out.select("_row.*", "found")


def restaged(ledger: DataFrame, stages: DataFrame) -> DataFrame:
    """stage, at, source, report and reported_at: for each staged file (stage, at) the sources that its
    hash goes back to, and of each the last report of its masking by then, null if there is none. Staged
    files that no source leads to are left out."""
    # Links are made distinct once: hashes are dear to shuffle and to write.
    done = (F.col("kind") == "M") & (F.col("status") == "ok")
    links = ledger.filter(done).select(F.col("h2").alias("stage"), F.col("h1").alias("source")).distinct()
    met = stages.select("stage", "at").join(shuffled(links), "stage")
    reports = ledger.filter(done).select(F.col("h1").alias("source"), "at", F.col("ref").alias("report"))
    found = as_of(met, reports, ["source"], "at", ["report"])
    return found.select("stage", "at", "source", F.col("found.report").alias("report"), F.col("found.at").alias("reported_at"))


def job_materials(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files of jobs (job, hash, name) whose hash leads to their job, with guessed false; a job none of whose
    files does has them all, with guessed true."""
    _, s, _ = views(ledger)
    known = s.select("job", F.col("stage").alias("hash")).distinct().withColumn("own", F.lit(True))
    marked = files.select("job", "hash", "name").join(known, ["job", "hash"], "left").withColumn("own", F.coalesce("own", F.lit(False)))
    jobs = marked.groupBy("job").agg(F.bool_or("own").alias("any"))
    return dimension_join(marked, jobs, "job").filter("own OR NOT any").select("job", "hash", "name", (~F.col("any")).alias("guessed"))
