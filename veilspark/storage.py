"""Shared storage, joins for skewed keys and distributed ranks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Only where the session names no shared folder and runs on one machine.
LOCAL_FOLDER = "file:///tmp/checkpoints"
#: Rows up to which a dimension is broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 20_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir isn't set: executors of a cluster need a folder that they share")
    return (folder or LOCAL_FOLDER).rstrip("/")


def work_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> bool:
    """Remove what this application kept; for when its results have been written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(work_folder(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Tables kept since `temporary` was entered, if it was.
_KEPT: ContextVar[list[str] | None] = ContextVar("kept tables", default=None)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that are kept inside are removed at its end, for work whose results have been written by then,
    as a batch of a stream."""
    mark = _KEPT.set([])
    try:
        yield
    finally:
        for table in _KEPT.get() or ():
            path = spark._jvm.org.apache.hadoop.fs.Path(table)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _KEPT.reset(mark)


def kept(df: DataFrame, what: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends here, and a lost executor
    costs no more than a read of these files."""
    path = f"{work_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    if (tables := _KEPT.get()) is not None:
        tables.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a table that a task makes others of, or reads in Python.
ROWS_OF_A_TASK = 8_192


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df over as many tasks as its rows need, by keys if there are any. Many short rows are few bytes, so by
    their size they are one split of a file or one part of a shuffle, whatever is then made of each. df is
    counted, so it should be a table."""
    rows, spark = df.count(), df.sparkSession
    return df.repartition(max(min(rows, spark.sparkContext.defaultParallelism), -(-rows // ROWS_OF_A_TASK), 1), *keys)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most `rows` rows; reads no more than that many."""
    return df.limit(rows + 1).count() <= rows


def shuffled(df: DataFrame) -> DataFrame:
    """df, for a join that must not send it over the driver: the size that is guessed of short or repeated rows,
    and of those that an array becomes, is far below the size they have there."""
    return df.hint("merge")


def dimension_join(facts: DataFrame, dimension: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join with a dimension, broadcast only if its counted size allows it."""
    return facts.join(F.broadcast(dimension) if small(dimension) else shuffled(dimension), on, how)


#: A key is hot if it has more than this share of the rows; so there are at most as many hot keys.
HOT_KEYS = 1024


def hot_keys(big: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of more than 1 / HOT_KEYS of the rows of big: at most HOT_KEYS rows. big is read twice, so
    it should be a table."""
    least = big.count() / HOT_KEYS
    return kept(big.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > least).select(*keys), "hot-keys")


#: Hot keys up to which a plan names them; more are broadcast.
NAMED_KEYS = 64


def named_keys(hot: DataFrame) -> list | None:
    """The keys of hot, read once, if they are whole numbers or texts and at most NAMED_KEYS. The driver holds a broadcast table
    of one key in a megabyte or two until it collects garbage, and one is made for each side of a join."""
    if "_named_keys" not in hot.__dict__:
        plain = len(hot.columns) == 1 and hot.dtypes[0][1] in ("int", "bigint", "string")
        found = hot.limit(NAMED_KEYS + 1).collect() if plain else []
        hot._named_keys = [r[0] for r in found if r[0] is not None] if plain and len(found) <= NAMED_KEYS else None
    return hot._named_keys


def skewed_join(big: DataFrame, one: DataFrame, keys: list[str], spread: Column, hot: DataFrame, how: str = "inner", salts: int = 64, wide: bool = False) -> DataFrame:
    """Join in which only hot keys are salted. `hot` (the keys alone) has at most HOT_KEYS rows however
    large the tables are, so it is named in the plan or broadcast; `one` has one row for a key and is repeated for hot ones. wide: as in salted_join."""
    names = named_keys(hot)
    if names is None:
        marked = F.broadcast(hot.withColumn("_hot", F.lit(True)))
        big, one = big.join(marked, keys, "left"), one.join(marked, keys, "left")
    elif names:
        is_hot = F.col(keys[0]).isin(names)
        big, one = big.withColumn("_hot", is_hot), one.withColumn("_hot", is_hot)
    else:
        return big.join(shuffled(one) if wide else one, keys, how)
    part = F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")
    big = big.withColumn("_salt", F.when(F.col("_hot"), part).otherwise(0)).drop("_hot")
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    one = one.withColumn("_salt", F.explode(parts)).drop("_hot")
    return big.join(shuffled(one) if wide else one, [*keys, "_salt"], how).drop("_salt")


def salted_join(big: DataFrame, one: DataFrame, keys: list[str], spread: Column, how: str = "inner", salts: int = 32, wide: bool = False) -> DataFrame:
    """Join in which no task gets all rows of a hot key. `one` has one row for a key and is repeated for
    each of `salts` parts, so it should be small beside `big`. wide: it is known to be too large for a broadcast."""
    big = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    one = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.join(shuffled(one) if wide else one, [*keys, "_salt"], how).drop("_salt")


def spread_join(big: DataFrame, one: DataFrame, keys: list[str], spread: Column, how: str = "inner") -> DataFrame:
    """Join with a table of one row for a key, whose keys may be hot in `big`: broadcast if its counted size
    allows it, else salted."""
    return big.join(F.broadcast(one), keys, how) if small(one) else salted_join(big, one, keys, spread, how, salts=8, wide=True)


def ranked_within(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Add `name`, counting from 1 within each value of `group` in `order`. Groups may be few and
    large: rows are dealt by range, numbered in each part, and the parts' counts are added up."""
    parts = kept(df.repartitionByRange(F.col(group), *order).withColumn("_part", F.spark_partition_id()), "ranked")
    counts = parts.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("_before", before).drop("_n")
    row = F.row_number().over(W.partitionBy("_part", group).orderBy(*order))
    return dimension_join(parts.withColumn("_row", row), offsets, [group, "_part"]).withColumn(name, (F.col("_row") + F.col("_before")).cast("long")).drop("_part", "_row", "_before")
