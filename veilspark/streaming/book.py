"""A codebook that lives in the state of a stream, and rows handed over once by their content.

Each prefix's originals are dealt by hash over `parts` counters. The state of a counter holds how many codes it gave
and, an entry each, the originals it knows; a batch reads and writes the entries of its own originals
only, so its cost doesn't grow with the book. Counter p of P gives the numbers p + 1, p + 1 + P, p + 1 + 2P …, so no two
give the same one, and a prefix with a third of all rows is spread over P tasks. With one part numbers are
gapless. The number of parts belongs to the stream's checkpoint and can't change.

Defined cases: within a batch originals are numbered in order of (doc_id, part_no, seq, st), nulls first, and an original
keeps its number in all later ones, however late its rows come. A null original or kind has no code and is passed
by; an empty original is one like any other; rows that repeat are coded each. An empty stream gives an empty table.
A batch that fails is run again from the state before it, so it gives the same codes.
"""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import sanitize_prefix
from ..operators.codebook import ORDER, code_of
from ..storage import work_folder

#: Counters of a prefix.
PARTS = 16
#: Spark keeps entries of a state apart in this store only.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE_CONF = "spark.sql.streaming.stateStore.providerClass"
#: Where a place without a value stands: before all others.
NULL = float("-inf")
CODED = "doc_id long, part_no int, seq int, st int, prefix string, orig string, n long, new boolean"


def part_of(orig: Column, parts: int) -> Column:
    """The counter of an original, from 28 bits of its MD5."""
    return F.pmod(F.conv(F.left(F.md5(orig), F.lit(7)), 16, 10).cast("long"), F.lit(parts)).cast("int")


class Counter(StatefulProcessor):
    """The codes of one prefix and part."""

    def __init__(self, parts: int) -> None:
        self.parts = parts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.given = handle.getValueState("given", "n long")
        self.known = handle.getMapState("known", "orig string", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        prefix, part = key
        with tempfile.TemporaryFile() as spool:
            # Rows are put aside chunk by chunk; of each original only the first of its rows is held.
            first: dict[str, tuple] = {}
            chunks = 0
            for frame in rows:
                frame = frame[[*ORDER, "orig"]].astype(dict.fromkeys(ORDER, "Int64")).reset_index(drop=True)
                pickle.dump(frame, spool)
                led = frame.sort_values(ORDER, kind="stable", na_position="first").drop_duplicates("orig")
                for orig, at, *place in zip(led["orig"], led.index, *(led[c].to_numpy(object, na_value=NULL) for c in ORDER), strict=True):
                    row = (*place, chunks, at)
                    if orig not in first or row < first[orig]:
                        first[orig] = row
                chunks += 1
            given = before = self.given.get()[0] if self.given.exists() else 0
            numbers: dict[str, int] = {}
            for orig in sorted(first, key=first.__getitem__):
                if self.known.containsKey((orig,)):
                    numbers[orig] = self.known.getValue((orig,))[0]
                    del first[orig]
                else:
                    numbers[orig] = given * self.parts + int(part) + 1
                    self.known.updateValue((orig,), (numbers[orig],))
                    given += 1
            if given > before:
                self.given.update((given,))
            spool.seek(0)
            for chunk in range(chunks):
                out = pickle.load(spool)  # noqa: S301  written above
                # The first row of a new original is the one that goes into the book.
                new = [first.get(o, ())[-2:] == (chunk, at) for at, o in enumerate(out["orig"])]
                yield out.assign(prefix=prefix, n=out["orig"].map(numbers), new=new)[[*ORDER, "prefix", "orig", "n", "new"]]

    def close(self) -> None:
        pass


def coded(spans: DataFrame, parts: int = PARTS) -> DataFrame:
    """The spans (ORDER, kind, orig) of a stream with prefix, n, code and new, which the first row of each original has."""
    rows = spans.filter(F.col("orig").isNotNull() & F.col("kind").isNotNull())
    rows = rows.select(F.col("doc_id").cast("long"), F.col("part_no").cast("int"), F.col("seq").cast("int"), F.col("st").cast("int"), sanitize_prefix(F.col("kind")).alias("prefix"), "orig", part_of(F.col("orig"), parts).alias("part"))
    found = rows.groupBy("prefix", "part").transformWithStateInPandas(Counter(parts), CODED, "append", "none")
    return found.withColumn("code", code_of(F.col("prefix"), F.col("n")))


def handed_over(rows: DataFrame) -> DataFrame:
    """The rows of a stream by their content, each once, with its content_hash; a row that comes again, in the
    same file or a later one, is known by its hash, which is all that the state keeps."""
    content = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    return rows.withColumn("content_hash", F.sha2(content, 256)).dropDuplicates(["content_hash"])


def run(stream: DataFrame, path: str | None = None, name: str = "book") -> DataFrame:
    """All that is there now, appended to the table of `path` (a new one in the shared folder without it) and read
    back. The table's own log makes each batch count once, also if it is run again."""
    spark: SparkSession = stream.sparkSession
    path = path or f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(STORE_CONF)
    spark.conf.set(STORE_CONF, STORE)
    try:
        query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    finally:
        spark.conf.set(STORE_CONF, before)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def book_of(found: DataFrame) -> DataFrame:
    """The book of a table of coded rows: prefix, orig, n, code, a row for each original."""
    return found.filter("new").select("prefix", "orig", "n", "code")
