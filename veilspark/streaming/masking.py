"""Masking a stream of units with a codebook that grows from batch to batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.patterns import KINDS
from ..operators import codebook
from ..operators.mask import apply_found, spans_of, with_spans
from ..storage import kept, temporary

UNITS = "doc_id long, part_no int, seq int, text string"


def units_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Units that arrive as JSON lines in a folder."""
    return spark.readStream.schema(UNITS).json(folder)


def read_book(spark: SparkSession, folder: str, before: int) -> DataFrame:
    """The codebook as it was before a batch; each batch has its own partition."""
    if before == 0:
        return codebook.empty(spark)
    return spark.read.schema(codebook.SCHEMA + ", batch long").parquet(folder).filter(f"batch < {before}").drop("batch")


def mask_stream(units: DataFrame, book: str, out: str, checkpoint: str, kinds: tuple[str, ...] = KINDS) -> StreamingQuery:
    """Mask all units that are there and stop. A batch that is run again overwrites what it wrote: its
    codes are those of the same batch number, so codes given before never change."""

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        with temporary(spark):
            known = read_book(spark, book, number)
            found = kept(with_spans(batch, kinds), "found")
            spans = spans_of(found)
            codebook.allocate(spans, known).write.mode("overwrite").parquet(f"{book}/batch={number}")
            whole = known.unionByName(spark.read.schema(codebook.SCHEMA).parquet(f"{book}/batch={number}"))
            masked = apply_found(found, codebook.with_codes(spans, whole))
            masked.select("doc_id", "part_no", "seq", "masked").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return units.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
