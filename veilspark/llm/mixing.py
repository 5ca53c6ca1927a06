"""Mixing sources to target weights by entropy balancing.

Sources take shares of all words by weight, capped at a multiple of what they have. Within a source
the rates r of its documents stay as near to 1 as their words allow: of all rates below the cap that
meet the source's words, those of least relative entropy are r = min(cap, exp(lambda * size / mean)).
lambda is the root of the convex dual's gradient. All sources take Newton steps together, within
brackets that always hold the root: a step sums the words and their slope over the counts of documents
by source and size, and moves a table of one row a source; steps end when every source's words are
within TOLERANCE of its target, and it is an error if they never are.

Expected copies n * r of the documents of one size are rounded along falling size so that running
totals are never off by more than half a copy; the totals run over ranges of sizes that are dealt over
many tasks. Then copies are moved until the source's words fit. Sums that decide are exact decimals, so
that reruns agree however the rows are dealt.
Copies of a size are dealt to its documents by a hash, in buckets, so that no window holds a hot
source or a hot group of copies. All is DataFrame functions.

Defined cases: a null text has no words. A source of no words gets a target of 0. A null source is
one source, the last. Equal rows are mixed each for itself. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import small
from .common import WORD, free_names, kept, ranked

CAP = 3
#: Hash buckets of the documents of one source and size.
BUCKETS = 4096
NEWTON_STEPS = 60
#: Share of its target by which a source's expected words may be off.
TOLERANCE = 1e-6
EXACT = "decimal(38,6)"


def size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """Add weight and target to sources (key, source_size): shares of the whole by weight in the
    order of key, those above the cap cut, and the excess shared again until none is above. Only
    sums come to the driver."""
    rows = ranked(sources, [F.col("key")], "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    rows = rows.select("key", "source_size", weight.alias("weight"))
    most = F.col("source_size") * cap
    total = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, capped = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) > most
        n, used, free = rows.agg(F.count_if(above), F.coalesce(F.sum(F.when(above, most)), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))).first()
        if n == capped or not free:
            break
        capped, level = n, (total - used) / free
    return rows.withColumn("target", F.least(most.cast("double"), F.col("weight") * F.lit(level)))


def with_source(cells: DataFrame, sources: DataFrame) -> DataFrame:
    """cells with the row of their source; few sources are broadcast."""
    return cells.join(F.broadcast(sources) if small(sources) else sources, "key")


def rates(cells: DataFrame, shares: DataFrame, cap: int = CAP) -> DataFrame:
    """cells (key, size, n, one row for a source and size) with the columns of shares (key, source_size,
    docs, target) and rate."""
    z = F.col("size") * F.col("docs") / F.col("source_size")
    ratio = F.col("target") / F.col("source_size")
    inside = (F.col("target") > 0) & (ratio < cap * (1 - 1e-12))

    def plain(x: Column) -> Column:
        return F.exp(F.least(x * z, F.lit(50.0)))

    # The root lies between these: at the low end no rate is above the ratio, at the high end all are at the cap.
    least = with_source(cells.filter("size > 0"), shares).groupBy("key").agg(F.min(z).alias("least"))
    state = shares.join(least, "key", "left").withColumn("lo", F.when(inside, F.least(F.log(ratio), F.lit(0.0)) / F.col("least")))
    state = state.withColumn("hi", F.when(inside, F.log(F.lit(float(cap))) / F.col("least"))).drop("least").withColumn("x", F.when(inside, F.lit(0.0)))
    state = kept(state, "dual")
    for _ in range(NEWTON_STEPS):
        met = with_source(cells.filter("size > 0"), state.filter("x is not null"))
        words = F.col("n") * F.col("size") * F.least(F.lit(float(cap)), plain(F.col("x")))
        sums = met.groupBy("key").agg(F.sum(words.cast(EXACT)).cast("double").alias("got"), F.sum(F.when(plain(F.col("x")) < cap, (words * z).cast(EXACT))).cast("double").alias("slope"))
        now = kept(state.join(sums, "key", "left"), "gradient")
        if now.filter(F.abs(F.col("got") - F.col("target")) > TOLERANCE * F.col("target")).isEmpty():
            break
        low = F.col("got") < F.col("target")
        now = now.withColumn("lo", F.when(low, F.col("x")).otherwise(F.col("lo"))).withColumn("hi", F.when(low, F.col("hi")).otherwise(F.col("x")))
        step = F.col("x") + F.log(F.col("target") / F.col("got")) * F.col("got") / F.when(F.col("slope") > 0, F.col("slope"))
        state = kept(now.withColumn("x", F.when(step.between(F.col("lo"), F.col("hi")), step).otherwise((F.col("lo") + F.col("hi")) / 2)).drop("got", "slope"), "dual")
    else:
        raise RuntimeError(f"no rates after {NEWTON_STEPS} steps")
    full = F.when(F.col("target") > 0, F.lit(float(cap))).otherwise(0.0)
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("x").isNotNull(), F.least(F.lit(float(cap)), plain(F.col("x")))).otherwise(full)
    return with_source(cells, state).withColumn("rate", rate).drop("lo", "hi", "x")


def running(cells: DataFrame, value: Column) -> DataFrame:
    """cells with upto, the exact sum of value over the cells of their key that are as large or larger."""
    parts = kept(cells.withColumn("value", value.cast(EXACT)).repartitionByRange("key", F.desc("size")).withColumn("part", F.spark_partition_id()), "parts")
    sums = parts.groupBy("key", "part").agg(F.sum("value").alias("sum"))
    before = F.coalesce(F.sum("sum").over(W.partitionBy("key").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("key", "part", before.cast(EXACT).alias("before"))
    upto = F.sum("value").over(W.partitionBy("part", "key").orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, 0))
    rows = parts.withColumn("upto", upto)
    return rows.join(F.broadcast(sums) if small(sums) else sums, ["key", "part"]).withColumn("upto", (F.col("upto") + F.col("before")).cast(EXACT)).drop("part", "before")


def copies(cells: DataFrame, cap: int = CAP) -> DataFrame:
    """Add copies, the whole number that all documents of a cell get together."""
    cells = running(cells, F.col("n") * F.col("rate"))
    half = F.lit("0.5").cast(EXACT)
    whole = F.floor(F.col("upto") + half) - F.floor(F.col("upto") - F.col("value") + half)
    cells = kept(cells.withColumn("copies", F.least(whole, F.col("n") * cap).cast("long")).drop("upto", "value"), "copies")
    # Each step brings the words that are off nearer to none, until no document fits.
    while True:
        off = cells.groupBy("key").agg((F.round(F.first("target")).cast("long") - F.sum(F.col("copies") * F.col("size"))).alias("off"))
        off = kept(off.filter("off <> 0"), "off")
        room = F.when(F.col("off") > 0, F.col("n") * cap - F.col("copies")).otherwise(F.col("copies"))
        fits = (F.col("size") > 0) & (F.col("size") <= F.abs("off")) & (room > 0)
        picks = with_source(cells, off).filter(fits).groupBy("key").agg(F.max("size").alias("size"), F.first("off").alias("off"))
        picks = kept(picks, "picks")
        if picks.isEmpty():
            break
        met = cells.join(F.broadcast(picks) if small(picks) else picks, ["key", "size"], "left")
        some = F.coalesce(F.signum("off").cast("long") * F.least(room, F.floor(F.abs("off") / F.col("size"))), F.lit(0))
        cells = kept(met.withColumn("copies", (F.col("copies") + some).cast("long")).drop("off"), "copies")
    return cells


def mix(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """rows (with doc_id, source and size) with source_size, target, rate, copies and taken added, in place
    of columns of these names."""
    rows = rows.drop("source_size", "target", "rate", "copies", "taken")
    own = free_names(rows.columns, "_key", "_h", "_bucket", "_before", "_n", "_all", "_place")
    k, h, bucket, before, n, all_, place = own
    key = F.struct(F.col("source").isNull().alias("missing"), F.coalesce("source", F.lit("")).alias("name"))
    rows = rows.withColumn(k, key).withColumn(h, F.xxhash64(*rows.columns)).withColumn(bucket, F.pmod(F.col(h), F.lit(BUCKETS)).cast("int"))
    held = kept(rows.groupBy(F.col(k).alias("key"), "size", F.col(bucket).alias("bucket")).agg(F.count("*").alias("held")), "sizes")
    cells = kept(held.groupBy("key", "size").agg(F.sum("held").alias("n")), "cells")
    sources = cells.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("docs"))
    shares = targets(sources.select("key", "source_size"), weights, cap).join(sources.select("key", "docs"), "key")
    cells = copies(rates(cells, kept(shares, "shares"), cap), cap)
    earlier = F.coalesce(F.sum("held").over(W.partitionBy("key", "size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    dealt = held.withColumn("before", earlier).drop("held").join(cells.select("key", "size", "n", "source_size", "target", "rate", F.col("copies").alias("all_copies")), ["key", "size"])
    dealt = dealt.select(F.col("key").alias(k), "size", F.col("bucket").alias(bucket), F.col("before").alias(before), F.col("n").alias(n), F.col("all_copies").alias(all_), "source_size", "target", "rate")
    got = rows.join(dealt, [k, "size", bucket])
    got = got.withColumn(place, F.row_number().over(W.partitionBy(k, "size", bucket).orderBy(F.xxhash64(h, F.lit(1)), h)) + F.col(before))
    got = got.withColumn("copies", (F.floor(F.col(all_) / F.col(n)) + F.when(F.col(place) <= F.col(all_) % F.col(n), 1).otherwise(0)).cast("int"))
    return got.withColumn("taken", F.col("copies") * F.col("size")).drop(*own)
