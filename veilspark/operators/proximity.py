"""Words that stand near each other: a token index over the units of a document, and pairs within a distance.

Positions count over all units of a part, so a pair may stand in two units. A pair is met by the bin of
its first word: a word looks into its own bin and the one before, never at all words of a text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import dimension_join

PLACE = ("doc_id", "part_no")


def token_index(units: DataFrame, shape: str) -> DataFrame:
    """doc_id, part_no, seq, token and pos, which counts from 0 over all units of a part in order of seq. Null
    and empty texts have no tokens."""
    tokens = F.coalesce(F.regexp_extract_all("text", F.lit(shape), F.lit(0)), F.array().cast("array<string>"))
    counted = units.select(*PLACE, "seq", tokens.alias("tokens")).withColumn("n", F.size("tokens").cast("long"))
    before = F.sum("n").over(W.partitionBy(*PLACE).orderBy("seq").rowsBetween(W.unboundedPreceding, -1))
    rows = counted.withColumn("before", F.coalesce(before, F.lit(0))).select(*PLACE, "seq", "before", F.posexplode("tokens").alias("i", "token"))
    return rows.select(*PLACE, "seq", "token", (F.col("before") + F.col("i")).alias("pos"))


def within(first: DataFrame, second: DataFrame, distance: int) -> DataFrame:
    """Pairs of tokens (doc_id, part_no, token, pos): `second` stands 1 to `distance` tokens after `first`."""
    bin_ = lambda c: F.floor(F.col(c) / distance)
    a = first.select(*PLACE, F.col("token").alias("first"), F.col("pos").alias("first_pos")).withColumn("bin", bin_("first_pos"))
    b = second.select(*PLACE, F.col("token").alias("second"), F.col("pos").alias("second_pos"))
    b = b.withColumn("bin", F.explode(F.array(bin_("second_pos"), bin_("second_pos") - 1)))
    return a.join(b, [*PLACE, "bin"]).filter(F.col("second_pos").between(F.col("first_pos") + 1, F.col("first_pos") + distance)).drop("bin")


def other_given_names(units: DataFrame, people: DataFrame, shape: str, distance: int = 3) -> DataFrame:
    """A registered surname that a registered given name of other people follows within the distance, so
    that the two may be somebody unregistered: PLACE, first, first_pos, second, second_pos. people: surname,
    given; pairs that are registered aren't reported."""
    tokens = token_index(units, shape)
    surnames = people.select(F.col("surname").alias("token")).distinct()
    given = people.select(F.col("given").alias("token")).distinct()
    met = within(dimension_join(tokens, surnames, "token", "left_semi"), dimension_join(tokens, given, "token", "left_semi"), distance)
    registered = people.select(F.col("surname").alias("first"), F.col("given").alias("second")).distinct()
    return dimension_join(met, registered, ["first", "second"], "left_anti")
