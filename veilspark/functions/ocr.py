"""Repairs of what OCR reads wrongly, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that OCR takes for digits, and the digits.
LOOKALIKES, DIGITS = "OoDQlIi|ZSBｏＯｌＩ", "00001111258" + "0011"
WIDE = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}々〆ヶー０-９]"
#: Shapes in which lookalikes are repaired: phone numbers, postal codes and long numbers.
_D = f"[0-9０-９{LOOKALIKES.replace('|', '')}]"
SHAPED = rf"(?<![A-Za-z0-9])(?:{_D}{{2,5}}-{_D}{{1,4}}-{_D}{{3,4}}|{_D}{{3}}-{_D}{{4}}|{_D}{{8,}})(?![A-Za-z0-9])"


def joined_wide(c: Column) -> Column:
    """Without the single spaces that OCR puts between wide characters."""
    return F.regexp_replace(c, rf"(?<={WIDE})[ 　](?={WIDE})", "")


def all_digits(c: Column) -> Column:
    return F.translate(c, LOOKALIKES, DIGITS)


def repaired(c: Column) -> Column:
    """With lookalikes repaired inside number shapes that hold at least three real digits."""
    from .patterns import located

    found = F.filter(located(c, SHAPED), lambda m: F.length(F.regexp_replace(m["orig"], "[^0-9]", "")) >= 3)
    end = F.aggregate(found, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), lambda acc, m: F.struct((m["st"] + F.length(m["orig"])).alias("at"), F.concat(acc["out"], F.substring(c, acc["at"] + 1, m["st"] - acc["at"]), all_digits(m["orig"])).alias("out")), lambda acc: F.concat(acc["out"], F.substring(c, acc["at"] + 1, F.length(c))))
    return F.when(c.rlike("[0-9]"), end).otherwise(c)
