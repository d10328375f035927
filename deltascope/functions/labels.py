"""Labels for amounts, ranks and dates, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_amount(c: Column, symbol: str = "") -> Column:
    """The size of an amount without decimals."""
    return F.concat(F.lit(symbol), F.format_number(F.abs(c), 0))


def signed_amount(c: Column, symbol: str = "") -> Column:
    sign = F.when(c < 0, "−").when(c > 0, "+").otherwise("")
    return F.concat(sign, plain_amount(c, symbol))


def ordinal(n: Column) -> Column:
    tail = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), tail)


def plural(word: Column, n: Column) -> Column:
    many = F.when(word.endswith("y"), F.regexp_replace(word, "y$", "ies")).otherwise(F.concat(word, F.lit("s")))
    return F.when(n == 1, word).otherwise(many)


def readable_day(d: Column) -> Column:
    return F.date_format(d, "MMMM d, yyyy")
