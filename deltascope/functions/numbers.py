"""Numbers from business text, as a Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bare_text, let, missing

#: Currency codes and symbols that may stand beside a number.
CODES = (
    "NGN", "USD", "EUR", "GBP", "CAD", "AUD", "ZAR", "KES", "GHS", "AED", "INR", "JPY", "CNY", "RMB", "CHF", "BRL", "MXN", "NZD", "SGD", "HKD",
    "KRW", "TRY", "ILS", "SEK", "NOK", "DKK", "PLN", "CZK", "HUF", "THB", "IDR", "MYR", "PHP", "VND",
)
SYMBOLS = "$€£¥₦₹₩₺₪₫₱฿"
#: What stands beside the digits: currency marks, and on either side signs of a negative.
CURRENCY = rf"(?i)R\$|\b(?:{'|'.join(CODES)})\b|[{SYMBOLS}]"
NEGATIVE = r"(?i)^\(.*\)$|^-|-$|\bDR$"
FILLING = r"(?i)\b(?:CR|DR)$|^[-+](?=[^-+])|-$|[()\s%’']"
#: Digits with their marks, an exponent and a scale.
PARTS = r"^([0-9.,]*[0-9][0-9.,]*)([eE][-+]?[0-9]+)?([KMBkmb]?)$"
#: Common notations, which need no taking apart: a currency mark before the digits, one sign
#: of a negative, and digits that are grouped by commas or by dots. A text that begins with
#: a letter of no currency mark is no number. All are ASCII and say the same as the steps below.
_LEAD = rf"(?:\$|(?:{'|'.join(CODES)}) )?"
_COMMAS, _DOTS = r"(?:\d{1,3}(?:,\d{3}){1,5}|\d{1,18})(?:\.\d{1,18})?", r"(?:\d{1,3}(?:\.\d{3}){1,5},\d{1,18}|\d{1,18},\d{1,2})"
WORDS = rf"(?i)^(?!R\$|(?:{'|'.join(CODES)})\b)[a-z][\x20-\x7e]*\z"


def _signed(body: str) -> str:
    return rf"^'?(?:-?{_LEAD}{body}|\({_LEAD}{body}\)|{_LEAD}{body}(?:-| [CD]R))\z"


def parse_number(c: Column) -> Column:
    """A double from text with currency marks, parentheses or a minus at either end for
    negative, CR or DR, a per cent sign (dropped), K, M or B, an exponent, and either
    grouping; null if it is none.

    The order of the marks among the digits says what they are. One mark that differs from
    all before it is decimal, and so is a lone dot, or a lone comma before one or two
    digits. Marks of one kind only group, but several commas before one or two digits are
    no number, nor are marks in any other order."""

    def bare(raw: Column) -> Column:
        return F.when(~missing(raw), let(F.trim(F.regexp_replace(raw, CURRENCY, "")), signed))

    def signed(t: Column) -> Column:
        return let(F.regexp_replace(F.regexp_replace(t, FILLING, ""), r"-$", ""), lambda core: F.when(t.rlike(NEGATIVE), -sized(core)).otherwise(sized(core)))

    def sized(core: Column) -> Column:
        scale = F.upper(F.regexp_extract(core, PARTS, 3))
        times = F.when(scale == "K", 1e3).when(scale == "M", 1e6).when(scale == "B", 1e9).otherwise(1.0)
        value = F.concat(let(F.regexp_extract(core, PARTS, 1), digits), F.regexp_extract(core, PARTS, 2)).try_cast("double") * times
        return F.when(core.rlike(PARTS), F.when(F.abs(value) < float("inf"), value))  # a cast of no digits is slow

    def digits(body: Column) -> Column:
        marks, plain = F.regexp_replace(body, "[0-9]", ""), F.regexp_replace(body, "[.,]", "")
        tail = F.length(F.regexp_extract(body, "([0-9]*)$", 1))
        few = (tail == 1) | (tail == 2)
        decimal = (marks == ".") | ((marks == ",") & few) | marks.rlike(r"^(,+\.|\.+,)$")
        grouped = marks.rlike(r"^(\.\.+|,,+|,?)$") & ~(F.startswith(marks, F.lit(",")) & few)
        cut = F.length(plain) - tail
        return F.when(decimal, F.concat(F.substring(plain, F.lit(1), cut), F.lit("."), F.substring(plain, cut + 1, tail))).when(grouped, plain)

    def common(marks: str, to: str) -> Column:
        value = F.translate(F.regexp_extract(c, "[0-9][0-9.,]*", 0), marks, to).try_cast("double")
        return F.when(c.rlike(r"[-(]|DR\z"), -value).otherwise(value)

    # plain numbers, and those with a dollar sign and grouped by threes, are most: they
    # take one test and a cast
    c = c.cast("string")
    grouped = c.rlike(r"^\$?-?\d{1,3}(?:,\d{3})+(?:\.\d+)?$|^\$\d+(?:\.\d+)?$")
    return (
        F.when(c.rlike(r"^-?\d+(?:\.\d+)?$"), c.try_cast("double"))
        .when(grouped, F.regexp_replace(c, "[$,]", "").try_cast("double"))
        .when(c.rlike(WORDS), None)
        .when(c.rlike(_signed(_COMMAS)), common(",", ""))
        .when(c.rlike(_signed(_DOTS)), common(",.", "."))
        .otherwise(let(F.regexp_replace(bare_text(c), "^'", ""), bare))
    )


def simple_number(c: Column) -> Column:
    """Only symbols, grouping commas and parentheses."""
    raw = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    body = F.regexp_replace(raw, rf"[{SYMBOLS},\s()%]", "")
    value = F.when(body.rlike(r"^-?(?:\d+\.?\d*|\.\d+)$"), body.try_cast("double"))
    return F.when(raw.rlike(r"^\(.*\)$"), -F.abs(value)).otherwise(value)


def adjustment_mode(header: str, fallback: str) -> str:
    """amount or percentage, from a header's words; words for amounts win."""
    import re

    h = re.sub(r"[._-]+|\s+", " ", header.lower())
    if re.search(r"\b(amount|value|total|charge|fee|paid)\b", h):
        return "amount"
    return "percentage" if re.search("percent|pct|%|rate|ratio", h) else fallback


def derived_amount(quantity: Column, price: Column, discount: Column | None = None, discount_mode: str = "amount", tax: Column | None = None, tax_mode: str = "amount") -> Column:
    """quantity * price - discount + tax; a percentage is of the base, an adjustment that
    does not parse is 0, a missing quantity or price gives null."""
    base = quantity * price

    def adjust(c: Column | None, mode: str) -> Column:
        if c is None:
            return F.lit(0.0)
        return F.coalesce(base * (c / 100) if mode == "percentage" else c, F.lit(0.0))

    return base - adjust(discount, discount_mode) + adjust(tax, tax_mode)
