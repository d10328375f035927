"""Which currency the values of a table are in, by weighted votes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT = "USD"
#: Fixed values: (pattern, code, weight) of a vote; an ISO code in the text gives CODE more.
TOKENS = (
    (r"(?i)\b(?:NGN|NAIRA)\b", "NGN", 4), ("₦", "NGN", 3), (r"(?i)\b(?:GBP|STERLING)\b", "GBP", 4), ("£", "GBP", 3), (r"(?i)\bEUR\b", "EUR", 4), ("€", "EUR", 3),
    (r"(?i)\b(?:KES|KSH)\b", "KES", 4), (r"(?i)\bGHS\b|GH₵", "GHS", 4), (r"(?i)\bZAR\b", "ZAR", 4), (r"(?i)\bINR\b", "INR", 4), ("₹", "INR", 3),
    (r"(?i)\b(?:CNY|RMB)\b", "CNY", 4), ("CN¥|￥", "CNY", 3), (r"(?i)\bJPY\b", "JPY", 4), ("¥", "JPY", 2), (r"(?i)\bCAD\b|CA\$", "CAD", 4), (r"(?i)\bAUD\b|A\$", "AUD", 4),
    (r"(?i)\bUSD\b|US\$", "USD", 4), (r"\$", "USD", 1),
)
CODE = 5
#: The currency codes that count as such.
ISO_CODES = (
    "AED", "AFN", "ALL", "AMD", "ANG", "AOA", "ARS", "AUD", "AWG", "AZN", "BAM", "BBD", "BDT", "BGN", "BHD", "BIF", "BMD", "BND", "BOB", "BRL", "BSD", "BTN", "BWP", "BYN",
    "BZD", "CAD", "CDF", "CHF", "CLP", "CNY", "COP", "CRC", "CUP", "CVE", "CZK", "DJF", "DKK", "DOP", "DZD", "EGP", "ERN", "ETB", "EUR", "FJD", "GBP", "GEL", "GHS", "GMD",
    "GNF", "GTQ", "GYD", "HKD", "HNL", "HUF", "IDR", "ILS", "INR", "IQD", "IRR", "ISK", "JMD", "JOD", "JPY", "KES", "KGS", "KHR", "KMF", "KRW", "KWD", "KZT", "LAK", "LBP",
    "LKR", "LRD", "LSL", "LYD", "MAD", "MDL", "MGA", "MKD", "MMK", "MNT", "MOP", "MRU", "MUR", "MVR", "MWK", "MXN", "MYR", "MZN", "NAD", "NGN", "NIO", "NOK", "NPR", "NZD",
    "OMR", "PAB", "PEN", "PGK", "PHP", "PKR", "PLN", "PYG", "QAR", "RON", "RSD", "RUB", "RWF", "SAR", "SBD", "SCR", "SDG", "SEK", "SGD", "SLE", "SOS", "SRD", "SSP", "STN",
    "SYP", "SZL", "THB", "TJS", "TMT", "TND", "TOP", "TRY", "TTD", "TWD", "TZS", "UAH", "UGX", "USD", "UYU", "UZS", "VES", "VND", "VUV", "WST", "XAF", "XCD", "XOF", "XPF",
    "YER", "ZAR", "ZMW",
)
SYMBOLS = {"USD": "$", "EUR": "€", "GBP": "£", "NGN": "₦", "JPY": "¥", "CNY": "¥", "INR": "₹", "KRW": "₩", "TRY": "₺", "ILS": "₪", "VND": "₫", "PHP": "₱", "BRL": "R$", "CAD": "$", "AUD": "$"}
CURRENCY_COLUMN = r"(?i)(?:^|[_\s-])(?:currency(?:[_\s-]?code)?|ccy)(?:$|[_\s-])"


def code_or_none(code: str | None) -> str | None:
    c = (code or "").strip().upper()
    return c if c in ISO_CODES else None


def symbol(code: str | None) -> str:
    c = code_or_none(code) or DEFAULT
    return SYMBOLS.get(c, c)


def votes(values: DataFrame, column: str = "value") -> DataFrame:
    """code and score: the weights that all values give a code. Values are grouped first,
    so a repeated text is matched once."""
    texts = values.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("_t")).agg(F.count("*").alias("_n"))
    named = F.upper(F.regexp_extract("_t", rf"(?i)\b({'|'.join(ISO_CODES)})\b", 1))
    given = [F.when(named != "", F.struct(named.alias("code"), F.lit(CODE).alias("w")))]
    given += [F.when(F.col("_t").rlike(p), F.struct(F.lit(code).alias("code"), F.lit(w).alias("w"))) for p, code, w in TOKENS]
    each = texts.select("_n", F.inline(F.filter(F.array(*given), lambda x: x.isNotNull())))
    return each.groupBy("code").agg(F.sum(F.col("w") * F.col("_n")).alias("score"))


def voting_cells(raw: DataFrame, metric: str) -> DataFrame:
    """The raw metric cells and those of currency columns, as one column `value`."""
    import re

    own = [metric, *[c for c in raw.columns if c != metric and re.search(CURRENCY_COLUMN, c)]]
    return raw.select(F.explode(F.array(*[F.col(f"`{c}`").cast("string") for c in own])).alias("value"))


def detect(values: DataFrame, column: str = "value", manual: str | None = None) -> DataFrame:
    """One row: code, source (manual, detected or default). The greatest score wins, then
    the first code."""
    spark = values.sparkSession
    if code_or_none(manual):
        return spark.range(1).select(F.lit(code_or_none(manual)).alias("code"), F.lit("manual").alias("source"))
    best = votes(values, column).agg(F.min_by("code", F.struct((-F.col("score")).alias("a"), F.col("code").alias("b"))).alias("code"))
    return best.select(F.coalesce("code", F.lit(DEFAULT)).alias("code"), F.when(F.col("code").isNull(), "default").otherwise("detected").alias("source"))


def first_symbol(rows: DataFrame, columns: Sequence[str], order: str = "row_number") -> DataFrame:
    """One row: the symbol seen first in row order."""
    found = F.regexp_extract(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]), "([$€£¥₦₹₩₺₪₫₱฿])", 1)
    return rows.select(found.alias("symbol"), F.col(order).alias("_o")).where("symbol <> ''").agg(F.min_by("symbol", "_o").alias("symbol"))
