import datetime as dt

import pytest
from pyspark.sql import functions as F

from deltascope.functions import text
from deltascope.functions.dates import DatePolicy, epoch_date, is_ambiguous, parse_date, parts_date, serial_date
from deltascope.functions.numbers import adjustment_mode, derived_amount, parse_number, simple_number


def apply(spark, values, column):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").select("i", column(F.col("x")).alias("y")).orderBy("i").collect()
    return [r.y for r in rows]


NUMBERS = {
    "2,345.67 DR": -2345.67, "1.234.567,89": 1234567.89, "1,250-": -1250.0, "2.05K": 2050.0, "4.20E+03": 4200.0, "NGN (1,234.56)": -1234.56, "USD (2,500.00)": -2500.0, "₦(99.25)": -99.25,
    "NGN 300.00 CR": 300.0, "NGN 125.00 DR": -125.0, "$4,385.00": 4385.0, "N/A": None, "R$ 12,5": 12.5, "'45": 45.0, "1'000.5": 1000.5, "abc": None, "12%": 12.0, "1,234": 1234.0, "-5": -5.0, "(7)": -7.0,
    "1e5x": None, ".5": 0.5, "1.2.3": 123.0, "12,345,678": 12345678.0, "EUR 1.234,5": 1234.5, "-": None, "": None, "3M": 3e6, "1.5B": 1.5e9, "12 000": 12000.0, None: None,
    "1,234,56": None, "1,2,3": None, "1.234.56": 123456.0, "1,234,567.8": 1234567.8, "1.2,3.4": None, "1,2.3,4": None, "1,234.5.6": None, "12,5": 12.5, "1,2345": 12345.0, "5.": 5.0, ",5": 0.5, "+7": 7.0,
    "--5": None, "-(5)": -5.0, "1,234.5e3": 1234500.0, "(1.5K)": -1500.0, "2 %": 2.0, "5 CR": 5.0, "$-3": -3.0, "1-2": None, "ZZ 5": None, "1.000.000": 1000000.0, ",": None, "USD": None, "-$1,000-": -1000.0,
}


def test_numbers(spark):
    got = apply(spark, NUMBERS, parse_number)
    assert {k: (round(v, 6) if v is not None else None) for k, v in zip(NUMBERS, got)} == NUMBERS
    assert apply(spark, ["$1,000.50", "(3)", "x", None], simple_number) == [1000.5, -3.0, None, None]


DATES = {
    "20240115": "2024-01-15", "20240115T1030": "2024-01-15", "202402": "2024-02-01", "2024-3": "2024-03-01", "Mar 2024": "2024-03-01", "Q2 2024": "2024-04-01", "2024Q4": "2024-10-01",
    "2024-01-05T10:00": "2024-01-05", "31.12.2026 23:45": "2026-12-31", "13/02/24": "2024-02-13", "02/13/99": "1999-02-13", "5-Mar-2024": "2024-03-05", "March 5, 2024 10:30": "2024-03-05",
    "44562": "2022-01-01", "1704067200": "2024-01-01", "1704067200000": "2024-01-01", "n/a": None, "2024-02-30": None, "Foo 2024": None, "ORD-10001": None, "05/05/2024": "2024-05-05",
    "20240115 1030": "2024-01-15", "202401151030": "2024-01-15", "20240115T103059": "2024-01-15", "2024/3": "2024-03-01", "2024.1.5": "2024-01-05", "2024/01/05 10:00": "2024-01-05", "Q12024": "2024-01-01",
    "2024-q3": "2024-07-01", "2024 / Q2": "2024-04-01", "Q5 2024": None, "March-2024": "2024-03-01", "5 Mar, 24": "2024-03-05", "Mar 5 60": "1960-03-05", "Mar5, 2024": "2024-03-05", "5 March 2024 10:30 pm": "2024-03-05",
    "5 Mar 2024 T10:30": "2024-03-05", "5 Mar 2024T10:30:15": "2024-03-05", "5 Mar 2024 10": None, "13/13/2024": None, "31/04/2024": None, "1/2/202": None, "Sales 5 2024": None, "2024-13": None, "1 / 2 / 2024": None, "'2024-01-05": "2024-01-05",
}


def test_dates(spark):
    got = apply(spark, DATES, lambda c: parse_date(c, DatePolicy(serials=True, epochs=True)))
    assert {k: str(v) if v else None for k, v in zip(DATES, got)} == DATES


@pytest.mark.parametrize(
    "policy,want",
    [
        (DatePolicy("day-first"), "2025-04-03"), (DatePolicy("month-first"), "2025-03-04"), (DatePolicy(), None), (DatePolicy("contextual", "2025-03", "2025-03"), "2025-03-04"),
        (DatePolicy("contextual", "2025-01", "2025-12"), "2025-04-03"), (DatePolicy("contextual", "2025-01", "2025-12", "month-first"), "2025-03-04"),
    ],
)
def test_ambiguous_dates(spark, policy, want):
    (got,) = apply(spark, ["03/04/2025"], lambda c: parse_date(c, policy))
    assert (str(got) if got else None) == want


def test_date_helpers(spark):
    assert apply(spark, ["3/4/2025", "13/4/2025", "4/4/2025", "x"], is_ambiguous) == [True, False, False, False]
    assert apply(spark, ["44562", "19999", "80001"], serial_date) == [dt.date(2022, 1, 1), None, None]
    assert apply(spark, ["1704067200000000", "12"], epoch_date) == [dt.date(2024, 1, 1), None]
    row = spark.range(1).select(parts_date(F.lit("2025"), F.lit("2"), F.lit("29")).alias("a"), parts_date(F.lit("2024"), F.lit("2"), F.lit("29")).alias("b")).first()
    assert (row.a, row.b) == (None, dt.date(2024, 2, 29))


def test_text(spark):
    assert apply(spark, ["SÃ£o Paulo", "O’Connor ", "café​", " x ", "Ã bad 一", None], text.base_text) == ["São Paulo", "O’Connor", "café", "x", "Ã bad 一", ""]
    keys = apply(spark, ["São-Paulo.", "SAO_PAULO", "sao  paulo", "“O'Connor”", "a/b\\c"], text.match_key)
    assert keys == ["sao paulo"] * 3 + ["oconnor", "a b c"]
    assert apply(spark, ["", "N/A", "(blank)", "-", "x", None], text.missing) == [True, True, True, True, False, True]
    assert apply(spark, ["  a   b ", "", None], text.category_text) == ["a b", "Unknown", "Unknown"]
    assert apply(spark, ["PH", "U.S.", "Port"], text.is_abbreviation) == [True, True, False]
    assert apply(spark, ["web store", "E-Commerce", "NY"], lambda c: text.alias(c, "Sales Channel")) == ["Online", "Online", None]
    row = spark.range(1).select(text.similarity(F.lit("kitten"), F.lit("sitting")).alias("a"), text.similarity(F.lit(""), F.lit("")).alias("b")).first()
    assert abs(row.a - (1 - 3 / 7)) < 1e-12 and row.b == 1.0


def test_unicode_forms(spark):
    import unicodedata

    pieces = ["cafe\u0301", "Sa\u0303o Paulo", "e\u0302\u0301", "\u0438\u0306", "\u03b1\u0301", "x\u0301", "plain", "A\u030a B\u0307"]
    assert apply(spark, pieces, text.base_text) == [unicodedata.normalize("NFC", x) for x in pieces]
    wide = ["Ｌａｇｏｓ", "ﬁnance", "①", "Ａ１", None]
    assert apply(spark, wide, lambda c: text.unicode_form(c, "NFKD")) == [x and unicodedata.normalize("NFKD", x) for x in wide]
    assert apply(spark, ["o'connor-smith ltd", "ABC_d e.f", ""], text.title_case) == ["O'Connor-Smith Ltd", "Abc_d E.F", ""]


def test_adjustments(spark):
    assert [adjustment_mode(h, "amount") for h in ("VAT Amount", "VAT Rate", "Tax %", "Discount")] == ["amount", "percentage", "percentage", "amount"]
    row = spark.range(1).select(derived_amount(F.lit(2.0), F.lit(90.0), F.lit(None).cast("double"), "amount", F.lit(15.0), "amount").alias("a"), derived_amount(F.lit(2.0), F.lit(100.0), None, "amount", F.lit(7.5), "percentage").alias("b")).first()
    assert (row.a, row.b) == (195.0, 215.0)


def test_common_notations_are_read_without_the_long_way(spark):
    """A format character in front sends the same text the long way: same values."""
    from deltascope.functions import dates, numbers

    amounts = ["(1234.56)", "1.234,56", "912,34", "1234.56 DR", "EUR 1.234,56-", "'1234.56", "$1,234.50", "-$5.00", "(EUR 1,234)", "7 CR"]
    days = ["13/02/2024", "2/13/2024", "03/04/2024", "31/02/2024", "20240229", "20230229", "5 Mar 2024", "5-Foo-2024"]
    words, policies = ["ORD-123", "unclear", "N/A", "1-URGENT"], [DatePolicy(x) for x in ("ambiguous", "day-first", "month-first")]
    rows = spark.createDataFrame([(x,) for x in amounts + days + words], "t string")
    far = F.concat(F.lit("​"), F.col("t"))
    read = lambda c: F.struct(parse_number(c).alias("n"), *[parse_date(c, p).alias(f"d{i}") for i, p in enumerate(policies)])
    short = F.col("t").rlike(numbers._signed(numbers._COMMAS)) | F.col("t").rlike(numbers._signed(numbers._DOTS))
    quick = F.col("t").rlike(dates.WHOLE_DMY) | F.col("t").rlike(dates.WHOLE_NAMED) | F.col("t").rlike(r"^\d{8}$")
    got = {r.t: r for r in rows.select("t", read(F.col("t")).alias("a"), read(far).alias("b"), short.alias("short"), quick.alias("quick"), F.col("t").rlike(numbers.WORDS).alias("word")).collect()}
    assert all(r.a == r.b for r in got.values())
    assert all(got[x].short and got[x].a.n is not None for x in amounts) and all(got[x].quick for x in days) and got["ORD-123"].word and got["unclear"].word
