"""More registered queries: parsers on odd forms, cleaning and its merges, reviews, stores,
history and streams, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, labels, numbers, text
from ..operators import aggregate as agg
from ..operators import categories, clean, currency, profile, recalculate, review
from ..operators import explain as ex
from ..operators import questions as ask
from ..sources import payload, readers, store
from ..sources.scratch import materialise, scratch_path, spread
from ..sources.versioned import StoredImport
from .catalog import BASE_SQL, BY_CHANGE, FACTOR, INSIDE, SPIKED, _dirty_orders, _doubled, _explained, _profiles, _side, _spiked, query
from .star import DATE, DIMS, METRIC, ROWS_SQL, factors_sql, long_sql, revenue_rows, table

def no_text() -> Column:
    return F.lit(None).cast("string")


def pick(key: Column, *forms: Column) -> Column:
    """The form that the key's remainder names."""
    return F.element_at(F.array(*forms), (key % len(forms) + 1).cast("int"))


# parsers --------------------------------------------------------------------------


@query("""select o_orderkey, case o_orderkey % 10 when 0 then null when 1 then null when 2 then o_custkey * 1000.0 when 3 then o_custkey * 1000 + 0.5 when 4 then null
 when 5 then -o_custkey::double when 6 then null when 7 then o_custkey * 1000000.0 when 8 then null else o_custkey / 2.0 end as amount from orders""")
def parse_numbers_odd(spark, sf_dir):
    """Groups that do not end in threes, several decimal marks, letters, scales."""
    o, k = spread(table(spark, sf_dir, "orders")), F.col("o_orderkey")
    c = F.col("o_custkey").cast("string")
    forms = [
        F.concat(c, F.lit(",2,3")), F.concat(F.lit("1,234,"), F.lpad((F.col("o_custkey") % 100).cast("string"), 2, "0")), F.concat(c, F.lit("K")), F.concat(c, F.lit("000.50")),
        F.concat(F.lit("1.2,"), c, F.lit(".7")), F.concat(F.lit("-"), c), F.concat(c, F.lit("-"), c), F.concat(F.lit("USD "), c, F.lit("M")), F.concat(F.lit("x"), c), F.concat((F.col("o_custkey") / 2).cast("string"), F.lit(" %")),
    ]
    return o.select("o_orderkey", numbers.parse_number(pick(k, *forms)).alias("amount"))


@query("""select o_orderkey, case o_orderkey % 4 when 0 then o_totalprice when 1 then -o_totalprice when 2 then null else o_custkey::double end as amount from orders""")
def simple_numbers(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    shown = F.format_number("o_totalprice", 2)
    return o.select("o_orderkey", numbers.simple_number(pick(k, F.concat(F.lit("$"), shown), F.concat(F.lit("("), shown, F.lit(")")), F.lit("12a"), F.col("o_custkey").cast("string"))).alias("amount"))


@query("""select o_orderkey, case o_orderkey % 12 when 1 then date_trunc('month', o_orderdate)::date when 5 then null when 6 then null when 9 then null when 3 then date_trunc('quarter', o_orderdate)::date
 when 10 then date_trunc('quarter', o_orderdate)::date else o_orderdate::date end as order_date from orders""")
def parse_dates_matrix(spark, sf_dir):
    """Dates with times, names, quarters on either side, and texts that are no dates."""
    o, k, d = spread(table(spark, sf_dir, "orders")), F.col("o_orderkey"), F.col("o_orderdate")
    f = lambda form: F.date_format(d, form)
    forms = [
        f("yyyyMMdd'T'HHmm"), f("yyyy/M"), f("dd.MM.yyyy HH:mm"), F.concat(f("yyyy"), F.lit(" - Q"), F.quarter(d).cast("string")), f("d-MMM-yyyy"), F.concat(F.lit("ORD-"), f("yyyyMMdd")), F.concat(f("yyyy"), F.lit("-02-31")),
        f("MMMM d, yyyy hh:mm a"), f("yyyy.M.d"), F.concat(F.lit("Week "), f("d")), F.concat(F.lit("Q"), F.quarter(d).cast("string"), F.lit("/"), f("yyyy")), f("MMM d yyyy"),
    ]
    return o.select("o_orderkey", dates.parse_date(pick(k, *forms), dates.DatePolicy("day-first")).alias("order_date"))


@query("select o_orderkey, case when o_orderkey % 5 = 4 then null else (o_orderdate + interval 10 year)::date end as order_date from orders")
def excel_unix_dates(spark, sf_dir):
    """Spreadsheet serials, and Unix seconds, milli- and microseconds; small numbers are neither."""
    o, k, d = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.add_months(F.to_date("o_orderdate"), 120)
    s = F.datediff(d, F.lit("1970-01-01").cast("date")).cast("long") * 86400
    serial = F.datediff(d, F.lit("1899-12-30").cast("date")).cast("string")
    coded = pick(k, serial, s.cast("string"), (s * 1000).cast("string"), (s * 1_000_000).cast("string"), F.lit("2024"))
    return o.select("o_orderkey", dates.parse_date(coded, dates.DatePolicy(serials=True, epochs=True)).alias("order_date"))


@query("""select o_orderkey, day(o_orderdate) <= 12 and day(o_orderdate) <> month(o_orderdate) as unsure, o_orderdate::date as day_first,
 case when day(o_orderdate) > 12 then o_orderdate::date when day(o_orderdate) = month(o_orderdate) then o_orderdate::date end as undecided,
 case when day(o_orderdate) > 12 or day(o_orderdate) = month(o_orderdate) then o_orderdate::date else make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)) end as month_first from orders""")
def ambiguous_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    t = F.date_format("o_orderdate", "dd/MM/yyyy")
    of = lambda preference: dates.parse_date(t, dates.DatePolicy(preference))
    return o.select("o_orderkey", dates.is_ambiguous(t).alias("unsure"), of("day-first").alias("day_first"), of("ambiguous").alias("undecided"), of("month-first").alias("month_first"))


@query("""select o_orderkey, case when o_orderkey % 3 = 0 then null else o_orderdate::date end as order_date from orders""")
def dates_from_parts(spark, sf_dir):
    o, d = table(spark, sf_dir, "orders"), F.col("o_orderdate")
    month = F.when(F.col("o_orderkey") % 3 == 0, "13").otherwise(F.month(d).cast("string"))
    return o.select("o_orderkey", dates.parts_date(F.year(d).cast("string"), month, F.dayofmonth(d).cast("string")).alias("order_date"))


@query("""select o_orderkey, case when y < 70 then 2000 + y else 1900 + y end as year from (select *, o_orderkey % 100 as y from orders)""")
def two_digit_years(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    t = F.concat(F.lit("13/02/"), F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0"))
    return o.select("o_orderkey", F.year(dates.parse_date(t)).cast("long").alias("year"))


@query("""select p_partkey, p_name as base, lower(p_type) as normal, replace(lower(p_name), ' ', '') as compact, p_partkey % 4 = 0 as missing, trim(p_brand) as display,
 p_partkey % 3 = 0 as short, 1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type)) as similarity, upper(left(p_brand, 1)) || lower(substr(p_brand, 2)) || chr(39) || 'S' as title from (select * replace (lower(p_name) as p_name) from part)""")
def text_keys(spark, sf_dir):
    p, k = table(spark, sf_dir, "part").withColumn("p_name", F.lower("p_name")), F.col("p_partkey")
    titled = text.title_case(F.concat(F.upper("p_brand"), F.lit("'s")))
    return p.select(
        "p_partkey", text.base_text(F.concat(F.lit(" ​"), "p_name", F.lit("﻿ "))).alias("base"), text.normalise(F.regexp_replace("p_type", " ", "_- ")).alias("normal"),
        text.compact_key(F.concat("p_name", F.lit("!"))).alias("compact"), text.missing(pick(k, F.lit(" N/A "), F.col("p_name"), F.lit("0"), F.lit("none at all"))).alias("missing"),
        text.display_form(F.regexp_replace(F.concat("p_brand", F.lit(" ;.")), " ", "_")).alias("display"), text.is_abbreviation(pick(k, F.lit("U.S."), F.col("p_name"), F.lit("Abc"))).alias("short"),
        text.similarity(F.col("p_name"), F.col("p_type")).alias("similarity"), titled.alias("title"),
    )


@query("""select p_partkey, case p_partkey % 5 when 0 then p_brand || 'ção' when 1 then p_brand || ' café' when 2 then p_brand || '’s' when 3 then p_brand else p_brand || ' Ã b' end as repaired from part""")
def repaired_text(spark, sf_dir):
    """Texts that were read in the wrong encoding, and texts with combining marks."""
    p, b = table(spark, sf_dir, "part"), F.col("p_brand")
    broken = pick(F.col("p_partkey"), F.concat(b, F.lit("Ã§Ã£o")), F.concat(b, F.lit(" café")), F.concat(b, F.lit("â€™s")), F.concat(b, F.lit("‍")), F.concat(b, F.lit(" Ã b")))
    return p.select("p_partkey", text.base_text(broken).alias("repaired"))


@query("""select o_orderkey, case o_orderkey % 4 when 0 then 'Online' when 1 then 'In Store' when 2 then 'Online' end as channel, case o_orderkey % 2 when 0 then 'United States' end as country from orders""")
def controlled_aliases(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    a = text.alias(pick(k, F.lit("Web-Store"), F.lit("retail store"), F.lit("E-Commerce"), F.col("o_orderpriority")), "Sales Channel")
    return o.select("o_orderkey", a.alias("channel"), text.alias(pick(k, F.lit("United  States."), F.lit("France")), "Country").alias("country"))


@query("""select o_orderkey, '$' || format('{:,}', cast(round(abs(x)) as bigint)) as plain, case when x < 0 then '−' when x > 0 then '+' else '' end || '$' || format('{:,}', cast(round(abs(x)) as bigint)) as signed,
 n || case when n % 100 between 11 and 13 then 'th' when n % 10 = 1 then 'st' when n % 10 = 2 then 'nd' when n % 10 = 3 then 'rd' else 'th' end as ordinal, case when n = 1 then 'company' else 'companies' end as plural,
 strftime(o_orderdate, '%B ') || day(o_orderdate) || strftime(o_orderdate, ', %Y') as day from (select *, (o_custkey - 700) * 10.25 + 0.01 as x, o_orderkey % 130 as n from orders)""")
def amount_labels(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumns({"x": (F.col("o_custkey") - 700) * 10.25 + 0.01, "n": F.col("o_orderkey") % 130})
    x, n = F.col("x"), F.col("n")
    return o.select("o_orderkey", labels.plain_amount(x, "$").alias("plain"), labels.signed_amount(x, "$").alias("signed"), labels.ordinal(n).alias("ordinal"), labels.plural(F.lit("company"), n).alias("plural"), labels.readable_day(F.col("o_orderdate")).alias("day"))


@query("""select l_orderkey, l_linenumber, l_quantity * 2.5 - 1 + (l_quantity * 2.5) * 0.075 as with_rate, l_quantity * 2.5 + 3 as with_amount from lineitem""")
def adjusted_amounts(spark, sf_dir):
    """What a header's words make of a tax: VAT Rate is a share of the base, VAT Amount is added."""
    t, q = table(spark, sf_dir, "lineitem"), F.col("l_quantity").cast("double")
    mode = lambda h: numbers.adjustment_mode(h, "amount")
    rate = numbers.derived_amount(q, F.lit(2.5), F.lit(1.0), mode("Discount"), F.lit(7.5), mode("VAT Rate"))
    amount = numbers.derived_amount(q, F.lit(2.5), None, "amount", F.lit(3.0), mode("VAT Amount"))
    return t.select("l_orderkey", "l_linenumber", rate.alias("with_rate"), amount.alias("with_amount"))


# profiles and cleaning ------------------------------------------------------------


@query("""select * from (select 'Net Sales' as name, count(*) filter (o_orderkey % 50 <> 7) as known, count(*) filter (o_orderkey % 50 not in (7, 9)) as numbers, 0::bigint as dates from orders
 union all select 'Order Date', count(*), count(*) filter (o_orderkey % 4 = 3), count(*) from orders union all select 'Type', count(*), 0, 0 from orders)""")
def profile_rates(spark, sf_dir):
    """Rates over all rows, not only the first."""
    raw = readers.profile_sample(_dirty_orders(spark, sf_dir), None).select("Order Date", "Net Sales", "Type")
    rates = profile.column_rates(raw)  # a row of metadata a column
    return spark.createDataFrame([(c, r["n"], r["numbers"], r["dates_day"]) for c, r in rates.items()], "name string, known long, numbers long, dates long")


@query("""select o_orderkey as row_number, o_custkey * 2.0 - 1 as amount, o_orderdate::date as day from orders""")
def derived_columns(spark, sf_dir):
    """A metric of quantity, price and discount, and a date of three columns, both found by
    the profile of the table."""
    o, d = spread(table(spark, sf_dir, "orders")), F.col("o_orderdate")
    raw = o.select(F.col("o_orderkey").alias("row_number"), F.col("o_custkey").cast("string").alias("Quantity"), F.lit("$2.00").alias("Unit Price"), F.lit("1").alias("Discount"), F.year(d).cast("string").alias("Year"), F.month(d).cast("string").alias("Month"), F.dayofmonth(d).cast("string").alias("Day"))
    sample = raw.drop("row_number")
    found = [profile.Column(c, "number", 90) for c in ("Quantity", "Unit Price", "Discount")]
    columns = [*found, profile.derived_metric(found), profile.derived_date(sample)]
    return clean.clean(raw, columns).select("row_number", F.col(profile.DERIVED_AMOUNT).alias("amount"), F.col(profile.DERIVED_DATE).alias("day"))


@query("""select o_orderkey as row_number, upper(left(o_orderstatus, 1)) || ' Class' as kind, case when o_orderkey % 3 = 0 then 'New York' else 'Lagos' end as city, false as exact_duplicate
 from orders union all select o_orderkey + 10000000000, upper(left(o_orderstatus, 1)) || ' Class', case when o_orderkey % 3 = 0 then 'New York' else 'Lagos' end, true from orders where o_orderkey % 7 = 6""")
def simple_clean_rows(spark, sf_dir):
    """The interactive mode: title case, regional names, copies of raw rows."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    raw = o.select(k.alias("row_number"), k.cast("string").alias("Number"), F.concat(F.lit(" "), F.lower("o_orderstatus"), F.lit("_class")).alias("kind"), F.when(k % 3 == 0, pick(k, F.lit("ny"), F.lit("NEW  YORK"), F.lit("n y c"))).otherwise(F.lit("LAGOS")).alias("city"))
    again = raw.where(F.col("row_number") % 7 == 6).withColumn("row_number", F.col("row_number") + 10_000_000_000)
    columns = [profile.Column("Number", "identifier", 82), profile.Column("kind", "category", 90), profile.Column("city", "category", 90)]
    return clean.simple_clean(raw.unionByName(again), columns).select("row_number", "kind", "city", "exact_duplicate")


CLEAN_LABELS = ("Northern Lights Outfitters", "Blue Harbor Logistics", "Copper Canyon Foods", "Silver Maple Energy", "Golden Gate Textiles")
_LABEL = " ".join(f"when {i} then '{x}'" for i, x in enumerate(CLEAN_LABELS))


def _companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with one of five companies, one in forty with a letter missing."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    name = pick(k, *map(F.lit, CLEAN_LABELS))
    typo = F.concat(F.substring(name, 1, 5), F.substring(name, 7, 40))
    return o.select(k.alias("row_number"), F.when(F.shiftright(k, 3) % 40 == 7, typo).otherwise(name).alias("company"), F.col("o_totalprice").alias("amount"), F.to_date("o_orderdate").alias("day"))


@query(f"select o_orderkey as row_number, case o_orderkey % 5 {_LABEL} end as company from orders")
def fuzzy_merged_rows(spark, sf_dir):
    return categories.reconcile(_companies(spark, sf_dir), ["company"]).select("row_number", "company")


@query(f"""select count(distinct company) as groups, count(*) as cells from (select case o_orderkey % 5 {_LABEL} end as company from orders where (o_orderkey >> 3) % 40 = 7)""")
def reconciliation_counts(spark, sf_dir):
    rows = _companies(spark, sf_dir).withColumn("changes", F.array().cast(f"array<{review.CHANGE}>"))
    return categories.reconciliation_counts(categories.reconcile(rows, ["company"]))


@query(f"""with v as (select case o_orderkey % 5 {_LABEL} end as company, o_totalprice as amount, o_orderkey as n from orders),
k as (select *, company || '|' || amount as key from v) select n as row_number, row_number() over (partition by key order by n) > 1 as same_as_earlier from k""")
def signatures_after_merge(spark, sf_dir):
    """Signatures of merged rows: rows that a merge made equal have the same one."""
    rows = _companies(spark, sf_dir).drop("day")
    signed = rows.withColumn("row_signature", review.row_signature(["company", "amount"]))
    merged = categories.reconcile(signed, ["company"], signed=["company", "amount"])
    return review.exact_duplicates(merged, None).select("row_number", F.col("exact_duplicate").alias("same_as_earlier"))


@query("""select cast(o_orderkey as bigint) as row_number, case when o_orderkey % 6 in (0, 1) then 'credit card / card (merged)' when o_orderkey % 6 = 2 then 'car' else o_orderpriority end as pay from orders""")
def containment_decided(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    rows = o.select(k.cast("long").alias("row_number"), F.when(k % 6 == 0, "card").when(k % 6 == 1, "credit card").when(k % 6 == 2, "car").otherwise(F.col("o_orderpriority")).alias("pay"))
    found = materialise(categories.containment(rows, ["pay"]), "proposals")
    decisions = found.where("contained = 'card'").select("id", F.lit("merge").alias("action"), F.lit("credit card / card (merged)").alias("label"))
    return categories.decide_containment(rows, found, decisions)[0].select("row_number", "pay")


@query("""select 'pending' as status, count(distinct o_orderkey % 2) - 1 as n from orders union all select 'merged', count(distinct o_orderkey % 2) - 1 from orders""")
def containment_kept(spark, sf_dir):
    """Stored proposals: whole ones stay as they were decided, malformed ones go."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    rows = o.select(F.when(k % 2 == 0, "debit card").otherwise("card").alias("pay"))
    found = materialise(categories.containment(rows, ["pay"]), "proposals")
    gone = found.select(F.lit("old").alias("id"), "column", F.lit("a").alias("contained"), F.lit("a b").alias("containing"), "contained_n", "containing_n", F.lit("merged").alias("status"), "label")
    bad = gone.withColumns({"id": F.lit("bad"), "status": F.lit("odd")}).unionByName(gone.withColumn("contained", F.lit(" ")))
    return categories.containment(rows, ["pay"], found.unionByName(gone).unionByName(bad)).groupBy("status").agg(F.count("*").alias("n"))


@query("""select case when sum(5 + 4) > sum(1) then 'EUR' else 'USD' end as code, 'detected' as source from orders""")
def currency_detected(spark, sf_dir):
    """The code with most votes among the cells of the metric and of a currency column."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("$"), F.col("o_totalprice").cast("string")).alias("Total"), F.lit("eur").alias("Currency Code"), F.lit("GBP").alias("Note"))
    return currency.detect(currency.voting_cells(o, "Total"))


@query("""select case min(o_orderkey) % 3 when 0 then '€' when 1 then '₦' else '£' end as symbol from orders""")
def currency_symbol_seen_first(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    rows = o.select(k.alias("row_number"), F.concat(pick(k, F.lit("€"), F.lit("₦"), F.lit("£")), F.col("o_totalprice").cast("string")).alias("v"))
    return currency.first_symbol(rows, ["v"])


# reviews --------------------------------------------------------------------------


@query("""select min(event_id) over (partition by event_type, cast(ts as date), user_id) as first, event_id as later from events
 qualify event_id <> first""")
def duplicate_links(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("row_number"), "event_type", F.col("ts").cast("date").alias("day"), "user_id")
    return review.duplicate_links(e, "event_type", "day", "user_id")


@query("""with e as (select event_id, count(*) over w as n, min(event_id) over w as first, nth_value(event_id, 2) over w as second from events
 window w as (partition by event_type, cast(ts as date), user_id order by event_id rows between unbounded preceding and unbounded following))
select event_id as row_number, 'Shares event_type, date, and KPI value with row ' || case when event_id = first then second else first end || '; kept for your review.' as message from e where n > 1""")
def duplicate_messages(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("row_number"), "event_type", F.col("ts").cast("date").alias("day"), "user_id", F.array().cast(f"array<{review.ISSUE}>").alias("issues"))
    out = review.possible_duplicates(e, "event_type", "day", "user_id")
    return out.where("possible_duplicate").select("row_number", F.col("issues")[0]["message"].alias("message"))


@query("""select o_orderkey as row_number, o_orderkey % 3 = 1 as excluded, o_orderkey % 4 <> 0 as possible_duplicate, case o_orderkey % 5 when 0 then 1.5 when 1 then o_custkey::double when 2 then 7 when 3 then 5 else o_totalprice end as amount,
 case o_orderkey % 5 when 0 then 0 when 1 then 2 when 2 then 1 when 3 then 2 else 1 end as n_changes, case when o_orderkey % 3 = 2 then 0 else 1 end + case when o_orderkey % 4 = 0 then 0 else 1 end as n_issues from orders""")
def ordered_edits(spark, sf_dir):
    """Exclude and restore, keep, and edits and undos of a cell, in the order of their numbers."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    issue = lambda t: F.struct(F.lit(t).alias("type"), no_text().alias("column"), F.lit("m").alias("message"))
    logged = F.array(review.change("amount", F.lit("1.5"), F.col("o_totalprice"), "x"))
    rows = o.select(k.alias("row_number"), F.lit(False).alias("excluded"), F.lit(True).alias("possible_duplicate"), F.col("o_totalprice").cast("double").alias("amount"), logged.alias("changes"), F.array(issue("exact-duplicate"), issue("possible-duplicate")).alias("issues"))
    edit = lambda n, action, column=None, value=no_text(): F.struct(F.lit(n).alias("seq"), F.lit(action).alias("action"), F.lit(column).cast("string").alias("column"), value.cast("string").alias("value"))
    amount = lambda n, v: edit(n, "edit", "amount", v)
    some = [
        F.when(k % 3 == 1, F.array(edit(1, "exclude"))), F.when(k % 3 == 2, F.array(edit(2, "restore"), edit(1, "exclude"))), F.when(k % 4 == 0, F.array(edit(1, "keep"))),
        F.when(k % 5 == 0, F.array(edit(1, "undo", "amount"))), F.when(k % 5 == 1, F.array(amount(1, F.col("o_custkey")))), F.when(k % 5 == 2, F.array(amount(2, F.lit("7")), edit(1, "undo", "amount"), amount(3, F.lit("8")), edit(4, "undo", "amount"))),
        F.when(k % 5 == 3, F.array(amount(2, F.lit("6")), amount(1, F.lit("5")), edit(3, "undo", "amount"))),
    ]
    edits = o.select(k.alias("row_number"), F.inline(F.flatten(F.filter(F.array(*some), lambda x: x.isNotNull()))))
    out = review.apply_edits(rows, edits, {"amount": "number"})
    return out.select("row_number", "excluded", "possible_duplicate", "amount", F.size("changes").alias("n_changes"), F.size("issues").alias("n_issues"))


@query("""select o_orderkey as row_number, case when o_orderkey % 3 = 0 then 'ny' else 'New York' end as city, case when o_orderkey % 3 = 0 then 0 else 1 end as n_changes from orders""")
def reverted_changes(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    old = F.when(k % 3 == 0, "ny").otherwise("new york")
    rows = o.select(k.alias("row_number"), F.lit("New York").alias("city"), F.array(review.change("city", old, F.lit("New York"), categories.ALIAS)).alias("changes"))
    out = review.revert_changes(rows, "city", categories.ALIAS, "^[a-z]{2}$")
    return out.select("row_number", "city", F.size("changes").alias("n_changes"))


CALM = f"with {SPIKED}, calm_rows as (select * from flagged where not is_outlier)"


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _spiked(spark, sf_dir).withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    return review.outliers(rows, ["amount"])


@query(f"""{CALM}, m as (select * from calm_rows), months as (select period, sum(amount) as total from m group by period), span as (select max(period) as c, min(period) as p from (select period from months order by period desc limit 2))
select segment, cast(sum(case when period = p then amount else 0 end) as double) as previous, cast(sum(case when period = c then amount else 0 end) as double) as current from (select period, amount, priority as segment from m) join span on period in (p, c) group by segment""")
def questions_without_outliers(spark, sf_dir):
    """Factors of the rows that questions are answered on: leaving the flagged ones out
    changes the explanation of these rows."""
    rows = materialise(_flagged(spark, sf_dir), "flagged")
    found = ex.outlier_sensitivity(rows, "amount", "order_date", ["priority", "status"]).withColumn("explanation_changed", F.lit(True))
    used = agg.comparison_rows(rows, found)
    head = ex.headline(agg.segment_totals(used, "amount", "order_date", ["priority"]))
    return agg.two_period_factors(used, "amount", "order_date", ["priority"], head).select("segment", "previous", "current")


@query("""with r as (select strftime(o_orderdate, '%Y-%m') as period, case when o_orderkey % 20 = 3 then 1000 else o_totalprice end as amount from orders where o_orderkey % 20 <> 5),
months as (select period, cast(sum(cast(amount as decimal(18,2))) as double) as total from r group by period order by period desc limit 2)
select (select max(period) from months) as current_period, (select total from months order by period desc limit 1) as current_total, (select total from months order by period limit 1) as previous_total""")
def recalculated(spark, sf_dir):
    """The headline after a review that edits one row in twenty and leaves one in twenty out."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    rows = o.select(
        k.alias("row_number"), F.to_date("o_orderdate").alias("Order Date"), F.col("o_totalprice").cast("double").alias("Sales"), F.col("o_orderpriority").alias("Segment"), F.lit(False).alias("excluded"), F.lit(False).alias("exact_duplicate"),
        F.lit(False).alias("possible_duplicate"), F.lit(False).alias("is_outlier"), F.array().cast("array<string>").alias("outlier_columns"), none(review.CHANGE).alias("changes"), none(review.ISSUE).alias("issues"),
    )
    columns = [profile.Column("Order Date", "date", 99), profile.Column("Sales", "number", 99, candidate="yes", selected=True), profile.Column("Segment", "category", 90)]
    edits = o.where(k % 20 == 3).select(k.alias("row_number"), F.lit("edit").alias("action"), F.lit("Sales").alias("column"), F.lit("$1,000.00").alias("value"))
    edits = edits.unionByName(o.where(k % 20 == 5).select(k.alias("row_number"), F.lit("exclude").alias("action"), no_text().alias("column"), no_text().alias("value")))
    head = recalculate.recalculate(rows, columns, edits)["headline"]
    return head.select("current_period", F.round("current_total", 2).alias("current_total"), F.round("previous_total", 2).alias("previous_total"))


REVIEWED = """with r as (select strftime(o_orderdate, '%Y-%m') as period, cast(case when o_orderkey % 20 = 3 then 1000 else o_totalprice end as decimal(18,2)) as amount,
 case when o_orderkey % 50 = 7 then 'Urgent' else o_orderpriority end as priority, o_orderstatus as status from orders where o_orderkey % 20 <> 5 or o_orderkey % 50 = 15),
long as (select period, amount, 'Segment' as dimension, priority as segment from r union all select period, amount, 'Status', status from r),
span as (select max(period) as c, min(period) as p from (select distinct period from r order by period desc limit 2)),
f as (select dimension, segment, sum(case when period = c then amount else -amount end) as impact from long join span on period in (p, c) group by 1, 2)"""


@query(f"""{REVIEWED}, h as (select sum(case when period = c then amount else -amount end) as change from r join span on period in (p, c))
select dimension, segment, cast(impact as double) as impact from f, h where impact <> 0 and sign(impact) = sign(change) order by abs(impact) desc, dimension, segment limit 5""")
def recalculated_causes(spark, sf_dir):
    """Causes after two rounds of edits to a stored import, from kept totals: one row in twenty
    edited, one in twenty left out (some of these taken in again), one in fifty moved."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    rows = o.select(
        k.alias("row_number"), F.to_date("o_orderdate").alias("Order Date"), F.col("o_totalprice").cast("double").alias("Sales"), F.col("o_orderpriority").alias("Segment"), F.col("o_orderstatus").alias("Status"),
        *[F.lit(False).alias(c) for c in ("excluded", "exact_duplicate", "possible_duplicate", "is_outlier")], none("string").alias("outlier_columns"), none(review.CHANGE).alias("changes"), none(review.ISSUE).alias("issues"),
    )
    columns = [profile.Column("Order Date", "date", 99), profile.Column("Sales", "number", 99, candidate="yes", selected=True), profile.Column("Segment", "category", 90), profile.Column("Status", "category", 90)]
    stored = StoredImport(spark, scratch_path(spark, "import"), "orders")
    stored.write(rows)
    edit = lambda where, action, column, value: o.where(where).select(k.alias("row_number"), F.lit(action).alias("action"), F.lit(column).cast("string").alias("column"), F.lit(value).cast("string").alias("value"))
    kept = recalculate.kept_totals(rows, "Sales", "Order Date", ["Segment", "Status"])
    first = edit(k % 20 == 3, "edit", "Sales", "$1,000.00").unionByName(edit(k % 20 == 5, "exclude", None, None))
    kept = recalculate.recalculate_edits(stored, kept, first, columns)["kept"]
    second = edit(k % 50 == 7, "edit", "Segment", "Urgent").unionByName(edit((k % 20 == 5) & (k % 50 == 15), "restore", None, None))
    return recalculate.recalculate_edits(stored, kept, second, columns)["causes"].select("dimension", "segment", F.col("impact").cast("double").alias("impact"))


@query("""with r as (select o_orderkey as row_number, case when o_orderkey % 3 = 1 then 'edited' else o_orderpriority end as label from orders union all select -1 - c_custkey, 'added' from customer)
select row_number, label, (select count(*) from r) as total_rows from r order by row_number limit 50 offset 2000""")
def stored_page(spark, sf_dir):
    """A page of a stored import after upserts that change rows and add some before the first."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    stored = StoredImport(spark, scratch_path(spark, "import"), "orders")
    stored.write(o.select(k.cast("long").alias("row_number"), F.col("o_orderpriority").alias("label")), 6)
    stored.upsert(o.where(k % 3 == 1).select(k.cast("long").alias("row_number"), F.lit("edited").alias("label")))
    stored.upsert(table(spark, sf_dir, "customer").select((-1 - F.col("c_custkey")).cast("long").alias("row_number"), F.lit("added").alias("label")))
    return stored.page(40, 50)


# questions and history ------------------------------------------------------------


@query(f"""{BASE_SQL}, {INSIDE}, {factors_sql(long_sql('inside', ['customer_name']), 'f2')} select 'segment' as role, {FACTOR} from factors where dimension = 'region' and segment = 'ASIA'
union all (select 'entity', {FACTOR} from f2 where impact <> 0 order by {BY_CHANGE} limit 3)""")
def explained_segment(spark, sf_dir):
    e, rows = _explained(spark, sf_dir), revenue_rows(spark, sf_dir)
    return ask.explain_segment(rows, e["factors"], METRIC, DATE, e["headline"], "customer_name", "region", "ASIA")


@query(f"""{BASE_SQL}, {INSIDE}, {factors_sql(long_sql('inside', ['customer_name']), 'f2')}, {factors_sql(long_sql('inside', [d for d in DIMS if d != 'region']), 'f3')}
select * from (select 'entity' as kind, segment as name, impact from f2 where impact <> 0 order by {BY_CHANGE} limit 2) union all select * from (select 'overlap', segment, impact from f3 where impact <> 0 order by {BY_CHANGE} limit 2)""")
def evidence_of_segment(spark, sf_dir):
    rows = revenue_rows(spark, sf_dir)
    head = ex.headline_of(rows, METRIC, DATE)
    found = ask.evidence(rows, METRIC, DATE, DIMS, head, "customer_name", "region", "ASIA")
    part = lambda name, kind: found[name].select(F.lit(kind).alias("kind"), F.col("segment").alias("name"), "impact")
    return part("entities", "entity").unionByName(part("overlaps", "overlap"))


@query(f"{BASE_SQL} select count(*) as broken from factors where dimension = 'region' and lower(segment) = 'asia'")
def checked_result(spark, sf_dir):
    """Rows of a result that break what was asked: a segment that was to be left out."""
    f = _explained(spark, sf_dir)["factors"].where("dimension = 'region'")
    return ask.check_result(f, "region", [" Asia "]).agg(F.count("*").alias("broken"))


RUNS_SQL = """runs as (select o_orderpriority as metric_column, o_orderstatus as segment, 'status' as dimension, strftime(o_orderdate, '%Y-%m') as period, min(o_orderkey) as created from orders group by 1, 2, 4)"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    keys = [F.col("o_orderpriority").alias("metric_column"), F.col("o_orderstatus").alias("segment"), F.lit("status").alias("dimension"), F.date_format("o_orderdate", "yyyy-MM").alias("current_period")]
    return o.groupBy(*keys).agg(F.min("o_orderkey").alias("created_at"))


@query(f"""with {RUNS_SQL}, last_ as (select max(period) as p from runs) select metric_column, dimension, segment, c.period as current_period, max_by(r.period, r.created) as earlier_period
from runs c join runs r using (metric_column, dimension, segment) where c.period = (select p from last_) and r.period <> c.period group by all""")
def recurring_patterns(spark, sf_dir):
    runs = materialise(_runs(spark, sf_dir), "runs")
    last = runs.agg(F.max("current_period").alias("_p"))
    now = runs.join(F.broadcast(last), F.col("current_period") == F.col("_p")).select("metric_column", "dimension", "segment", "current_period")
    return ask.recurring_pattern(now, runs).select("metric_column", "dimension", "segment", "current_period", "earlier_period")


@query(f"with {RUNS_SQL} select metric_column, segment, period as current_period from runs order by created desc, period desc limit 10")
def run_history(spark, sf_dir):
    path = scratch_path(spark, "history")
    runs = _runs(spark, sf_dir)
    for k in (0, 1):
        store.append_run(runs.where(F.col("created_at") % 2 == k), path)
    return store.recent_runs(spark, path).select("metric_column", "segment", "current_period")


# sources, stores, streams ---------------------------------------------------------


@query("""select o_orderkey::varchar as id, case when o_orderkey % 3 = 0 then ' padded, "quoted" ' else o_orderpriority end as label, case when o_orderkey % 4 <> 0 then o_totalprice end as price from orders""")
def csv_round_trip(spark, sf_dir):
    """A table written as CSV and read as strings: quotes, commas and spaces as they stand."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    path = scratch_path(spark, "orders") + ".csv"
    rows = o.select(k.cast("string").alias("id"), F.when(k % 3 == 0, ' padded, "quoted" ').otherwise(F.col("o_orderpriority")).alias("label"), F.when(k % 4 != 0, F.col("o_totalprice").cast("string")).alias("price"))
    rows.write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    got = readers.check_source(readers.read_table(spark, path, multi_line=False))
    return got.select("id", "label", F.col("price").cast("double").alias("price"))


@query("""with d as (select doc_id, regexp_replace(text, chr(13) || chr(10), chr(10), 'g') as t, lang from documents)
select doc_id, row_number() over (order by doc_id) as row_number, length(t) as n_chars, md5(t) as digest, lang from d""")
def csv_quoted(spark, sf_dir):
    """Whole texts, with their line feeds, quotes and commas, written as CSV and read back by
    as many tasks as there are blocks; rows keep their numbers."""
    path = scratch_path(spark, "texts") + ".csv"
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    got = readers.read_numbered(spark, path)
    return got.select(F.col("doc_id").cast("long").alias("doc_id"), "row_number", F.char_length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"), "lang")


@query("select o_orderkey as id, row_number() over (order by o_orderkey) as row_number from orders")
def numbered_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).repartitionByRange(7, "id").sortWithinPartitions("id")
    return readers.with_row_number(o).select("id", "row_number")


@query("""select o_orderkey as row_number, case when o_orderkey % 10 = 1 then -1.0 else o_totalprice end as amount from orders""")
def stored_rows(spark, sf_dir):
    """Rows stored under two imports, one row in ten of the first replaced, the second dropped."""
    path = scratch_path(spark, "rows")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_number"), F.col("o_totalprice").cast("double").alias("amount"))
    store.write_rows(rows, path, "one")
    store.write_rows(rows.limit(3), path, "two")
    store.upsert_rows(spark, rows.where("row_number % 10 = 1").withColumn("amount", F.lit(-1.0)), path, "one")
    store.reset_import(spark, path, "two")
    return store.read_rows(spark, path, "one")


@query("select o_orderkey as row_number, o_totalprice as amount from orders where o_orderkey = 33")
def stored_row(spark, sf_dir):
    path = scratch_path(spark, "rows")
    store.write_rows(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_number"), F.col("o_totalprice").alias("amount")), path, "one")
    return store.get_row(spark, path, "one", 33)


@query("""select o_orderkey as id, case when o_orderkey % 3 = 0 then o_custkey end as customer, case when o_orderkey % 3 = 1 then 2 else 0 end as n from orders""")
def json_payloads(spark, sf_dir):
    """Payloads as JSON text: objects, arrays, and neither."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    one = F.to_json(F.struct(F.col("o_custkey").alias("c")))
    text_ = pick(k, one, F.concat(F.lit("["), one, F.lit(", "), one, F.lit("]")), F.lit("12"))
    return o.select(k.alias("id"), payload.as_record(text_, "c long")["c"].alias("customer"), F.size(payload.as_array(text_, "struct<c:long>")).cast("long").alias("n"))


@query("""select event_type as segment, count(distinct (user_id, event_type, value, cast(ts as date))) as n from events group by event_type""")
def stream_duplicates(spark, sf_dir):
    """Micro-batches that bring rows again which earlier batches stored."""
    from ..streaming import ingest

    own = _doubled(spark, sf_dir).select("row_number", "user_id", "event_type", "value", F.col("ts").cast("date").alias("day"))
    source, out = scratch_path(spark, "stream-in"), scratch_path(spark, "stream-out")
    own.repartition(3, "row_number").write.parquet(source)
    run = ingest.ingest(ingest.file_stream(spark, source, own.schema), out, scratch_path(spark, "stream-check"), ["user_id", "event_type", "value", "day"])
    run.awaitTermination()
    return spark.read.parquet(out).where("not exact_duplicate").groupBy(F.col("event_type").alias("segment")).agg(F.count("*").alias("n"))
