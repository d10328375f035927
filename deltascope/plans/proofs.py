"""Queries that decide something from the data and show what they decided, each with its SQL:
dates corroborated by their parts, another metric, aliases, cards, candidates, confidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import DatePolicy, parse_date
from ..operators import aggregate as agg
from ..operators import categories, clean, profile, recalculate, review
from ..operators import explain as ex
from ..operators import questions as ask
from ..sources.ranks import RankStore
from ..sources.scratch import materialise, scratch_path
from .catalog import BASE_SQL, ORACLES, _explained, query
from .reviews import _flagged
from .star import DATE, DIMS, METRIC, revenue_rows, table


@query("""with r as (select o_orderkey as row_number, cast(o_orderdate as date) as d, cast(case when o_orderkey % 7 = 3 then o_orderdate + interval 40 day else o_orderdate end as date) as parts from orders),
s as (select *, day(d) <= 12 and month(d) <= 12 and day(d) <> month(d) as unsure from r)
select row_number, case when unsure then parts else d end as day, case when not unsure and d <> parts then 1 else 0 end as conflicts,
 case when unsure then 'Resolved ambiguous date from Year/Month/Day columns' else 'Standardised date' end as reason from s""")
def corroborated_dates(spark, sf_dir):
    """Numeric dates beside columns of year, month and day: the parts decide where the date
    alone does not, and what differs from them otherwise is kept and flagged."""
    o, d = table(spark, sf_dir, "orders"), F.to_date("o_orderdate")
    parts = F.when(F.col("o_orderkey") % 7 == 3, F.date_add(d, 40)).otherwise(d)
    raw = o.select(F.col("o_orderkey").alias("row_number"), F.date_format(d, "d/M/yyyy").alias("Order Date"), F.year(parts).cast("string").alias("Year"), F.month(parts).cast("string").alias("Month"), F.dayofmonth(parts).cast("string").alias("Day"))
    columns = [profile.Column("Order Date", "date", 99, policy=DatePolicy("ambiguous")), profile.Column(profile.DERIVED_DATE, "date", 90, parts=("Year", "Month", "Day"))]
    out = clean.clean(raw, columns)
    conflict = F.size(F.filter("issues", lambda i: i["type"] == "ambiguous-date"))
    reason = F.filter("changes", lambda c: c["column"] == "Order Date")[0]["reason"]
    return out.select("row_number", F.col("Order Date").alias("day"), conflict.alias("conflicts"), reason.alias("reason"))


@query(f"""with s as ({ORACLES["outlier_sensitivity"]}), o as (select o_totalprice * (1 + 9 * (o_orderkey % 100 // 99)) as amount from orders)
select (select explanation_changed from s) as changed, (select count(*) from o) - case when (select explanation_changed from s) then (select outlier_rows from s) else 0 end as n""")
def comparison_decided(spark, sf_dir):
    """How many rows questions are answered on, as the sensitivity to outliers decides."""
    rows = materialise(_flagged(spark, sf_dir), "flagged")
    found = materialise(ex.outlier_sensitivity(rows, "amount", "order_date", ["priority", "status"]), "sensitivity")
    used = agg.comparison_rows(rows, found).agg(F.count("*").alias("n"))
    return found.select(F.col("explanation_changed").alias("changed")).join(F.broadcast(used))  # one row each


@query("""with r as (select o_orderkey as row_number, cast(o_orderdate as date) as d from orders)
select row_number, case when row_number % 3 = 1 and day(d) <= 12 then make_date(year(d), day(d), month(d)) else d end as day from r""")
def lenient_dates(spark, sf_dir):
    """Dates as the interactive mode reads them: days first wherever both orders are possible."""
    o, k, d = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.to_date("o_orderdate")
    texts = F.when(k % 3 == 0, F.date_format(d, "d/M/yyyy")).when(k % 3 == 1, F.date_format(d, "M/d/yyyy")).otherwise(F.date_format(d, "dd.MM.yy HH:mm"))
    rows = o.select(k.alias("row_number"), texts.alias("t"))
    # written before the parse, so that the forms are data and not part of the plan
    return materialise(rows, "dates").select("row_number", parse_date(F.col("t"), DatePolicy("contextual", fallback="day-first")).alias("day"))


def _sold(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    rows = o.select(
        F.col("o_orderkey").alias("row_number"), F.to_date("o_orderdate").alias("Order Date"), F.col("o_totalprice").cast("double").alias("Sales"), (F.col("o_custkey") % 50).cast("double").alias("Units"), F.col("o_orderpriority").alias("Segment"),
        *[F.lit(False).alias(c) for c in ("excluded", "exact_duplicate", "possible_duplicate", "is_outlier")], none("string").alias("outlier_columns"), none(review.CHANGE).alias("changes"), none(review.ISSUE).alias("issues"),
    )
    return rows, [profile.Column("Order Date", "date", 99), profile.Column("Sales", "number", 99, candidate="yes", selected=True), profile.Column("Units", "number", 99, candidate="yes"), profile.Column("Segment", "category", 90)]


@query("""with r as (select strftime(o_orderdate, '%Y-%m') as period, o_custkey % 50 as units, o_orderpriority as segment from orders), span as (select max(period) as c, min(period) as p from (select distinct period from r order by period desc limit 2)),
f as (select segment, sum(case when period = c then units else -units end) as impact from r join span on period in (p, c) group by segment), h as (select sum(impact) as change from f)
select 'Units' as metric_column, segment, cast(impact as double) as impact, cast(change as double) as change from f, h where impact <> 0 and (sign(impact) = sign(change) or change = 0) order by abs(impact) desc, segment limit 5""")
def metric_switched(spark, sf_dir):
    """Causes after another metric was chosen."""
    rows, columns = _sold(spark, sf_dir)
    found = recalculate.recalculate(rows, columns, metric="Units")
    return found["causes"].select("segment", "impact").join(F.broadcast(found["headline"].select("metric_column", "change")))


@query("""select o_orderkey as row_number, ['Online', 'In Store', 'Online', 'Catalogue'][o_orderkey % 4 + 1] as channel, case when o_orderkey % 3 = 0 then 'Crypto' else 'Bank ' || (o_orderkey % 3) end as industry from orders""")
def alias_merged_rows(spark, sf_dir):
    """Values that controlled aliases of their column name otherwise."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    channel = F.element_at(F.array(*map(F.lit, ("web store", "Retail-Store", "E-Commerce", "Catalogue"))), (k % 4 + 1).cast("int"))
    industry = F.when(k % 3 == 0, F.when(k % 2 == 0, "Crypto Currency").otherwise("crypto")).otherwise(F.concat(F.lit("Bank "), (k % 3).cast("string")))
    rows = o.select(k.alias("row_number"), channel.alias("channel"), industry.alias("industry"))
    return categories.reconcile(rows, ["channel", "industry"], fuzzy=False)


@query(f"{BASE_SQL} select dimension, segment, impact / 2 as impact, current_total, current_total - impact / 2 as if_flat, change - impact / 2 as change_if_flat from factors, head where dimension = 'region' and segment = 'ASIA'")
def card_counterfactual(spark, sf_dir):
    """A counterfactual of a segment that is shown on a card: the card's figures count."""
    e = materialise_all(_explained(spark, sf_dir), "factors", "headline")
    cards = e["factors"].where("dimension = 'region'").withColumn("impact", F.col("impact") / 2)
    return ask.counterfactual(e["factors"], e["headline"], "region", "ASIA", cards)


def materialise_all(found: dict, *names: str) -> dict:
    return found | {n: materialise(found[n], n) for n in names}


@query(f"with c as ({ORACLES['material_causes']}) select coalesce(cast(round(sum(confidence * share) / sum(share)) as int), 50) as confidence from c")
def overall_confidence(spark, sf_dir):
    e = _explained(spark, sf_dir)
    return ex.overall_confidence(ex.material_causes(e["factors"], e["headline"]))


@query("""with c as (select count(*) as n, count(o_orderdate) as days, count(try_cast(o_totalprice as double)) as prices, count(year(o_orderdate)) as years, count(distinct o_orderpriority) as priorities from orders)
select 'Order Day' as name, case when days >= 0.72 * n then 'date' end as kind, false as candidate, false as selected from c union all select 'Revenue', case when prices >= 0.72 * n then 'number' end, true, true from c
union all select 'Fiscal Year', case when years >= 0.72 * n then 'number' end, false, false from c union all select 'Segment', case when priorities < 0.9 * n then 'category' end, false, false from c""")
def interactive_candidates(spark, sf_dir):
    """Columns as the interactive mode sees them: a year beside a date is no metric."""
    o, d = table(spark, sf_dir, "orders"), F.to_date("o_orderdate")
    raw = o.select(F.date_format(d, "yyyy-MM-dd").alias("Order Day"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("Revenue"), F.year(d).cast("string").alias("Fiscal Year"), F.col("o_orderpriority").alias("Segment"))
    columns = profile.profile(raw, strict=False)
    chosen = profile.metric_of(columns)
    rows = [(c.name, c.kind, bool(c.candidate), chosen is not None and c.name == chosen.name) for c in columns]
    return spark.createDataFrame(rows, "name string, kind string, candidate boolean, selected boolean")


@query("""with v as (select 'price' as "column", cast(o_totalprice as double) as value from orders union all select 'customer', o_custkey from orders),
q as (select "column", count(*) as n, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from v group by 1)
select "column", n, q1, q3, q1 - 1.5 * (q3 - q1) as low, q3 + 1.5 * (q3 - q1) as high from q""")
def batch_quartiles(spark, sf_dir):
    """Outlier bounds of orders that came in three batches, one of them twice."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    ranks = RankStore(spark, scratch_path(spark, "ranks"), 500)
    for batch in (0, 1, 2, 1):
        own = o.where(k % 3 == batch)
        ranks.add(own.select(F.inline(F.array(*[F.struct(F.lit(n).alias("column"), F.col(c).cast("double").alias("value")) for n, c in (("price", "o_totalprice"), ("customer", "o_custkey"))]))), str(batch))
    return review.bounds_of(ranks.quartiles())


@query("""select event_type as segment, count(*) as n, cast(sum(cast(value as decimal(15,2))) as double) as total from events group by event_type""")
def stream_running_totals(spark, sf_dir):
    """Totals kept by a stateful stream that is stopped after some files and started again."""
    from ..streaming import ingest

    events = table(spark, sf_dir, "events")
    shape = events.select("event_id", "event_type", F.col("value").cast("decimal(15,2)").alias("value"), F.col("ts").cast("date").alias("day"))
    source, out, check = (scratch_path(spark, f"stream-{x}") for x in ("in", "totals", "check"))
    own = spark.newSession()  # the state store is set for this stream alone
    own.conf.set("spark.sql.shuffle.partitions", "4")
    for part in (0, 1):
        shape.where(F.col("event_id") % 2 == part).repartition(2, "event_id").write.mode("append").parquet(source)
        ingest.keep_totals(ingest.file_stream(own, source, shape.schema), out, check, "value", "day", ["event_type"]).awaitTermination()
    got = ingest.latest_totals(spark, out).where("dimension = 'event_type'")
    return got.groupBy("segment").agg(F.sum("record_count").alias("n"), F.sum("metric_total").cast("double").alias("total"))


@query(f"""select * from ({ORACLES['evidence_of_segment']}) union all select * from (select 'date', cast(day as varchar), impact from ({ORACLES['date_movement']}) order by abs(impact) desc, day limit 2)""")
def evidence_from_pairs(spark, sf_dir):
    """Entities, overlaps and days of a segment from the totals of pairs, without the rows."""
    rows = materialise(revenue_rows(spark, sf_dir).select(METRIC, DATE, *DIMS, "customer_name"), "rows")
    pairs = materialise(agg.pair_totals(rows, METRIC, DATE, [*DIMS, "customer_name"]), "pairs")
    head = materialise(ex.headline_of(rows, METRIC, DATE), "headline")
    found = ask.evidence_of_pairs(pairs, [*DIMS, "customer_name"], head, "customer_name", "region", "ASIA")
    part = lambda name, kind, c: found[name].select(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("name"), "impact")
    return part("entities", "entity", "segment").unionByName(part("overlaps", "overlap", "segment")).unionByName(part("dates", "date", "day"))
