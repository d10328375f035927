"""The registered queries of the library's own operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import DatePolicy, parse_date
from ..functions.numbers import derived_amount, parse_number
from ..functions.text import category_text, match_key
from ..operators import aggregate as agg
from ..operators import explain as ex
from ..operators import questions as ask
from ..operators import review
from ..sources.scratch import spread
from .star import BASE_SQL, DATE, DIMS, HEAD_SQL, METRIC, RANK_SQL, ROWS_SQL, factors_sql, long_sql, revenue_rows, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
FACTOR = "dimension, segment, previous, current, impact, records, share, confidence, counterfactual"
BY_CHANGE = "abs(impact) desc, dimension, segment"
STRENGTH = f"abs(impact) desc, {RANK_SQL}, segment"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _explained(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return ex.explain_change(revenue_rows(spark, sf_dir), METRIC, DATE, DIMS)


# totals and explanation -----------------------------------------------------------


@query(f"""with {ROWS_SQL} select 'revenue' as metric_column, period, dimension, segment, cast(sum(m) as double) as metric_total, count(*) as record_count
from ({long_sql()} union all select period, '__total__', '__all__', revenue from rows_) group by period, dimension, segment""")
def segment_totals(spark, sf_dir):
    return agg.segment_totals(revenue_rows(spark, sf_dir), METRIC, DATE, DIMS).withColumn("metric_total", F.col("metric_total").cast("double"))


@query(f"""with {ROWS_SQL} select 'revenue' as metric_column, period, dimension, segment, cast(sum(m) as double) as metric_total, count(*) as record_count
from ({long_sql()} union all select period, '__total__', '__all__', revenue from rows_) group by period, dimension, segment""")
def merged_totals(spark, sf_dir):
    rows = revenue_rows(spark, sf_dir)
    halves = [agg.segment_totals(rows.where(F.col("order_key") % 2 == k), METRIC, DATE, DIMS) for k in (0, 1)]
    return agg.merge_totals(*halves).withColumn("metric_total", F.col("metric_total").cast("double"))


@query(f"with {ROWS_SQL}, {HEAD_SQL} select 'revenue' as metric_column, *, case when previous_total = 0 then 0 else change / previous_total * 100 end as change_percent from head")
def headline_change(spark, sf_dir):
    return ex.headline(agg.segment_totals(revenue_rows(spark, sf_dir), METRIC, DATE, DIMS))


@query(f"{BASE_SQL} select {FACTOR} from factors")
def factors(spark, sf_dir):
    return _explained(spark, sf_dir)["factors"]


@query(f"""{BASE_SQL}, c as (select *, (select change from head) = 0 or sign(impact) = sign((select change from head)) as same from factors where impact <> 0)
select {FACTOR}, row_number() over (order by {STRENGTH}) as rank from (select * from c where same or not (select bool_or(same) from c) order by {STRENGTH} limit 5)""")
def top_causes(spark, sf_dir):
    return _explained(spark, sf_dir)["causes"]


WITH_NAMES = (*DIMS, "customer_name")
NAMED_SQL = f"with {ROWS_SQL}, {HEAD_SQL}, {factors_sql(long_sql('rows_', WITH_NAMES))}"


@query(f"""{NAMED_SQL} select {FACTOR}, row_number() over (order by {STRENGTH}) as rank from (select * from factors
where impact <> 0 and (select change from head) <> 0 and sign(impact) <> sign((select change from head)) order by {STRENGTH} limit 3)""")
def offsetting_causes(spark, sf_dir):
    return ex.explain_change(revenue_rows(spark, sf_dir), METRIC, DATE, WITH_NAMES)["offsets"]


@query(f"with {ROWS_SQL} select period, cast(sum(revenue) as double) as total from rows_ group by period order by period desc limit 8")
def kpi_trend(spark, sf_dir):
    return _explained(spark, sf_dir)["trend"]


@query(f"""{BASE_SQL}, causes as (select dimension, segment from factors where impact <> 0 and sign(impact) = sign((select change from head)) order by {STRENGTH} limit 5),
last_ as (select period from months order by period desc limit 8), long_ as ({long_sql()})
select c.dimension, c.segment, p.period, coalesce(cast(sum(m) as double), 0) as total from causes c cross join last_ p
left join long_ l on l.dimension = c.dimension and l.segment = c.segment and l.period = p.period group by all""")
def cause_trends(spark, sf_dir):
    return _explained(spark, sf_dir)["cause_trends"]


@query(f"""{BASE_SQL}, c as (select *, (select change from head) = 0 or sign(impact) = sign((select change from head)) as same from factors where impact <> 0),
one as (select * from c where same or not (select bool_or(same) from c) order by {STRENGTH} limit 1)
select 'revenue ' || case when change < 0 then 'decreased' else 'increased' end || ' ' || printf('%.1f', abs(change / previous_total * 100)) || '% from ' || strftime((previous_period || '-01')::date, '%B %Y') || ' to ' || strftime((current_period || '-01')::date, '%B %Y')
 || '. The largest contributor was ' || dimension || ': ' || segment || '. We are ' || confidence || '% confident in this explanation. If it had stayed flat, revenue would have been about ' || format('{{:,}}', cast(round(counterfactual) as bigint)) || '.' as summary from head, one""")
def change_summary(spark, sf_dir):
    e = _explained(spark, sf_dir)
    return ex.summary(e["headline"], e["causes"])


# review flags ---------------------------------------------------------------------


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_number"), F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").cast("date").alias("order_date"), F.col("o_totalprice").cast("decimal(15,2)").alias("amount"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))


BOUNDS = """bounds as (select q1, q3, q1 - 1.5 * (q3 - q1) as low, q3 + 1.5 * (q3 - q1) as high, n from
  (select quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.75) as q3, count(v) as n from (select cast({c} as double) as v from {t})) where n >= 5 and q3 > q1)"""


@query(f"""with {BOUNDS.format(c="o_totalprice * (1 + 9 * (o_orderkey % 100 // 99))", t="orders")}
select 'amount' as "column", n, q1, q3, low, high from bounds""")
def iqr_bounds(spark, sf_dir):
    return review.iqr_bounds(_spiked(spark, sf_dir), ["amount"])


def _spiked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of which one in a hundred costs ten times as much."""
    o = table(spark, sf_dir, "orders")
    spike = 1 + 9 * F.floor(F.col("o_orderkey") % 100 / 99)
    return o.select(F.col("o_orderkey").alias("row_number"), (F.col("o_totalprice") * spike).alias("amount"), F.col("o_orderdate").cast("date").alias("order_date"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))


@query(f"""with {BOUNDS.format(c="o_totalprice * (1 + 9 * (o_orderkey % 100 // 99))", t="orders")}
select o_orderkey as row_number, o_totalprice * (1 + 9 * (o_orderkey % 100 // 99)) as amount from orders, bounds
where o_totalprice * (1 + 9 * (o_orderkey % 100 // 99)) < low or o_totalprice * (1 + 9 * (o_orderkey % 100 // 99)) > high""")
def iqr_outliers(spark, sf_dir):
    return review.outliers(_spiked(spark, sf_dir), ["amount"]).where("is_outlier").select("row_number", "amount")


SPIKED = """spiked as (select o_orderkey as row_number, cast(o_totalprice * (1 + 9 * (o_orderkey % 100 // 99)) as decimal(18,2)) as amount, strftime(o_orderdate, '%Y-%m') as period,
  o_orderpriority as priority, o_orderstatus as status from orders),
ob as (select q1 - 1.5 * (q3 - q1) as low, q3 + 1.5 * (q3 - q1) as high from (select quantile_cont(cast(amount as double), 0.25) as q1, quantile_cont(cast(amount as double), 0.75) as q3 from spiked)),
flagged as (select *, cast(amount as double) < low or cast(amount as double) > high as is_outlier from spiked, ob)"""


def _side(name: str, rows: str) -> str:
    rank = "case dimension when 'priority' then 0 else 1 end"
    return f"""{name}_months as (select period, sum(amount) as total from {rows} group by period),
{name}_span as (select max(period) as c, min(period) as p from (select period from {name}_months order by period desc limit 2)),
{name}_head as (select p, c, (select total from {name}_months where period = c) - (select total from {name}_months where period = p) as change from {name}_span),
{name}_f as (select dimension, segment, sum(case when period = c then amount else -amount end) as impact from
  (select period, amount, unnest(['priority', 'status']) as dimension, unnest([priority, status]) as segment from {rows}) join {name}_head on period in (p, c) group by dimension, segment),
{name} as (select h.*, f.* from {name}_head h left join (select * from {name}_f where impact <> 0
  order by (sign(impact) = sign((select change from {name}_head)) or (select change from {name}_head) = 0) desc, abs(cast(impact as double)) desc, {rank}, segment limit 1) f on true)"""


@query(f"""with {SPIKED}, calm_rows as (select * from flagged where not is_outlier), {_side("a", "flagged")}, {_side("b", "calm_rows")},
w as (select coalesce(sum(case when period = a.c then amount else -amount end), 0) as x from (select period, amount, unnest(['priority', 'status']) as dimension, unnest([priority, status]) as segment from calm_rows) r
  join a on r.dimension = a.dimension and r.segment = a.segment and r.period in (a.p, a.c))
select (select count(*) from flagged where is_outlier) as outlier_rows, a.dimension as all_dimension, a.segment as all_segment, cast(a.impact as double) as all_impact,
  b.dimension as calm_dimension, b.segment as calm_segment, cast(b.impact as double) as calm_impact, cast(x as double) as impact_without, cast(a.impact as double) - cast(x as double) as outlier_impact,
  cast(b.change as double) as change_without, a.dimension is not null and (b.dimension is null or a.dimension <> b.dimension or a.segment <> b.segment
    or abs(cast(a.impact as double) - cast(x as double)) >= greatest(1, abs(cast(a.impact as double)) * 0.5)) as explanation_changed
from a, b, w""")
def outlier_sensitivity(spark, sf_dir):
    rows = _spiked(spark, sf_dir).withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    flagged = review.outliers(rows, ["amount"])
    return ex.outlier_sensitivity(flagged, "amount", "order_date", ["priority", "status"])


def _causes_sql(name: str, rows: str) -> str:
    """The causes of rows with priority and status, ranked."""
    rank = "case dimension when 'priority' then 0 else 1 end"
    return f"""{name}_all as (select dimension, segment, cast(sum(case when period = p then amount else 0 end) as double) as previous, cast(sum(case when period = c then amount else 0 end) as double) as current,
    cast(sum(case when period = c then amount else -amount end) as double) as impact, count(*) as records from (select period, amount, unnest(['priority', 'status']) as dimension, unnest([priority, status]) as segment from {rows})
    join {name}_head on period in (p, c) group by dimension, segment),
{name}_meas as (select *, case when ch = 0 then 0.0::double else least(1.0::double, abs(impact) / abs(ch)) end as share, ct - impact as counterfactual, ch = 0 or sign(impact) = sign(ch) as same from {name}_all,
    (select cast(change as double) as ch, cast((select total from {name}_months where period = c) as double) as ct from {name}_head) where impact <> 0),
{name}_top as (select dimension, segment, previous, current, impact, records, share, cast(round(least(99, 65 + 34 * share)) as int) as confidence, counterfactual,
    row_number() over (order by abs(impact) desc, {rank}, segment) as rank from (select * from {name}_meas where same or not (select bool_or(same) from {name}_meas) order by abs(impact) desc, {rank}, segment limit 5))"""


@query(f"""with {SPIKED}, calm_rows as (select * from flagged where not is_outlier), {_side("a", "flagged")}, {_side("b", "calm_rows")}, {_causes_sql("a", "flagged")}, {_causes_sql("b", "calm_rows")},
w as (select coalesce(sum(case when period = a.c then amount else -amount end), 0) as x from (select period, amount, unnest(['priority', 'status']) as dimension, unnest([priority, status]) as segment from calm_rows) r
  join a on r.dimension = a.dimension and r.segment = a.segment and r.period in (a.p, a.c)),
ch as (select a.dimension is not null and b.dimension is not null and (a.dimension <> b.dimension or a.segment <> b.segment or abs(cast(a.impact as double) - cast(x as double)) >= greatest(1, abs(cast(a.impact as double)) * 0.5)) as changed from a, b, w)
select * from a_top where not (select changed from ch) union all select * replace (least(confidence, 65) as confidence) from b_top where (select changed from ch)""")
def robust_causes(spark, sf_dir):
    rows = _spiked(spark, sf_dir).withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    return ex.explain_robustly(review.outliers(rows, ["amount"]), "amount", "order_date", ["priority", "status"])


DOUBLED = """doubled as (select event_id as row_number, user_id, event_type, value, props from events
  union all select event_id + 1000000000 as row_number, user_id, event_type, value, props from events where event_id % 10 = 3)"""


def _doubled(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("row_number"), "user_id", "event_type", "value", "props", "ts")
    again = e.where(F.col("row_number") % 10 == 3).withColumn("row_number", F.col("row_number") + 1_000_000_000)
    return e.unionByName(again)


@query(f"""with {DOUBLED} select row_number, row_number <> min(row_number) over (partition by user_id, event_type, value, props) as exact_duplicate from doubled""")
def exact_duplicates(spark, sf_dir):
    return review.exact_duplicates(_doubled(spark, sf_dir), ["user_id", "event_type", "value", "props"]).select("row_number", "exact_duplicate")


@query("""select row_number, n > 1 as possible_duplicate from (select event_id as row_number,
count(*) over (partition by event_type, cast(ts as date), user_id) as n from events)""")
def possible_duplicates(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("row_number"), "event_type", F.col("ts").cast("date").alias("day"), "user_id")
    return review.possible_duplicates(e, "event_type", "day", "user_id").select("row_number", "possible_duplicate")


@query("""select o_orderkey as row_number, case when o_orderkey % 7 = 0 then true else false end as excluded,
case when o_orderkey % 5 = 0 then o_orderkey + 0.5 else o_totalprice end as amount, case when o_orderkey % 11 = 0 then 'Urgent' else o_orderpriority end as priority,
(case when o_orderkey % 5 = 0 then 1 else 0 end + case when o_orderkey % 11 = 0 then 1 else 0 end) as n_changes, case when o_orderkey % 13 = 0 then 1 else 0 end as n_issues from orders""")
def edit_batch(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    empty = F.array().cast(f"array<{review.CHANGE}>"), F.array().cast(f"array<{review.ISSUE}>")
    rows = o.select(F.col("o_orderkey").alias("row_number"), F.lit(False).alias("excluded"), F.col("o_totalprice").alias("amount"), F.col("o_orderdate").cast("date").alias("order_date"), F.col("o_orderpriority").alias("priority"), empty[0].alias("changes"), empty[1].alias("issues"))
    k = F.col("o_orderkey")
    edit = lambda action, column, value: F.struct(F.lit(action).alias("action"), F.lit(column).alias("column"), value.alias("value"))
    none = F.lit(None).cast("string")
    found = F.filter(
        F.array(
            F.when(k % 7 == 0, edit("exclude", None, none)),
            F.when(k % 5 == 0, edit("edit", "amount", F.concat(F.lit("$"), k.cast("string"), F.lit(".50")))),
            F.when(k % 11 == 0, edit("edit", "priority", F.lit(" Urgent "))),
            F.when(k % 13 == 0, edit("edit", "order_date", F.lit("31/31/2020"))),
        ),
        lambda e: e.isNotNull(),
    )
    edits = o.select(k.alias("row_number"), F.inline(found))
    out = review.apply_edits(rows, edits, {"amount": "number", "order_date": "date", "priority": "category"})
    return out.select("row_number", "excluded", "amount", "priority", F.size("changes").alias("n_changes"), F.size("issues").alias("n_issues"))


# questions ------------------------------------------------------------------------


@query(f"{BASE_SQL} select {FACTOR} from factors where dimension = 'region' order by current desc, abs(impact) desc, segment limit 3")
def top_n_current(spark, sf_dir):
    return ask.top_n(_explained(spark, sf_dir)["factors"], "region", 3, "current")


@query(f"{BASE_SQL} select {FACTOR} from factors where dimension = 'priority' and abs(impact) = (select max(abs(impact)) from factors where dimension = 'priority')")
def top_n_ties(spark, sf_dir):
    return ask.top_n(_explained(spark, sf_dir)["factors"], "priority", 1)


@query(f"{BASE_SQL} select {FACTOR}, rank from (select *, row_number() over (order by {BY_CHANGE}) as rank from factors) where rank = 3")
def nth_factor(spark, sf_dir):
    return ask.nth_factor(_explained(spark, sf_dir)["factors"], 3)


@query(f"{NAMED_SQL} select {FACTOR} from factors where impact <> 0 and sign(impact) <> sign((select change from head)) order by {BY_CHANGE} limit 4")
def rank_offsets(spark, sf_dir):
    e = ex.explain_change(revenue_rows(spark, sf_dir), METRIC, DATE, WITH_NAMES)
    return ask.rank_factors(e["factors"], e["headline"], "offsets", 4)


@query(f"{BASE_SQL} select {FACTOR} from factors where impact <> 0 and sign(impact) = sign((select change from head)) order by {BY_CHANGE} limit 5")
def overall_drivers(spark, sf_dir):
    e = _explained(spark, sf_dir)
    return ask.overall_drivers(e["factors"], e["headline"])


@query(f"{BASE_SQL} select {FACTOR} from factors where dimension = 'region' and lower(segment) not in ('asia', 'europe') order by {BY_CHANGE} limit 1")
def compare_excluding(spark, sf_dir):
    return ask.compare_excluding(_explained(spark, sf_dir)["factors"], "region", ["Asia", " EUROPE "])


@query(f"{BASE_SQL} select {FACTOR} from factors where impact <> 0 and sign(impact) = sign((select change from head)) order by {BY_CHANGE} limit 3")
def priorities(spark, sf_dir):
    e = _explained(spark, sf_dir)
    return ask.priorities(e["factors"], e["headline"])


@query(f"""{BASE_SQL} select cast(day(order_date) as int) as day, cast(sum(case when period = current_period then 0 else revenue end) as double) as previous,
cast(sum(case when period = current_period then revenue else 0 end) as double) as current, cast(sum(case when period = current_period then revenue else -revenue end) as double) as impact, count(*) as records
from rows_ join span on period in (previous_period, current_period) where region = 'ASIA' group by 1 order by abs(cast(sum(case when period = current_period then revenue else -revenue end) as double)) desc, 1 limit 5""")
def date_movement(spark, sf_dir):
    rows = revenue_rows(spark, sf_dir)
    return ask.date_movement(rows, METRIC, DATE, ex.headline_of(rows, METRIC, DATE), "region", "ASIA")


INSIDE = "inside as (select * from rows_ where region = 'ASIA')"


@query(f"{BASE_SQL}, {INSIDE}, {factors_sql(long_sql('inside', [d for d in DIMS if d != 'region']), 'f2')} select {FACTOR} from f2 where impact <> 0 order by {BY_CHANGE} limit 5")
def overlap(spark, sf_dir):
    rows = revenue_rows(spark, sf_dir)
    return ask.overlap(rows, METRIC, DATE, DIMS, ex.headline_of(rows, METRIC, DATE), "region", "ASIA")


@query(f"{BASE_SQL}, {INSIDE}, {factors_sql(long_sql('inside', ['customer_name']), 'f2')} select {FACTOR} from f2 where impact <> 0 order by {BY_CHANGE} limit 3")
def drilldown(spark, sf_dir):
    rows = revenue_rows(spark, sf_dir)
    return ask.drilldown(rows, METRIC, DATE, ex.headline_of(rows, METRIC, DATE), "customer_name", "region", "ASIA")


@query(f"{BASE_SQL}, {factors_sql(long_sql('rows_', ['customer_name']), 'f2')} select {FACTOR} from f2 where impact < 0 order by impact, segment limit 1")
def top_decliner(spark, sf_dir):
    rows = revenue_rows(spark, sf_dir)
    return ask.top_decliner(rows, METRIC, DATE, ex.headline_of(rows, METRIC, DATE), "customer_name")


@query(f"{BASE_SQL} select dimension, segment, impact, current_total, current_total - impact as if_flat, change - impact as change_if_flat from factors, head where dimension = 'region' and segment = 'ASIA'")
def counterfactual(spark, sf_dir):
    e = _explained(spark, sf_dir)
    return ask.counterfactual(e["factors"], e["headline"], "region", "ASIA")


@query(f"""with {ROWS_SQL} select customer_name as segment, order_date as "date", cast(revenue as double) as "value" from rows_ where revenue > 0 order by revenue desc, customer_name, order_date limit 1""")
def largest_record(spark, sf_dir):
    return ask.largest_record(revenue_rows(spark, sf_dir), METRIC, DATE, "customer_name")


@query(f"""with {ROWS_SQL} select count(distinct lower(trim(customer_name))) as entities, count(*) as rows, cast(sum(revenue) as double) as total from rows_ where period = '2000-05' and revenue > 0""")
def period_counts(spark, sf_dir):
    rows = revenue_rows(spark, sf_dir)
    entities = ask.count_entities(rows, METRIC, DATE, "customer_name", "2000-05").withColumnRenamed("n", "entities")
    return entities.join(ask.count_rows(rows, METRIC, DATE, "2000-05").withColumnRenamed("n", "rows")).join(ask.metric_total(rows, METRIC, DATE, "2000-05"))


@query(f"{BASE_SQL} select distinct dimension, segment, false as ambiguous from factors where segment = 'MIDDLE EAST'")
def resolve_value(spark, sf_dir):
    return ask.resolve_value(_explained(spark, sf_dir)["factors"], "why did the middle-east change?")


@query(f"""{BASE_SQL}, cards as (select dimension, segment from factors where dimension = 'region') select dimension, segment, case when dimension = 'region' then 0.0::double else impact end as impact from factors""")
def displayed_cards(spark, sf_dir):
    f = _explained(spark, sf_dir)["factors"]
    cards = f.where("dimension = 'region'").withColumn("impact", F.lit(0.0))
    return ask.with_cards(f, cards).select("dimension", "segment", "impact")


RUNS = """runs as (select 'revenue' as metric_column, period as current_period, sum(revenue) as current_total from rows_ group by period)"""


@query(f"""with {ROWS_SQL}, {RUNS}, last_ as (select * from runs order by current_period desc limit 1), old as (select cast(sum(current_total) as double) / count(*) as mean_total, count(*) as runs from runs where current_period < (select current_period from last_))
select 'revenue' as metric_column, cast(current_total as double) as current_total, mean_total, runs, (cast(current_total as double) - mean_total) / abs(mean_total) * 100 as delta_percent from last_, old""")
def run_benchmark(spark, sf_dir):
    t = agg.segment_totals(revenue_rows(spark, sf_dir), METRIC, DATE, DIMS).where("dimension = '__total__'")
    runs = t.select("metric_column", F.col("period").alias("current_period"), F.col("metric_total").alias("current_total"))
    last = runs.orderBy(F.desc("current_period")).limit(1)
    earlier = runs.join(F.broadcast(last.select(F.col("current_period").alias("_p"))), F.col("current_period") < F.col("_p")).drop("_p")
    return ask.benchmark(last, earlier).withColumn("current_total", F.col("current_total").cast("double"))


# cleaning -------------------------------------------------------------------------


def _dirty_amount(key, price):
    text = F.format_number(price, 2)
    plain = F.regexp_replace(text, ",", "")
    euro = F.translate(text, ",.", ".,")
    return _pick(key, F.concat(F.lit("$"), text), F.concat(F.lit("("), plain, F.lit(")")), euro, F.concat(plain, F.lit(" DR")), F.concat(F.lit("EUR "), euro, F.lit("-")), F.concat(F.lit("'"), plain))


def _pick(key, *texts):
    """One of the texts, by the remainder of the key; only that one is made."""
    out = F.when(key % len(texts) == 0, texts[0])
    for r, t in enumerate(texts[1:], 1):
        out = out.when(key % len(texts) == r, t)
    return out


@query("select o_orderkey, case when o_orderkey % 6 in (1, 3, 4) then -o_totalprice else o_totalprice end as amount from orders")
def parse_numbers(spark, sf_dir):
    o = spread(table(spark, sf_dir, "orders")).withColumn("dirty", _dirty_amount(F.col("o_orderkey"), F.col("o_totalprice")))
    return o.select("o_orderkey", parse_number(F.col("dirty")).alias("amount"))


@query("select o_orderkey, case when o_orderkey % 6 = 4 then date_trunc('month', o_orderdate)::date when o_orderkey % 6 = 5 then date_trunc('quarter', o_orderdate)::date else o_orderdate::date end as order_date from orders")
def parse_dates(spark, sf_dir):
    d = F.col("o_orderdate")
    forms = [F.date_format(d, "yyyyMMdd"), F.date_format(d, "dd/MM/yyyy"), F.date_format(d, "d MMM yyyy"), F.date_format(d, "yyyy-MM-dd HH:mm"), F.date_format(d, "MMM yyyy"), F.concat(F.lit("Q"), F.quarter(d), F.lit(" "), F.year(d))]
    o = spread(table(spark, sf_dir, "orders")).withColumn("dirty", F.element_at(F.array(*forms), (F.col("o_orderkey") % 6 + 1).cast("int")))
    return o.select("o_orderkey", parse_date(F.col("dirty"), DatePolicy("day-first")).alias("order_date"))


@query("""select l_orderkey, l_linenumber, l_quantity * l_extendedprice - l_quantity * l_extendedprice * (l_discount * 100 / 100) + l_tax as amount from lineitem""")
def derived_amounts(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    amount = derived_amount(F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount") * 100, "percentage", F.col("l_tax"), "amount")
    return t.select("l_orderkey", "l_linenumber", amount.alias("amount"))


@query("select p_partkey, lower(p_type) as key, p_type as label from part")
def category_keys(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    dirty = F.element_at(F.array(F.concat(F.lit("  "), F.lower("p_type")), F.concat(F.col("p_type"), F.lit(".")), F.concat(F.lit("“"), F.col("p_type"), F.lit("”"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    spaced = F.concat(F.lit(" "), F.col("p_type"), F.lit("  "))
    return p.select("p_partkey", match_key(dirty).alias("key"), category_text(spaced).alias("label"))


# whole imports --------------------------------------------------------------------


def _dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a raw table of strings: amounts in several notations, one in fifty
    missing and one in fifty unreadable, dates in four forms, categories with spaces."""
    o = spread(table(spark, sf_dir, "orders"))
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    amount = F.when(k % 50 == 7, "N/A").when(k % 50 == 9, "unclear").otherwise(_dirty_amount(k, F.col("o_totalprice")))
    dates = _pick(k, F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "dd/MM/yyyy"), F.date_format(d, "d MMM yyyy"), F.date_format(d, "yyyyMMdd"))
    status = F.when(k % 3 == 0, F.concat(F.lit("  "), F.col("o_orderstatus"))).otherwise(F.col("o_orderstatus"))
    return o.select(k.alias("row_number"), F.concat(F.lit("ORD-"), k.cast("string")).alias("Order ID"), dates.alias("Order Date"), amount.alias("Net Sales"), status.alias("Type"), F.col("o_orderpriority").alias("Segment"))


def _profiles(raw: DataFrame):
    from ..operators import profile as pr

    from ..sources.readers import profile_sample

    return pr.profile(profile_sample(raw).drop("row_number"))


@query("""select * from (values ('Order ID', 'identifier', false), ('Order Date', 'date', false), ('Net Sales', 'number', true),
 ('Type', 'category', false), ('Segment', 'category', false)) t("name", kind, selected)""")
def profile_columns(spark, sf_dir):
    from ..operators import profile as pr

    return pr.as_table(spark, _profiles(_dirty_orders(spark, sf_dir))).select("name", "kind", "selected")


@query("""select kind, name, n from (
 select 'change' as kind, 'Standardised numeric or currency value' as name, count(*) filter (o_orderkey % 50 not in (7, 9)) as n from orders
 union all select 'change', 'Standardised date', count(*) filter (o_orderkey % 4 <> 0) from orders
 union all select 'change', 'Standardised category whitespace', count(*) filter (o_orderkey % 3 = 0) from orders
 union all select 'issue', 'missing', count(*) filter (o_orderkey % 50 = 7) from orders
 union all select 'issue', 'invalid-number', count(*) filter (o_orderkey % 50 = 9) from orders) where n > 0""")
def cleaning_counts(spark, sf_dir):
    from ..operators import clean

    raw = _dirty_orders(spark, sf_dir)
    return clean.cleaning_counts(clean.clean(raw, _profiles(raw)))


@query("""select o_orderkey as row_number, o_orderdate::date as "Order Date", case when o_orderkey % 50 in (7, 9) then null when o_orderkey % 6 in (1, 3, 4) then -o_totalprice else o_totalprice end as "Net Sales",
 o_orderstatus as "Type", o_orderpriority as "Segment", false as excluded from orders""")
def cleaned_rows(spark, sf_dir):
    from ..operators import clean

    raw = _dirty_orders(spark, sf_dir)
    return clean.review_table(raw, _profiles(raw), fuzzy=False).select("row_number", "Order Date", "Net Sales", "Type", "Segment", "excluded")


@query("""with o as (select *, case when o_orderkey % 50 in (7, 9) then null when o_orderkey % 6 in (1, 3, 4) then -o_totalprice else o_totalprice end as v from orders),
b as (select q1 - 1.5 * (q3 - q1) as low, q3 + 1.5 * (q3 - q1) as high from (select quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.75) as q3 from o)),
n as (select count(*) filter (v < low or v > high) as outliers, count(*) filter (v is not null) as numbers, count(*) filter (o_orderkey % 4 <> 0) as days, count(*) filter (o_orderkey % 3 = 0) as spaces,
  count(*) filter (o_orderkey % 50 = 7) as missing, count(*) filter (o_orderkey % 50 = 9) as invalid from o, b)
select key, title, n, severity from (select 'duplicates' as key, 'Exact duplicates excluded' as title, 0 as n, 'info' as severity union all select 'possible', 'Possible duplicates flagged', 0, 'info'
 union all select 'outliers', 'Outliers flagged for review', outliers, case when outliers > 0 then 'warning' else 'info' end from n union all select 'change:Standardised numeric or currency value', 'Standardised numeric or currency value', numbers, 'success' from n
 union all select 'change:Standardised date', 'Standardised date', days, 'success' from n union all select 'change:Standardised category whitespace', 'Standardised category whitespace', spaces, 'success' from n
 union all select 'issue:missing', 'Issue: missing', missing, 'warning' from n union all select 'issue:invalid-number', 'Issue: invalid-number', invalid, 'warning' from n
 union all select 'issue:outlier', 'Issue: outlier', outliers, 'warning' from n) where n > 0 or key in ('duplicates', 'possible', 'outliers')""")
def cleaning_log(spark, sf_dir):
    from ..operators import clean

    raw = _dirty_orders(spark, sf_dir)
    return clean.cleaning_log(clean.review_table(raw, _profiles(raw))).select("key", "title", "n", "severity")


def _dirty_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    kind = F.when(k % 10 == 3, F.lower("p_type")).when(k % 10 == 6, F.concat(F.col("p_type"), F.lit("."))).otherwise(F.col("p_type"))
    typo = F.when(k % 40 == 1, F.concat(F.col("p_brand"), F.lit("x manufacturing company"))).otherwise(F.concat(F.col("p_brand"), F.lit(" manufacturing company")))
    return p.select(k.alias("row_number"), kind.alias("type"), typo.alias("brand"), F.col("p_name").alias("product"))


@query("select p_partkey as row_number, p_type as type from part")
def category_reconcile(spark, sf_dir):
    from ..operators import categories

    return categories.reconcile(_dirty_types(spark, sf_dir), ["type"], fuzzy=False).select("row_number", "type")


#: The sequential rule as a recursion over the values in their order: `gone` holds those that
#: were replaced, and a value's targets are ranked without them.
@query("""with recursive cells as (
 select 'type' as "column", case when p_partkey % 10 = 3 then lower(p_type) when p_partkey % 10 = 6 then p_type || '.' else p_type end as value from part
 union all select 'brand', p_brand || case when p_partkey % 40 = 1 then 'x manufacturing company' else ' manufacturing company' end from part
 union all select 'product', p_name || case when p_partkey % 5 = 2 then 's' when p_partkey % 5 = 4 then 'zz' else '' end from part),
v as (select "column", value, count(*) as n, rtrim(value, '.') as display, lower(rtrim(value, '.')) as same, regexp_replace(lower(value), '[^a-z0-9]', '', 'g') as key from cells group by 1, 2),
format as (select "column", same, arg_min(display, {'a': -n, 'b': value <> display, 'c': NOT regexp_matches(display, '^[A-Z]'), 'd': display}) as replacement from v group by 1, 2 having count(*) > 1),
fixed as (select "column", value, replacement from v join format using ("column", same) where value <> replacement),
open as (select *, row_number() over (order by "column", n, value) as i from v anti join fixed using ("column", value) where length(key) >= 4),
pairs as (select a.i, b.value as b, b.n = a.n and b.value < a.value as earlier, length(a.key) >= 8 and length(b.value) >= 8 as long, 1 - levenshtein(a.key, b.key) / greatest(length(a.key), length(b.key)) as score
 from open a join open b on a."column" = b."column" and a.value <> b.value and (b.n > a.n or b.n = a.n and length(b.key) >= length(a.key)) and abs(length(a.key) - length(b.key)) <= 0.2 * length(b.key)),
near as (select i, list({'s': -score, 'b': b, 'long': long, 'earlier': earlier} order by score desc, b) as l from pairs where score >= 0.88 - 0.04 group by i),
asked as (select row_number() over (order by i) as k, i, "column", value, l from near join open using (i)),
steps as (select 0 as k, [] ::varchar[] as gone, null::varchar as "column", null::varchar as value, null::varchar as replacement
 union all select k, case when hit then list_append(gone, id) else gone end, "column", value, case when hit then free[1].b end
 from (select *, len(free) > 0 and (-free[1].s >= 0.93 or free[1].long and -free[1].s >= 0.88) and (len(free) = 1 or free[2].s - free[1].s >= 0.04) as hit
  from (select asked.k, gone, asked."column", asked.value, asked."column" || '|' || asked.value as id, list_filter(l, lambda x: not (x.earlier and list_contains(gone, asked."column" || '|' || x.b))) as free
   from steps join asked on asked.k = steps.k + 1)))
select "column", value, replacement, 'Standardised equivalent category formatting' as reason from fixed
union all select "column", value, replacement, 'Merged a high-confidence near-duplicate category' from steps where replacement is not null""")
def fuzzy_merge(spark, sf_dir):
    """Equal formatting and near-duplicates in three columns, one of them with many values."""
    from ..operators import categories

    rows, k = _dirty_types(spark, sf_dir), F.col("row_number")
    product = F.concat("product", F.when(k % 5 == 2, "s").when(k % 5 == 4, "zz").otherwise(""))
    return categories.replacements(rows.withColumn("product", product), ["type", "brand", "product"], many=None)


@query("""with v as (select 'product' as "column", p_name as value, count(*) as n from part group by p_name union all select 'word', split_part(p_name, ' ', 2), count(*) from part group by 2),
w as (select value, sum(n) as n from v group by value)
select 'containment-' || sha256('["product","' || a.value || '","' || b.value || '"]') as id, a.value as contained, b.value as containing, cast(a.n as bigint) as contained_n, cast(b.n as bigint) as containing_n from w a join w b on length(b.value) > length(a.value) and contains(' ' || b.value || ' ', ' ' || a.value || ' ')""")
def containment(spark, sf_dir):
    from ..operators import categories

    p = table(spark, sf_dir, "part")
    names = p.select(F.col("p_name").alias("product")).unionByName(p.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("product")))
    return categories.containment(names, ["product"]).select("id", "contained", "containing", "contained_n", "containing_n")


@query("""select code, cast(sum(w) as bigint) as score from (select 'USD' as code, 1 as w from orders where o_orderkey % 6 = 0 union all select 'EUR', 5 + 4 from orders where o_orderkey % 6 = 4) group by code""")
def currency_votes(spark, sf_dir):
    from ..operators import currency

    o = table(spark, sf_dir, "orders")
    return currency.votes(o.select(_dirty_amount(F.col("o_orderkey"), F.col("o_totalprice")).alias("value")))


@query("select o_orderkey as row_number, o_totalprice as amount, (select count(*) from orders) as total_rows from orders order by o_orderkey limit 50 offset 100")
def preview_page(spark, sf_dir):
    from ..sources import store

    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_number"), F.col("o_totalprice").alias("amount"))
    return store.preview(o, 2, 50)


@query(f"""with {ROWS_SQL} select 'revenue' as metric_column, period, dimension, segment, cast(sum(m) as double) as metric_total, count(*) as record_count
from ({long_sql()} union all select period, '__total__', '__all__', revenue from rows_) group by period, dimension, segment""")
def stored_totals(spark, sf_dir):
    """Totals written in two batches, one of them twice, and read back added up."""
    from ..sources import store
    from ..sources.scratch import scratch_path

    path = scratch_path(spark, "totals")
    rows = revenue_rows(spark, sf_dir)
    for batch in (0, 1, 0):
        part = agg.segment_totals(rows.where(F.col("order_key") % 2 == batch), METRIC, DATE, DIMS)
        store.write_totals(part.withColumn("metric_total", F.col("metric_total").cast("decimal(24,4)")), path, "run", str(batch))
    return store.read_totals(spark, path, "run").withColumn("metric_total", F.col("metric_total").cast("double"))


# more of the same operators --------------------------------------------------------


@query(f"""{BASE_SQL}, c as (select dimension, segment, previous, current, impact, records, least(1.0::double, abs(impact) / greatest(abs((select change from head)), 1)) as share, counterfactual from factors
  where abs(impact) >= greatest(0.08::double * abs((select change from head)), 0.01::double) and sign(impact) = sign((select change from head)))
select dimension, segment, previous, current, impact, records, share, cast(round(least(96, 54 + 34 * share + least(10, 1.5::double * records))) as int) as confidence, counterfactual,
  row_number() over (order by {STRENGTH}) as rank from c order by {STRENGTH} limit 5""")
def material_causes(spark, sf_dir):
    e = _explained(spark, sf_dir)
    return ex.material_causes(e["factors"], e["headline"])


@query(f"{BASE_SQL} select coalesce(sum(impact), 0) as impact from factors where dimension = 'region' and segment = 'EUROPE'")
def cause_impact(spark, sf_dir):
    e = _explained(spark, sf_dir)
    return ex.cause_impact(e["totals"], e["headline"], "region", "EUROPE")


@query("select event_id + 1000000000 as row_number from events where event_id % 10 = 3")
def stored_duplicates(spark, sf_dir):
    """Rows that are already stored, by signature."""
    both = _doubled(spark, sf_dir)
    signed = both.withColumn("row_signature", review.row_signature(["ts", "user_id", "event_type", "value", "props"]))
    new, stored = signed.where("row_number >= 1000000000"), signed.where("row_number < 1000000000")
    return new.join(review.novel_rows(new, stored).select("row_number"), "row_number", "left_anti").select("row_number")


@query("""select o_orderkey as row_number, o_totalprice as amount, case when o_orderkey % 9 = 0 then 'Excluded' else 'Included' end as __status from orders""")
def exported_rows(spark, sf_dir):
    from ..sources import store

    k, no = F.col("o_orderkey"), F.lit(False)
    rows = table(spark, sf_dir, "orders").select(k.alias("row_number"), F.col("o_totalprice").alias("amount"), no.alias("exact_duplicate"), no.alias("possible_duplicate"), (k % 9 == 0).alias("excluded"))
    return store.export_rows(rows, ["amount"])


@query("""select event_type as segment, count(*) as n, cast(sum(cast(value as decimal(15,2))) as double) as total from events group by event_type""")
def stream_totals(spark, sf_dir):
    """Events ingested in micro-batches of files, with the totals of all batches added up."""
    from ..sources import store
    from ..sources.scratch import scratch_path
    from ..streaming import ingest

    events = table(spark, sf_dir, "events")
    shape = events.select(F.col("event_id").alias("row_number"), "event_type", F.col("value").cast("decimal(15,2)").alias("value"), F.col("ts").cast("date").alias("day"))
    source = scratch_path(spark, "stream-in")
    shape.repartition(3, "row_number").write.parquet(source)
    out, totals = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-totals")
    stream = ingest.file_stream(spark, source, shape.schema)
    run = ingest.ingest(stream, out, scratch_path(spark, "stream-check"), ["row_number", "event_type", "value", "day"], totals=totals, metric="value", date="day", dims=["event_type"])
    run.awaitTermination()
    got = store.read_totals(spark, totals, "stream").where("dimension = 'event_type'")
    return got.groupBy("segment").agg(F.sum("record_count").alias("n"), F.sum("metric_total").cast("double").alias("total"))
