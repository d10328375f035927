"""The revenue table that most queries run on: one row for each order line, with the
month's metric and its dimensions, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRIC, DATE = "revenue", "order_date"
DIMS = ("region", "segment_name", "priority", "return_flag")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def revenue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices and discounts are decimals before they are multiplied, so sums are exact.
    No join is hinted: Spark broadcasts the sides whose size allows it."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_returnflag").alias("return_flag"), (F.col("l_extendedprice").cast("decimal(15,2)") * (1 - F.col("l_discount").cast("decimal(15,2)"))).alias(METRIC)
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias(DATE), F.col("o_orderpriority").alias("priority"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.col("c_name").alias("customer_name"), F.col("c_mktsegment").alias("segment_name"))
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", F.col("n_name").alias("nation"))
    regions = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("region"))
    places = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    who = customers.join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    sold = orders.join(who, F.col("o_custkey") == F.col("c_custkey"))
    return lines.join(sold, F.col("l_orderkey") == F.col("o_orderkey")).select(METRIC, DATE, *DIMS, "nation", "customer_name", F.col("l_orderkey").alias("order_key"))


#: The same rows, their long form, totals, last two periods and factors, as SQL.
ROWS_SQL = """rows_ as (
  select cast(l_extendedprice as decimal(15,2)) * (1 - cast(l_discount as decimal(15,2))) as revenue, cast(o_orderdate as date) as order_date,
         strftime(o_orderdate, '%Y-%m') as period, r_name as region, c_mktsegment as segment_name, o_orderpriority as priority,
         l_returnflag as return_flag, n_name as nation, c_name as customer_name, l_orderkey as order_key
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
  join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""


def long_sql(rows: str = "rows_", dims=DIMS, metric: str = "revenue") -> str:
    return " union all ".join(f"select period, '{d}' as dimension, coalesce({d}, 'Unknown') as segment, {metric} as m from {rows}" for d in dims)


HEAD_SQL = """months as (select period, sum(revenue) as total from rows_ group by period),
span as (select max(period) as current_period, min(period) as previous_period from (select period from months order by period desc limit 2)),
head as (select previous_period, current_period,
  cast((select total from months where period = previous_period) as double) as previous_total,
  cast((select total from months where period = current_period) as double) as current_total,
  cast((select total from months where period = current_period) - (select total from months where period = previous_period) as double) as change from span)"""


def factors_sql(long: str, name: str = "factors") -> str:
    return f"""{name} as (select dimension, segment, previous, current, impact, records, share,
    cast(round(least(99, 65 + 34 * share)) as int) as confidence, (select current_total from head) - impact as counterfactual
  from (select *, case when (select change from head) = 0 then 0.0::double else least(1.0::double, abs(impact) / abs((select change from head))) end as share
    from (select dimension, segment,
      cast(sum(case when period = previous_period then m else 0 end) as double) as previous,
      cast(sum(case when period = current_period then m else 0 end) as double) as current,
      cast(sum(case when period = current_period then m else -m end) as double) as impact, count(*) as records
    from ({long}) join span on period in (previous_period, current_period) group by dimension, segment)))"""


RANK_SQL = "case dimension " + " ".join(f"when '{d}' then {k}" for k, d in enumerate(DIMS)) + f" else {len(DIMS)} end"
BASE_SQL = f"with {ROWS_SQL}, {HEAD_SQL}, {factors_sql(long_sql())}"
