"""Follow-up questions as typed operators over cleaned rows (or factors) and the headline.

Rankings have a full order: a stated measure, then dimension and segment.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregate import DAYS, UNKNOWN, factors_from_totals, in_periods, period_of, two_period_factors, usable

#: Ranks that can be asked for.
MOST = 20
PEOPLE = "(?i)company|customer|client|employer|organi[sz]ation"


def clamp(n: int) -> int:
    return max(1, min(int(n), MOST))


def plain(c: str | Column) -> Column:
    """Trimmed, white space collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"\s+", " ")))


def is_unknown(c: str) -> Column:
    return F.col(c).isNull() | F.trim(c).rlike(r"(?i)^(unknown|n/a|na|null|none|undefined|\(blank\))?$")


def by_change() -> list[Column]:
    return [F.desc(F.abs("impact")), F.asc("dimension"), F.asc("segment")]


def by_current() -> list[Column]:
    return [F.desc("current"), F.desc(F.abs("impact")), F.asc("segment")]


def excluding(factors: DataFrame, names: Sequence[str]) -> DataFrame:
    """Without the named segments, whatever their case and spacing."""
    own = [" ".join(n.split()).lower() for n in names]
    return factors.where(~plain("segment").isin(own)) if own else factors


def driver_group(factors: DataFrame, head: DataFrame, group: str | None) -> DataFrame:
    """Factors that move with the headline (`drivers`) or against it (`offsets`)."""
    if group is None:
        return factors
    f = factors.join(F.broadcast(head.select(F.col("change").alias("_change"))))
    same = F.signum("impact") == F.signum("_change")
    return f.where((F.col("impact") != 0) & (same if group == "drivers" else ~same)).drop("_change")


def with_cards(factors: DataFrame, cards: DataFrame) -> DataFrame:
    """Displayed causes replace computed factors of the same dimension and segment."""
    keys = ["dimension", "segment"]
    return factors.join(cards.select(*keys), keys, "left_anti").unionByName(cards.select(*factors.columns))


def top_n(factors: DataFrame, dimension: str, n: int, rank_by: str = "change", exclude: Sequence[str] = (), head: DataFrame | None = None, group: str | None = None) -> DataFrame:
    """The n segments of a dimension of greatest current total or absolute change; for
    n = 1 all that tie."""
    f = excluding(factors.where((F.col("dimension") == dimension) & ~is_unknown("segment")), exclude)
    f = driver_group(f, head, group)
    if clamp(n) == 1:
        measure = F.col("current") if rank_by == "current" else F.abs("impact")
        best = f.agg(F.max(measure).alias("_best"))
        return f.join(F.broadcast(best), measure == F.col("_best")).drop("_best")
    return f.orderBy(*(by_current() if rank_by == "current" else by_change())).limit(clamp(n))


def nth_factor(factors: DataFrame, n: int) -> DataFrame:
    """The nth largest factor over all dimensions."""
    few = factors.orderBy(*by_change()).limit(clamp(n))
    return few.withColumn("rank", F.row_number().over(Window.orderBy(*by_change()))).where(F.col("rank") == clamp(n))


def rank_factors(factors: DataFrame, head: DataFrame, group: str, n: int) -> DataFrame:
    return driver_group(factors, head, group).orderBy(*by_change()).limit(clamp(n))


def overall_drivers(factors: DataFrame, head: DataFrame, n: int = 5) -> DataFrame:
    return rank_factors(factors, head, "drivers", n)


def compare_excluding(factors: DataFrame, dimension: str, names: Sequence[str]) -> DataFrame:
    """The strongest segment of the dimension besides the named ones."""
    f = excluding(factors.where((F.col("dimension") == dimension) & ~is_unknown("segment")), names)
    return f.orderBy(*by_change()).limit(1)


def priorities(factors: DataFrame, head: DataFrame, group: str = "drivers", n: int = 3) -> DataFrame:
    """What to work on: strongest factors of the group, without dimensions of people."""
    return rank_factors(factors.where(~F.col("dimension").rlike(PEOPLE)), head, group, n)


def _inside(rows: DataFrame, dimension: str, segment: str) -> DataFrame:
    return rows.where(F.coalesce(F.col(dimension).cast("string"), F.lit(UNKNOWN)) == segment)


def date_movement(rows: DataFrame, metric: str, date: str, head: DataFrame, dimension: str, segment: str, n: int = 5) -> DataFrame:
    """Change within a segment between the same days of the two months."""
    h = F.broadcast(head.select("previous_period", "current_period"))
    r = usable(in_periods(_inside(rows, dimension, segment), date, head), metric, date).withColumn("period", period_of(date))
    r = r.join(h, F.col("period").isin(F.col("previous_period"), F.col("current_period")))
    now = F.col("period") == F.col("current_period")
    out = r.groupBy(F.dayofmonth(date).alias("day")).agg(
        F.sum(F.when(now, 0).otherwise(F.col(metric))).cast("double").alias("previous"),
        F.sum(F.when(now, F.col(metric)).otherwise(0)).cast("double").alias("current"),
        F.sum(F.when(now, F.col(metric)).otherwise(-F.col(metric))).cast("double").alias("impact"),
        F.count("*").alias("records"),
    )
    return out.orderBy(F.desc(F.abs("impact")), "day").limit(clamp(n))


def overlap(rows: DataFrame, metric: str, date: str, dims: Sequence[str], head: DataFrame, dimension: str, segment: str, n: int = 5) -> DataFrame:
    """Factors of the other dimensions inside a segment."""
    others = [d for d in dims if d != dimension]
    f = two_period_factors(_inside(rows, dimension, segment), metric, date, others, head)
    return f.where((F.col("impact") != 0) & ~is_unknown("segment")).orderBy(*by_change()).limit(clamp(n))


def drilldown(rows: DataFrame, metric: str, date: str, head: DataFrame, entity: str, dimension: str | None = None, segment: str | None = None, n: int = 5) -> DataFrame:
    """Entities that moved most, overall or inside a segment (there at most three)."""
    part = rows if dimension is None else _inside(rows, dimension, segment)
    f = two_period_factors(part, metric, date, [entity], head)
    return f.where((F.col("impact") != 0) & ~is_unknown("segment")).orderBy(*by_change()).limit(clamp(n if dimension is None else min(n, 3)))


def inside_totals(pairs: DataFrame, dimension: str, segment: str) -> DataFrame:
    """Totals by period, dimension and segment of the rows inside a segment, from the totals
    of pairs of segments (aggregate.pair_totals). Empty for a dimension that they do not have."""
    keep = ["metric_column", "period", "metric_total", "record_count"]
    first = pairs.where((F.col("dimension") == dimension) & (F.col("segment") == segment)).select(*keep, F.col("other_dimension").alias("dimension"), F.col("other_segment").alias("segment"))
    second = pairs.where((F.col("other_dimension") == dimension) & (F.col("other_segment") == segment)).select(*keep, "dimension", "segment")
    return first.unionByName(second)


def evidence_of_pairs(pairs: DataFrame, dims: Sequence[str], head: DataFrame, entity: str, dimension: str, segment: str, n: int = 2) -> dict[str, DataFrame]:
    """What `evidence` finds (entities, overlaps, dates; n each), from totals of pairs: no row
    of the table is read. They must have been made with all of dims, the entity among them."""
    inside = inside_totals(pairs, dimension, segment)
    f = factors_from_totals(inside, head).where(F.col("impact") != 0)
    top = lambda df: df.where(~is_unknown("segment")).orderBy(*by_change()).limit(clamp(n))
    days = f.where(F.col("dimension") == DAYS).select(F.col("segment").cast("int").alias("day"), "previous", "current", "impact", "records")
    return {
        "entities": top(f.where(F.col("dimension") == entity)),
        "overlaps": top(f.where(F.col("dimension").isin([d for d in dims if d not in (dimension, entity)]))),
        "dates": days.orderBy(F.desc(F.abs("impact")), "day").limit(clamp(n)),
    }


def counterfactual(factors: DataFrame, head: DataFrame, dimension: str, segment: str, cards: DataFrame | None = None) -> DataFrame:
    """The current total if the segment had stayed flat; a displayed card's figures win."""
    f = factors if cards is None else with_cards(factors, cards)
    one = f.where((F.col("dimension") == dimension) & (F.col("segment") == segment))
    return one.join(F.broadcast(head.select("current_total", "change"))).select("dimension", "segment", "impact", "current_total", (F.col("current_total") - F.col("impact")).alias("if_flat"), (F.col("change") - F.col("impact")).alias("change_if_flat"))


def explain_segment(rows: DataFrame, factors: DataFrame, metric: str, date: str, head: DataFrame, entity: str, dimension: str, segment: str) -> DataFrame:
    """The segment's factor row followed by the three entities that moved it most."""
    own = factors.where((F.col("dimension") == dimension) & (F.col("segment") == segment))
    inside = drilldown(rows, metric, date, head, entity, dimension, segment, 3)
    return own.withColumn("role", F.lit("segment")).unionByName(inside.withColumn("role", F.lit("entity")))


def count_entities(rows: DataFrame, metric: str, date: str, dimension: str, period: str) -> DataFrame:
    """Distinct entities with a positive metric in a period."""
    r = usable(rows, metric, date).where((period_of(date) == period) & (F.col(metric) > 0) & ~is_unknown(dimension))
    return r.agg(F.count_distinct(plain(dimension)).alias("n"))


def count_rows(rows: DataFrame, metric: str, date: str, period: str) -> DataFrame:
    return usable(rows, metric, date).where(period_of(date) == period).agg(F.count("*").alias("n"))


def metric_total(rows: DataFrame, metric: str, date: str, period: str) -> DataFrame:
    return usable(rows, metric, date).where(period_of(date) == period).agg(F.coalesce(F.sum(metric), F.lit(0)).cast("double").alias("total"))


def largest_record(rows: DataFrame, metric: str, date: str, dimension: str) -> DataFrame:
    """The largest positive record over the full history, ties by name."""
    r = usable(rows, metric, date).where((F.col(metric) > 0) & ~is_unknown(dimension))
    return r.select(F.col(dimension).cast("string").alias("segment"), F.col(date).cast("date").alias("date"), F.col(metric).cast("double").alias("value")).orderBy(F.desc("value"), "segment", "date").limit(1)


def resolve_value(factors: DataFrame, name: str) -> DataFrame:
    """Segments that a text names, longest first; `ambiguous` if several of the greatest
    length match."""
    compact = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    key = compact(F.col("segment"))
    hit = factors.where(~is_unknown("segment")).select("dimension", "segment", F.length(key).alias("_n")).where((F.col("_n") > 0) & F.contains(compact(F.lit(name)), key)).distinct()
    best = hit.agg(F.max("_n").alias("_best"))
    top = hit.join(F.broadcast(best), F.col("_n") == F.col("_best")).select("dimension", "segment")
    return top.withColumn("ambiguous", F.count("*").over(Window.partitionBy(F.lit(1))) > 1)


def top_decliner(rows: DataFrame, metric: str, date: str, head: DataFrame, entity: str, dimension: str | None = None, segment: str | None = None) -> DataFrame:
    """The entity that fell most, overall or in a segment."""
    part = rows if dimension is None else _inside(rows, dimension, segment)
    f = two_period_factors(part, metric, date, [entity], head)
    return f.where((F.col("impact") < 0) & ~is_unknown("segment")).orderBy("impact", "segment").limit(1)


def evidence(rows: DataFrame, metric: str, date: str, dims: Sequence[str], head: DataFrame, entity: str, dimension: str, segment: str) -> dict[str, DataFrame]:
    """Entities, overlaps and days (two each) for one segment."""
    return {
        "entities": drilldown(rows, metric, date, head, entity, dimension, segment, 2),
        "overlaps": overlap(rows, metric, date, dims, head, dimension, segment, 2),
        "dates": date_movement(rows, metric, date, head, dimension, segment, 2),
    }


def check_result(result: DataFrame, dimension: str | None = None, excluded: Sequence[str] = ()) -> DataFrame:
    """Rows of a result that break what was asked: another dimension or an excluded name."""
    bad = F.lit(False) if dimension is None else F.col("dimension") != dimension
    names = [" ".join(n.split()).lower() for n in excluded]
    return result.where(bad | (plain("segment").isin(names) if names else F.lit(False)))


# history --------------------------------------------------------------------------


def benchmark(current: DataFrame, history: DataFrame) -> DataFrame:
    """The current total against the mean of earlier runs of the same metric."""
    h = history.groupBy("metric_column").agg((F.sum("current_total").cast("double") / F.count("*")).alias("mean_total"), F.count("*").alias("runs"))
    delta = F.when(F.col("mean_total") == 0, 0.0).otherwise((F.col("current_total") - F.col("mean_total")) / F.abs("mean_total") * 100)
    return current.join(h, "metric_column").select("metric_column", "current_total", "mean_total", "runs", delta.alias("delta_percent"))


def recurring_pattern(current: DataFrame, history: DataFrame) -> DataFrame:
    """The newest earlier run of another period with the same metric and first cause."""
    keys = ["metric_column", "dimension", "segment"]
    h = history.select(*keys, F.col("current_period").alias("earlier_period"), "created_at")
    both = current.join(h, keys).where("earlier_period <> current_period")
    w = Window.partitionBy(*keys).orderBy(F.desc("created_at"), F.desc("earlier_period"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
