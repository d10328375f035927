"""Why a metric moved between its last two observed periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialise
from .aggregate import TOTAL, factors_from_totals, segment_totals

TOP, OFFSETS, TREND = 5, 3, 8


def headline(totals: DataFrame) -> DataFrame:
    """One row: the last two periods that have data (not calendar neighbours), their
    totals and the change; no row if there are fewer than two periods."""
    t = totals.where(F.col("dimension") == TOTAL).groupBy("metric_column", "period").agg(F.sum("metric_total").alias("total"))
    last = t.select("period").orderBy(F.desc("period")).limit(2)
    span = last.agg(F.min("period").alias("previous_period"), F.max("period").alias("current_period"), F.count("*").alias("n")).where("n = 2").drop("n")
    both = t.join(F.broadcast(span), F.col("period").isin(F.col("previous_period"), F.col("current_period")))
    sums = both.groupBy("metric_column", "previous_period", "current_period").agg(
        F.sum(F.when(F.col("period") == F.col("previous_period"), F.col("total"))).cast("double").alias("previous_total"),
        F.sum(F.when(F.col("period") == F.col("current_period"), F.col("total"))).cast("double").alias("current_total"),
        F.sum(F.when(F.col("period") == F.col("current_period"), F.col("total")).otherwise(-F.col("total"))).cast("double").alias("change"),
    )
    percent = F.when(F.col("previous_total") == 0, 0.0).otherwise(F.col("change") / F.col("previous_total") * 100)
    return sums.withColumn("change_percent", percent)


def headline_of(rows: DataFrame, metric: str, date: str) -> DataFrame:
    """The headline of rows from the sums of whole periods alone, for those who need no causes."""
    return headline(materialise(segment_totals(rows, metric, date, []), "periods"))


def dimension_rank(dims: Sequence[str]) -> Column:
    """Place of a dimension in the given order: the tie-break of equal impacts."""
    out = F.lit(len(dims))
    for k, d in enumerate(dims):
        out = F.when(F.col("dimension") == d, k).otherwise(out)
    return out


def _ranked(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    few = df.orderBy(*order).limit(k)
    return few.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def _strength(dims: Sequence[str]) -> list[Column]:
    return [F.desc(F.abs("impact")), dimension_rank(dims).asc(), F.col("segment").asc()]


def top_causes(factors: DataFrame, head: DataFrame, dims: Sequence[str], k: int = TOP) -> DataFrame:
    """The k strongest causes in the direction of the change, of any direction if none is."""
    f = factors.where("impact <> 0").join(F.broadcast(head.select("change")))
    f = f.withColumn("_same", (F.col("change") == 0) | (F.signum("impact") == F.signum("change")))
    few = f.orderBy(F.desc("_same"), *_strength(dims)).limit(k)
    few = few.withColumn("_any", F.max("_same").over(Window.partitionBy(F.lit(1)))).where("_same or not _any")
    return _ranked(few.drop("_same", "_any", "change"), _strength(dims), k)


def offsetting_causes(factors: DataFrame, head: DataFrame, dims: Sequence[str], k: int = OFFSETS) -> DataFrame:
    """The k strongest causes against the direction of the change; none if it is 0."""
    f = factors.where("impact <> 0").join(F.broadcast(head.select("change")))
    f = f.where((F.col("change") != 0) & (F.signum("impact") != F.signum("change"))).drop("change")
    return _ranked(f, _strength(dims), k)


#: Fixed values of the material view: least share of the change and least impact, and the
#: words that rank dimensions of equal impact.
MATERIAL, LEAST_IMPACT = 0.08, 0.01
KINDS = ("product|category|sku|brand", "region|state|city|location", "customer|client", "channel|source")


def kind_rank(dimension: Column) -> Column:
    out = F.lit(len(KINDS))
    for k, words in reversed(list(enumerate(KINDS))):
        out = F.when(F.lower(dimension).rlike(words), k).otherwise(out)
    return out


def material_causes(factors: DataFrame, head: DataFrame, k: int = TOP) -> DataFrame:
    """The view of the interactive mode: causes of at least 8% of the change, in its
    direction (in any if none is), with the share of at least 1 and a confidence that grows
    with the rows. Equal impacts are ordered by the kind of dimension, then by segment."""
    f = factors.join(F.broadcast(head.select("change")))
    f = f.where(F.abs("impact") >= F.greatest(MATERIAL * F.abs("change"), F.lit(LEAST_IMPACT)))
    same = (F.col("change") == 0) | (F.signum("impact") == F.signum("change"))
    strength = [F.desc(F.abs("impact")), kind_rank(F.col("dimension")).asc(), F.col("segment").asc(), F.col("dimension").asc()]
    few = f.withColumn("_same", same).orderBy(F.desc("_same"), *strength).limit(k)
    f = few.withColumn("_any", F.max("_same").over(Window.partitionBy(F.lit(1)))).where("_same or not _any").drop("_same", "_any")
    f = f.withColumn("share", F.least(F.lit(1.0), F.abs("impact") / F.greatest(F.abs("change"), F.lit(1.0))))
    score = F.least(F.lit(96.0), 54 + 34 * F.col("share") + F.least(F.lit(10.0), 1.5 * F.col("records")))
    return _ranked(f.withColumn("confidence", F.round(score).cast("int")).drop("change"), strength, k)


def overall_confidence(causes: DataFrame) -> DataFrame:
    """One row: the causes' confidence weighted by their shares, 50 without causes."""
    weighted = F.sum(F.col("confidence") * F.col("share")) / F.sum("share")
    return causes.agg(F.coalesce(F.round(weighted), F.lit(50.0)).cast("int").alias("confidence"))


def kpi_trend(totals: DataFrame, k: int = TREND) -> DataFrame:
    """period and total of the last k periods."""
    t = totals.where(F.col("dimension") == TOTAL).groupBy("period").agg(F.sum("metric_total").cast("double").alias("total"))
    return t.orderBy(F.desc("period")).limit(k)


def cause_trends(totals: DataFrame, causes: DataFrame, k: int = TREND) -> DataFrame:
    """dimension, segment, period and total of each cause over the last k periods, 0 where
    it has no rows."""
    periods = kpi_trend(totals, k).select("period")
    grid = causes.select("dimension", "segment").join(F.broadcast(periods))  # at most 8 causes times k periods
    own = totals.groupBy("dimension", "segment", "period").agg(F.sum("metric_total").cast("double").alias("total"))
    return grid.join(own, ["dimension", "segment", "period"], "left").fillna(0.0, ["total"])


def cause_impact(totals: DataFrame, head: DataFrame, dimension: str, segment: str) -> DataFrame:
    """Change of one segment between the two periods (one row; 0 without rows)."""
    own = totals.where((F.col("dimension") == dimension) & (F.col("segment") == segment))
    f = factors_from_totals(own, head)
    return f.agg(F.coalesce(F.sum("impact"), F.lit(0.0)).alias("impact"))


def explain_change(rows: DataFrame, metric: str, date: str, dims: Sequence[str]) -> dict[str, DataFrame]:
    """headline, causes, offsets, trend and cause trends of the metric's last change. The
    totals are few and read many times: they are written once."""
    return explain_totals(materialise(segment_totals(rows, metric, date, dims), "totals"), dims)


def explain_totals(totals: DataFrame, dims: Sequence[str]) -> dict[str, DataFrame]:
    """The same from stored totals."""
    head = headline(totals)
    factors = factors_from_totals(totals, head)
    causes = top_causes(factors, head, dims)
    return {
        "totals": totals, "headline": head, "factors": factors, "causes": causes,
        "offsets": offsetting_causes(factors, head, dims), "trend": kpi_trend(totals), "cause_trends": cause_trends(totals, causes),
    }


def month_name(period: Column) -> Column:
    return F.date_format(F.to_date(F.concat(period, F.lit("-01"))), "MMMM yyyy")


def summary(head: DataFrame, causes: DataFrame) -> DataFrame:
    """One row with the explanation as a sentence."""
    first = causes.where("rank = 1").select("dimension", "segment", "confidence", "counterfactual")
    both = head.join(first, how="left")
    way = F.when(F.col("change") < 0, "decreased").otherwise("increased")
    start = F.format_string("%s %s %.1f%% from %s to %s.", F.col("metric_column"), way, F.abs("change_percent"), month_name(F.col("previous_period")), month_name(F.col("current_period")))
    why = F.format_string(
        " The largest contributor was %s: %s. We are %d%% confident in this explanation. If it had stayed flat, %s would have been about %s.",
        F.col("dimension"), F.col("segment"), F.col("confidence"), F.lower("metric_column"), F.format_number("counterfactual", 0),
    )
    return both.select(F.concat(start, F.when(F.col("dimension").isNull(), " No material categorical driver was identified.").otherwise(why)).alias("summary"))


def totals_with_and_without(rows: DataFrame, metric: str, date: str, dims: Sequence[str], outlier: str = "is_outlier") -> tuple[DataFrame, DataFrame]:
    """Totals of all rows and of those not flagged, from one pass over the rows."""
    calm = F.when(~F.col(outlier), F.col(metric))
    both = segment_totals(rows.withColumn("_calm", calm), metric, date, dims, "_calm")
    both = materialise(both, "totals")
    rest = both.where("calm_count > 0").select("metric_column", "period", "dimension", "segment", F.col("calm_total").alias("metric_total"), F.col("calm_count").alias("record_count"))
    return both.drop("calm_total", "calm_count"), rest


def outlier_sensitivity(rows: DataFrame, metric: str, date: str, dims: Sequence[str], outlier: str = "is_outlier") -> DataFrame:
    """One row: the first cause with and without flagged rows, and whether leaving them
    out changes the explanation (another first cause, or its impact moves by at least half
    of itself and 1). Without flagged rows there is no row."""
    all_, calm = totals_with_and_without(rows, metric, date, dims, outlier)
    flagged = rows.where(F.col(outlier) & (~F.col("excluded") if "excluded" in rows.columns else F.lit(True)))
    return sensitivity_of_totals(all_, calm, flagged.agg(F.count("*").alias("outlier_rows")), dims)


def sensitivity_of_totals(all_: DataFrame, calm: DataFrame, flagged: DataFrame, dims: Sequence[str]) -> DataFrame:
    """The same from totals with and without the flagged rows, and the number of these."""

    def first(totals: DataFrame, prefix: str) -> DataFrame:
        head = headline(totals)
        c = top_causes(factors_from_totals(totals, head), head, dims, 1)
        cols = ["previous_total", "current_total", "change", "change_percent", "previous_period", "current_period"]
        both = head.select(*cols).join(c.select("dimension", "segment", "impact"), how="left")
        return both.select(*[F.col(x).alias(f"{prefix}_{x}") for x in both.columns])

    base, rest = first(all_, "all"), first(calm, "calm")
    own = calm.join(F.broadcast(base), (F.col("dimension") == F.col("all_dimension")) & (F.col("segment") == F.col("all_segment")))
    sign = F.when(F.col("period") == F.col("all_current_period"), F.col("metric_total")).when(F.col("period") == F.col("all_previous_period"), -F.col("metric_total")).otherwise(0)
    without = own.agg(F.coalesce(F.sum(sign).cast("double"), F.lit(0.0)).alias("impact_without"))
    one = base.join(rest, how="left").join(without).join(flagged).where("outlier_rows > 0")
    moved = F.col("all_impact") - F.col("impact_without")
    other = F.col("calm_dimension").isNull() | (F.col("all_dimension") != F.col("calm_dimension")) | (F.col("all_segment") != F.col("calm_segment"))
    changed = F.col("all_dimension").isNotNull() & (other | (F.abs(moved) >= F.greatest(F.lit(1.0), F.abs("all_impact") * 0.5)))
    return one.select(
        "outlier_rows", "all_dimension", "all_segment", "all_impact", "calm_dimension", "calm_segment", "calm_impact",
        "impact_without", moved.alias("outlier_impact"), F.col("calm_change").alias("change_without"), changed.alias("explanation_changed"),
    )


def explain_robustly(rows: DataFrame, metric: str, date: str, dims: Sequence[str], outlier: str = "is_outlier") -> DataFrame:
    """The causes to show: those without flagged rows, with a confidence of at most 65, if
    leaving the rows out changes the explanation (and there are such causes); else those of
    all rows."""
    all_, calm = totals_with_and_without(rows, metric, date, dims, outlier)
    flagged = rows.where(F.col(outlier) & (~F.col("excluded") if "excluded" in rows.columns else F.lit(True)))
    changed = materialise(sensitivity_of_totals(all_, calm, flagged.agg(F.count("*").alias("outlier_rows")), dims), "sensitivity")
    return robust_causes(all_, calm, changed, dims)


def robust_causes(all_: DataFrame, calm: DataFrame, sensitivity: DataFrame, dims: Sequence[str]) -> DataFrame:
    """The causes of explain_robustly from the totals and the row of outlier_sensitivity."""
    rest = explain_totals(calm, dims)["causes"].withColumn("confidence", F.least("confidence", F.lit(65)))
    both = explain_totals(all_, dims)["causes"].withColumn("_calm", F.lit(False)).unionByName(rest.withColumn("_calm", F.lit(True)))
    usable = F.col("explanation_changed") & F.col("calm_dimension").isNotNull()
    flag = sensitivity.agg(F.coalesce(F.bool_or(usable), F.lit(False)).alias("_changed"))
    return both.join(F.broadcast(flag), F.col("_calm") == F.col("_changed")).drop("_calm", "_changed")
