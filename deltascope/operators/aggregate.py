"""Metric totals by period and by every dimension value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

#: Fixed labels of the grand-total rows and of missing category values.
TOTAL, ALL, UNKNOWN = "__total__", "__all__", "Unknown"
KEYS = ("metric_column", "period", "dimension", "segment")


def period_of(date: str | Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def usable(rows: DataFrame, metric: str, date: str) -> DataFrame:
    """Rows that count: not excluded, with a metric and a date."""
    out = rows.where(F.col(metric).isNotNull() & F.col(date).isNotNull())
    return out.where("not excluded") if "excluded" in rows.columns else out


def cells(rows: DataFrame, dims: Sequence[str], keep: Sequence[Column]) -> DataFrame:
    """One row for each dimension of each row: dimension, segment and the kept columns.
    A missing value is the segment Unknown."""
    pairs = [F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit(UNKNOWN)).alias("segment")) for d in dims]
    return rows.select(*keep, F.inline(F.array(*pairs)))


def segment_totals(rows: DataFrame, metric: str, date: str, dims: Sequence[str], calm: str | None = None) -> DataFrame:
    """metric_column, period, dimension, segment, metric_total and record_count: parallel
    one-dimensional groupings, in one pass with map-side partial sums. The row of the
    whole period has the labels TOTAL and ALL. `calm` names a second metric, null on the
    rows to leave out of calm_total and calm_count."""
    values = {"_m": (metric, "metric_total", "record_count")} | ({"_c": (calm, "calm_total", "calm_count")} if calm else {})
    r = usable(rows, metric, date).select(period_of(date).alias("period"), *[F.col(c).alias(v) for v, (c, *_) in values.items()], *dims)
    r = r.withColumns({TOTAL: F.lit(ALL)})
    grouped = cells(r, [TOTAL, *dims], ["period", *values]).groupBy("period", "dimension", "segment")
    out = grouped.agg(*[x for v, (_, total, n) in values.items() for x in (F.sum(v).alias(total), F.count(v).alias(n))])
    return out.select(F.lit(metric).alias("metric_column"), *out.columns)


#: The dimension under which days of the month are kept among pairs of segments.
DAYS = "__day__"
PAIR = ("metric_column", "period", "dimension", "segment", "other_dimension", "other_segment")


#: Rows that a task takes to sum pairs with a dimension of many values, and the most
#: combinations of values of the others with the periods.
PART_ROWS, FEW_SUMS = 250_000, 2_000_000


def pair_totals(rows: DataFrame, metric: str, date: str, dims: Sequence[str]) -> DataFrame:
    """Totals of every pair of segments of different dimensions (and days of the month) by
    period. Each pair stands once, in the order of the dimensions. Questions inside a segment
    are answered from these without the rows, see questions.inside_totals.

    Rows equal in all dimensions of few values are summed map-side, then unfolded into their
    pairs. Pairs with a dimension of many values hardly repeat in a task, so rows are dealt by
    it first, in parts whose number follows that of the rows, and each part sums its pairs to
    the end: what a task holds does not grow with the table, and no pair is shuffled. Equal
    rows are made one before, so that a segment with much of the table is no task's burden.
    Which dimensions have few values is estimated; the totals do not depend on it. The rows are
    read several times: pass a written table."""
    names = [*dims, DAYS]
    own = [f"_{k}" for k in range(len(names))]
    segments = [F.coalesce(c.cast("string"), F.lit(UNKNOWN)) for c in (*map(F.col, dims), F.dayofmonth(date))]
    r = usable(rows, metric, date)
    at = F.col(date) if isinstance(r.select(date).schema[0].dataType, DateType) else F.col(date).cast("timestamp")
    r = r.select(F.trunc(at, "month").alias("period"), F.col(metric).alias("_m"), F.lit(1).cast("long").alias("_n"), *[c.alias(o) for c, o in zip(segments, own)])
    size = r.agg(F.count("*").alias("rows"), *[F.approx_count_distinct(c).alias(c) for c in ("period", *own)]).first()  # one row
    parts = max(1, -(-size["rows"] // PART_ROWS))
    few = _few_values([size[c] for c in own], size["period"])
    many = [k for k in range(len(names)) if k not in few]
    sums = [F.sum("_m").alias("_m"), F.sum("_n").alias("_n")]
    values = [own[k] for k in few]

    def in_parts(df: DataFrame, *keys: str) -> DataFrame:
        return df.repartition(parts, "period", *keys).groupBy("period", *keys).agg(*sums)

    def named(df: DataFrame, i: Column, a: str, j: Column, b: str) -> DataFrame:
        turned, name = i > j, lambda k: F.element_at(F.array(*map(F.lit, names)), k + 1)
        first = lambda x, y: F.when(turned, y).otherwise(x)
        pair = [first(name(i), name(j)), first(F.col(a), F.col(b)), first(name(j), name(i)), first(F.col(b), F.col(a))]
        return df.select(F.lit(metric).alias("metric_column"), period_of("period").alias("period"), *[c.alias(n) for c, n in zip(pair, PAIR[2:])], "_m", "_n")

    found = []
    if len(few) > 1:
        pairs = [F.struct(F.lit(i).alias("_i"), F.col(own[i]).alias("_a"), F.lit(j).alias("_j"), F.col(own[j]).alias("_b")) for n, i in enumerate(few) for j in few[n + 1 :]]
        unfolded = r.groupBy("period", *values).agg(*sums).select("period", "_m", "_n", F.inline(F.array(*pairs)))
        found.append(named(unfolded.groupBy("period", "_i", "_a", "_j", "_b").agg(*sums), F.col("_i"), "_a", F.col("_j"), "_b"))
    for n, i in enumerate(many):
        if few:
            others = [F.struct(F.lit(j).alias("_j"), F.col(own[j]).alias("_b")) for j in few]
            dealt = in_parts(r, own[i], *values).repartition(parts, "period", own[i])
            unfolded = dealt.select("period", own[i], "_m", "_n", F.inline(F.array(*others)))
            found.append(named(unfolded.groupBy("period", own[i], "_j", "_b").agg(*sums), F.lit(i), own[i], F.col("_j"), "_b"))
        for j in many[n + 1 :]:
            found.append(named(in_parts(in_parts(r, own[i], own[j], *values), own[i], own[j]), F.lit(i), own[i], F.lit(j), own[j]))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    kind = r.agg(F.sum("_m")).schema[0].dataType  # sums of sums may be wider
    return out.select(*PAIR, F.col("_m").cast(kind).alias("metric_total"), F.col("_n").alias("record_count"))


def _few_values(counts: Sequence[int], periods: int) -> list[int]:
    """Places of the dimensions of fewest values, as many as have at most FEW_SUMS combinations."""
    few, combinations = [], periods
    for k in sorted(range(len(counts)), key=lambda k: counts[k]):
        combinations *= counts[k]
        if combinations > FEW_SUMS:
            break
        few.append(k)
    return sorted(few)


def merge_totals(*parts: DataFrame) -> DataFrame:
    """Totals of several batches added up, as decimal(24,4)."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy(*KEYS).agg(F.sum("metric_total").cast("decimal(24,4)").alias("metric_total"), F.sum("record_count").alias("record_count"))


def two_period_factors(rows: DataFrame, metric: str, date: str, dims: Sequence[str], headline: DataFrame) -> DataFrame:
    """dimension, segment, previous, current, impact, records, share and confidence of
    every segment of these rows; a segment absent in a period counts 0 there."""
    r = usable(in_periods(rows, date, headline), metric, date).select(period_of(date).alias("period"), F.col(metric).alias("_m"), *dims)
    return _measures(cells(r, dims, ["period", "_m"]), "_m", F.lit(1), headline)


def in_periods(rows: DataFrame, date: str, headline: DataFrame) -> DataFrame:
    """The rows of the headline's two periods. The periods (one row) are read first, so that
    the filter has constants and reaches the scan of the table that holds the date."""
    span = headline.select("previous_period", "current_period").first()
    if span is None:
        return rows.limit(0)
    ok = F.lit(False)
    for p in span:
        first = F.to_date(F.lit(f"{p}-01"))
        ok = ok | ((F.col(date) >= first) & (F.col(date) < F.add_months(first, 1)))
    return rows.where(ok)


def comparison_rows(rows: DataFrame, sensitivity: DataFrame, outlier: str = "is_outlier") -> DataFrame:
    """The rows that questions are answered on: without the flagged ones if leaving them out
    changes the explanation (a row of outlier_sensitivity says so), else all."""
    changed = sensitivity.agg(F.coalesce(F.bool_or("explanation_changed"), F.lit(False)).alias("c")).first().c  # one value
    return rows.where(~F.col(outlier)) if changed else rows


def factors_from_totals(totals: DataFrame, headline: DataFrame) -> DataFrame:
    """The same from stored totals."""
    return _measures(totals.where(F.col("dimension") != TOTAL), "metric_total", F.col("record_count"), headline)


def _measures(long: DataFrame, value: str, records: Column, headline: DataFrame) -> DataFrame:
    h = F.broadcast(headline.select("previous_period", "current_period", "change", "current_total"))  # one row
    part = long.join(h, F.col("period").isin(F.col("previous_period"), F.col("current_period")))
    m = F.col(value)
    out = part.groupBy("dimension", "segment").agg(
        F.sum(F.when(F.col("period") == F.col("previous_period"), m).otherwise(0)).cast("double").alias("previous"),
        F.sum(F.when(F.col("period") == F.col("current_period"), m).otherwise(0)).cast("double").alias("current"),
        F.sum(F.when(F.col("period") == F.col("current_period"), m).otherwise(-m)).cast("double").alias("impact"),
        F.sum(records).alias("records"),
        F.first("change").alias("_change"),
        F.first("current_total").alias("_total"),
    )
    share = F.when(F.col("_change") == 0, 0.0).otherwise(F.least(F.lit(1.0), F.abs("impact") / F.abs("_change")))
    out = out.withColumn("share", share)
    return out.select(
        "dimension", "segment", "previous", "current", "impact", "records", "share",
        F.round(F.least(F.lit(99.0), 65 + 34 * F.col("share"))).cast("int").alias("confidence"),
        (F.col("_total") - F.col("impact")).alias("counterfactual"),
    )
