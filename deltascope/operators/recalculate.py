"""The explanation of stored rows after a review: edits, decisions on categories, another
metric. Cleaning, duplicate flags and outlier flags are not made again.

`recalculate` sums all rows. `recalculate_edits` keeps the totals up instead: sums take
back what the edited rows were and add what they are now, so its cost follows the number of
edits, not that of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialise
from ..sources.versioned import StoredImport
from .categories import decide_containment
from .clean import cleaning_log
from .aggregate import ALL, KEYS, segment_totals
from .explain import explain_totals, robust_causes, sensitivity_of_totals, totals_with_and_without
from .profile import Column, choose_metric, date_of, dimensions_of, require_roles
from .review import apply_edits


def recalculate(review: DataFrame, columns: Sequence[Column], edits: DataFrame | None = None, proposals: DataFrame | None = None, decisions: DataFrame | None = None, metric: str | None = None) -> dict:
    """Apply what a reviewer decided to the stored rows and explain the change anew.

    edits: see apply_edits; proposals and decisions: see decide_containment; metric: another
    of the candidates. Returns the new rows (`rows`), `columns`, `proposals`, and from one
    pass over the rows `totals`, `headline`, `causes` (those without outliers if leaving them
    out changes the explanation), `offsets`, `trend`, `sensitivity` and `log`. An error says
    so if no metric or date is left."""
    columns = choose_metric(list(columns), metric) if metric else list(columns)
    chosen, date = require_roles(columns)
    dims = dimensions_of(columns)
    rows = review
    if edits is not None:
        kinds = {c.name: c.kind for c in columns if c.name in review.columns and not c.recipe and c.parts is None}
        rows = apply_edits(rows, edits, kinds)
    if decisions is not None:
        rows, proposals = decide_containment(rows, proposals, decisions)
    if edits is not None or decisions is not None:
        rows = materialise(rows, "reviewed")
    all_, calm = totals_with_and_without(rows, chosen.name, date.name, dims)
    flagged = rows.where("is_outlier and not excluded").agg(F.count("*").alias("outlier_rows"))
    return {"rows": rows, "columns": columns, "proposals": proposals, "log": cleaning_log(rows)} | _explained(all_, calm, flagged, dims)


def _explained(all_: DataFrame, calm: DataFrame, flagged: DataFrame, dims: Sequence[str]) -> dict:
    """What is shown of totals with and without the flagged rows and the number of these."""
    sensitivity = materialise(sensitivity_of_totals(all_, calm, flagged, dims), "sensitivity")
    found = explain_totals(all_, dims)
    changed = sensitivity.where("explanation_changed and calm_dimension is not null").count() > 0  # one row
    shown = explain_totals(calm, dims) if changed else found
    return {
        "totals": all_, "headline": found["headline"], "causes": robust_causes(all_, calm, sensitivity, dims),
        "offsets": shown["offsets"], "trend": found["trend"], "sensitivity": sensitivity,
    }


#: The dimension under which the number of flagged rows is kept, and the type of kept sums:
#: sums that rows are taken out of again must be exact.
FLAGGED, EXACT = "__outliers__", "decimal(32,6)"
SUMS = ("metric_total", "record_count", "calm_total", "calm_count")


def kept_totals(rows: DataFrame, metric: str, date: str, dims: Sequence[str]) -> DataFrame:
    """Totals of review rows with and without the flagged ones, and the number of these, as
    sums that later edits are added to. Several metrics can be kept in one table."""
    value = F.col(metric).cast(EXACT)
    own = rows.withColumns({metric: value, "_calm": F.when(~F.col("is_outlier"), value)})
    sums = segment_totals(own, metric, date, dims, "_calm").select(*KEYS, *SUMS)
    flagged = rows.where("is_outlier and not excluded").agg(F.count("*").alias("n"))
    none = F.lit(0).cast(EXACT)
    row = flagged.select(F.lit(metric).alias("metric_column"), F.lit("").alias("period"), F.lit(FLAGGED).alias("dimension"), F.lit(ALL).alias("segment"), none.alias("metric_total"), "n", none.alias("calm_total"), F.lit(0).cast("long").alias("calm_count"))
    return sums.unionByName(row.withColumnRenamed("n", "record_count")).select(*KEYS, *[F.col(c).cast("decimal(38,6)" if c.endswith("total") else "long").alias(c) for c in SUMS])


def update_totals(kept: DataFrame, old: DataFrame, new: DataFrame, metric: str, date: str, dims: Sequence[str]) -> DataFrame:
    """The kept totals after rows changed from `old` to `new`. Segments that no row is left
    of go; rows of other metrics stay."""
    back = kept_totals(old, metric, date, dims)
    back = back.select(*KEYS, *[(-F.col(c)).alias(c) for c in SUMS])
    all_ = kept.unionByName(back).unionByName(kept_totals(new, metric, date, dims))
    sums = all_.groupBy(*KEYS).agg(*[F.sum(c).cast("decimal(38,6)" if c.endswith("total") else "long").alias(c) for c in SUMS])
    return sums.where((F.col("record_count") > 0) | (F.col("dimension") == FLAGGED))


def explain_kept(kept: DataFrame, metric: str, dims: Sequence[str]) -> dict:
    """What recalculate finds, from kept totals alone."""
    own = kept.where(F.col("metric_column") == metric)
    sums, flagged = own.where(F.col("dimension") != FLAGGED), own.where(F.col("dimension") == FLAGGED)
    all_ = sums.select(*KEYS, "metric_total", "record_count")
    calm = sums.where("calm_count > 0").select(*KEYS, F.col("calm_total").alias("metric_total"), F.col("calm_count").alias("record_count"))
    return _explained(all_, calm, flagged.agg(F.coalesce(F.sum("record_count"), F.lit(0)).alias("outlier_rows")), dims)


def recalculate_edits(stored: StoredImport, kept: DataFrame, edits: DataFrame, columns: Sequence[Column]) -> dict:
    """Apply edits to a stored import and explain the change anew. Of the rows only those that
    the edits name are read, changed and put back (an upsert); of the totals only their
    segments change. Returns the edited rows (`rows`), the new totals (`kept`, written) and
    what `explain_kept` gives."""
    chosen, date = require_roles(columns)
    dims = dimensions_of(columns)
    low, high = edits.agg(F.min("row_number"), F.max("row_number")).first()
    if low is None:
        return {"rows": stored.rows(0, -1), "kept": kept} | explain_kept(kept, chosen.name, dims)
    old = materialise(stored.rows(low, high).join(edits.select("row_number").distinct().hint("merge"), "row_number", "left_semi"), "edited-before")
    kinds = {c.name: c.kind for c in columns if c.name in old.columns and not c.recipe and c.parts is None}
    new = materialise(apply_edits(old, edits, kinds), "edited")
    stored.upsert(new, None)
    fresh = materialise(update_totals(kept, old, new, chosen.name, date.name, dims), "kept-totals")
    return {"rows": new, "kept": fresh} | explain_kept(fresh, chosen.name, dims)
