"""Review flags of cleaned rows: duplicates, outliers, and batches of manual edits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialise

ISSUE = "struct<type:string,column:string,message:string>"
CHANGE = "struct<column:string,from:string,to:string,reason:string>"
#: So many edits are sent to all tasks; more are joined by sorting, as they do not fit the driver.
FEW_EDITS = 10_000
#: An IQR range needs so many numbers and reaches so many IQRs.
LEAST_NUMBERS, REACH = 5, 1.5
ENTITY = "(?i)company|customer|client|employer|organi[sz]ation"


def issue(type_: str, column: str | None, message: Column | str) -> Column:
    message = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(type_).alias("type"), F.lit(column).cast("string").alias("column"), message.alias("message"))


def change(column: str, old: Column, new: Column, reason: str | Column) -> Column:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return F.struct(F.lit(column).alias("column"), old.cast("string").alias("from"), new.cast("string").alias("to"), reason.alias("reason"))


def add_issue(issues: Column, new: Column, where: Column) -> Column:
    """The issues with a new one, unless it is there already."""
    return F.when(where & ~F.exists(issues, lambda i: i == new), F.array_append(issues, new)).otherwise(issues)


def row_signature(columns: Sequence[str]) -> Column:
    """SHA-256 of the JSON of these columns, nulls included."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false"}), 256)


def exact_duplicates(rows: DataFrame, columns: Sequence[str] | None = None, order: str = "row_number", earlier: DataFrame | None = None) -> DataFrame:
    """Adds row_signature (unless columns is None and it is there), exact_duplicate and
    excluded. The first row of a signature stays; with `earlier`, a table with a
    row_signature, rows that are there already are duplicates too.

    The first row is found by an aggregation, so a signature that many rows share is
    pre-aggregated before the shuffle, and joined back where AQE can split it.
    """
    if columns is not None:
        rows = rows.withColumn("row_signature", row_signature(columns))
    first = rows.groupBy("row_signature").agg(F.min(order).alias("_first"))
    out = rows.join(first, "row_signature").withColumn("exact_duplicate", F.col(order) != F.col("_first")).drop("_first")
    if earlier is not None:
        seen = earlier.select("row_signature").distinct().withColumn("_seen", F.lit(True))
        out = out.join(seen, "row_signature", "left").withColumn("exact_duplicate", F.col("exact_duplicate") | F.col("_seen").isNotNull()).drop("_seen")
    had = F.col("excluded") if "excluded" in rows.columns else F.lit(False)
    return out.withColumn("excluded", had | F.col("exact_duplicate"))


def novel_rows(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows whose signature is not stored yet."""
    return rows.join(stored.select("row_signature"), "row_signature", "left_anti")


def possible_duplicates(rows: DataFrame, entity: str, date: str, metric: str, order: str = "row_number") -> DataFrame:
    """Adds possible_duplicate and, if the rows have issues, an issue to every member of a
    group of not excluded rows with the same entity (case and spacing aside), date and
    metric. Later rows name the first; the first names the second. That the first shares
    its key with each later one is in `duplicate_links`, a row each, so that no row's
    issues grow with its group."""
    named, live = _duplicate_keys(rows, entity, date, metric)
    k = ["_k0", "_k1", "_k2"]
    groups = live.groupBy(*k).agg(F.count("*").alias("_n"), F.min(order).alias("_first")).where("_n > 1")
    second = live.join(groups, k).where(F.col(order) != F.col("_first")).groupBy(*k).agg(F.min(order).alias("_second"))
    out = named.join(groups.join(second, k), k, "left")
    hit = F.col("_n").isNotNull()
    if "excluded" in rows.columns:
        hit = hit & ~F.col("excluded")
    out = out.withColumn("possible_duplicate", hit)
    if "issues" in rows.columns:
        other = F.when(F.col(order) == F.col("_first"), F.col("_second")).otherwise(F.col("_first"))
        text = F.format_string("Shares %s, date, and KPI value with row %d; kept for your review.", F.lit(entity.lower()), other)
        out = out.withColumn("issues", add_issue(F.col("issues"), issue("possible-duplicate", None, text), F.col("possible_duplicate")))
    return out.select(*rows.columns, "possible_duplicate") if "possible_duplicate" not in rows.columns else out.select(*rows.columns)


def duplicate_links(rows: DataFrame, entity: str, date: str, metric: str, order: str = "row_number") -> DataFrame:
    """first and later: each possible duplicate with the first row of its group."""
    _, live = _duplicate_keys(rows, entity, date, metric)
    k = ["_k0", "_k1", "_k2"]
    first = live.groupBy(*k).agg(F.min(order).alias("first"))
    return live.join(first, k).where(F.col(order) != F.col("first")).select("first", F.col(order).alias("later"))


def _duplicate_keys(rows: DataFrame, entity: str, date: str, metric: str) -> tuple[DataFrame, DataFrame]:
    """The rows with the three keys of possible duplicates, and those that can be one."""
    keys = [F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.col(entity).cast("string"), "[._-]+", " "), r"\s+", " "))), F.col(date), F.col(metric)]
    named = rows.withColumns({f"_k{i}": k for i, k in enumerate(keys)})
    live = named.where(F.col("_k0").isNotNull() & F.col(date).isNotNull() & F.col(metric).isNotNull())
    if "excluded" in rows.columns:
        live = live.where("not excluded")
    return named, live


def iqr_bounds(rows: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """One row for each column with an IQR range: column, q1, q3, low and high. Quartiles
    interpolate at (n - 1) * f; `approximate` takes them from a sketch of bounded size."""
    live = rows.where("not excluded") if "excluded" in rows.columns else rows
    long = live.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]))).where("value is not null")
    if approximate:
        q = F.percentile_approx("value", [0.25, 0.75], 10_000)
        b = long.groupBy("column").agg(F.count("*").alias("n"), q.alias("q")).select("column", "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    else:
        b = exact_quartiles(long)
    return bounds_of(b)


def bounds_of(b: DataFrame) -> DataFrame:
    """The ranges from quartiles (column, n, q1, q3), such as exact_quartiles or a RankStore give."""
    iqr = F.col("q3") - F.col("q1")
    return b.where((F.col("n") >= LEAST_NUMBERS) & (iqr > 0)).select("column", "n", "q1", "q3", (F.col("q1") - REACH * iqr).alias("low"), (F.col("q3") + REACH * iqr).alias("high"))


def exact_quartiles(long: DataFrame) -> DataFrame:
    """column, n, q1 and q3 of the values of each column, exactly. Equal values are counted
    first; the counts are dealt by range of (column, value), so no task gets a column. Sums
    over whole partitions tell which of them hold the four ranks that are asked for, and only
    those are put in order."""
    counts = long.groupBy("column", "value").agg(F.count("*").alias("k"))
    parts = materialise(counts.repartitionByRange("column", "value").withColumn("part", F.spark_partition_id()), "quartiles")
    sums = parts.groupBy("column", "part").agg(F.sum("k").alias("k"))
    before = Window.partitionBy("column").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    spans = sums.select("column", "part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("start"), "k")
    at = lambda f: (F.col("n") - 1) * f
    ranks = F.array_distinct(F.array(*[g(at(f)).cast("long") for f in (0.25, 0.75) for g in (F.floor, F.ceil)]))
    asked = sums.groupBy("column").agg(F.sum("k").alias("n")).select("column", "n", F.explode(ranks).alias("rank"))
    held = spans.join(asked, "column").where((F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("start") + F.col("k")))
    held = held.select("column", "part", "start", "n", "rank")
    upto = Window.partitionBy("column", "part").orderBy("value")
    placed = parts.join(held.select("column", "part").distinct(), ["column", "part"], "left_semi").withColumn("upto", F.sum("k").over(upto))
    found = held.join(placed, ["column", "part"]).where((F.col("rank") < F.col("start") + F.col("upto")) & (F.col("rank") >= F.col("start") + F.col("upto") - F.col("k")))
    values = found.groupBy("column", "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("v"))  # at most four

    def quartile(f: float) -> Column:
        low, high = (F.element_at("v", g(at(f)).cast("long")) for g in (F.floor, F.ceil))
        return low + (high - low) * (at(f) - F.floor(at(f)))

    return values.select("column", "n", quartile(0.25).alias("q1"), quartile(0.75).alias("q3"))


def outliers(rows: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Adds is_outlier and outlier_columns (those out of their range), and an issue for
    each if the rows have issues. The bounds are one row for each number column."""
    bounds = iqr_bounds(rows, columns, approximate)
    one = bounds.agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct("low", "high")))).alias("_bounds"))
    live = ~F.col("excluded") if "excluded" in rows.columns else F.lit(True)

    def out_of(c: str) -> Column:
        b = F.try_element_at("_bounds", F.lit(c))
        return F.coalesce(live & ((F.col(c) < b["low"]) | (F.col(c) > b["high"])), F.lit(False))

    out = rows.join(F.broadcast(one))  # one row with the bounds of all columns
    flagged = F.filter(F.array(*[F.when(out_of(c), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    out = out.withColumn("outlier_columns", flagged).withColumn("is_outlier", F.size("outlier_columns") > 0)
    if "issues" in rows.columns:
        for c in columns:
            b = F.try_element_at("_bounds", F.lit(c))
            text = F.format_string("%s is outside the IQR review range (%s to %s).", F.format_number(F.col(c).cast("double"), 2), F.format_number(b["low"], 2), F.format_number(b["high"], 2))
            out = out.withColumn("issues", add_issue(F.col("issues"), issue("outlier", c, text), F.array_contains("outlier_columns", c)))
    return out.drop("_bounds")


EDIT = "struct<seq:long,action:string,column:string,value:string,readable:boolean>"


def _changed(column: str, reason: str, old: Column, new: Column) -> Column:
    return change(column, old, new, reason)


def _unreadable(column: str, e: Column) -> Column:
    return (e["action"] == "edit") & (e["column"] == column) & ~e["readable"]


def apply_edits(rows: DataFrame, edits: DataFrame, kinds: dict[str, str], reason: str = "Edited by hand") -> DataFrame:
    """Apply a table of edits (row_number, action, column, value and, to put several edits
    of a row in order, seq) to review rows: exclude, restore (also clears duplicate issues),
    keep (a possible duplicate), undo (the last change of a column), edit (a value, parsed by
    the column's kind; a value that does not parse leaves the cell and adds an issue).

    Edits of a row take effect one after the other, by seq (0 where there is none), then
    action, column and value: of exclude and restore the last counts; an undo takes back
    the edit before it, or, if there is none left, a change that was stored. The edits are
    parsed, not the rows."""
    from ..functions.dates import parse_date
    from ..functions.numbers import parse_number

    def typed(kind: str) -> Column:
        v = F.col("value")
        return (parse_number(v) if kind == "number" else parse_date(v) if kind == "date" else F.trim(v)).cast("string")

    seq = F.col("seq").cast("long") if "seq" in edits.columns else F.lit(0).cast("long")
    value = F.lit(None).cast("string")
    for kind in sorted(set(kinds.values())):
        value = F.when(F.col("column").isin(*[c for c, k in kinds.items() if k == kind]), typed(kind)).otherwise(value)
    ready = edits.select("row_number", seq.alias("seq"), "action", "column", value.alias("value"), value.isNotNull().alias("readable"))
    per = ready.groupBy("row_number").agg(F.array_sort(F.collect_list(F.struct("seq", "action", "column", "value", "readable"))).alias("_edits"))
    few = edits.limit(FEW_EDITS + 1).count() <= FEW_EDITS
    out = rows.join(per.hint("broadcast" if few else "merge"), "row_number", "left").withColumn("_edits", F.coalesce("_edits", F.array().cast(f"array<{EDIT}>")))

    def has(action: str) -> Column:
        return F.exists("_edits", lambda e: e["action"] == action)

    shown = F.try_element_at(F.filter("_edits", lambda e: e["action"].isin("exclude", "restore")), F.lit(-1))["action"]
    new = {"excluded": F.when(shown == "exclude", True).when(shown == "restore", False).otherwise(F.col("excluded"))}
    if "possible_duplicate" in rows.columns:
        new["possible_duplicate"] = F.col("possible_duplicate") & ~has("keep")
    issues = F.when(has("restore"), F.filter("issues", lambda i: i["type"] != "exact-duplicate")).otherwise(F.col("issues"))
    issues = F.when(has("keep"), F.filter(issues, lambda i: i["type"] != "possible-duplicate")).otherwise(issues)

    def folded(c: str) -> Column:
        """The column's values by hand that stand, and how many stored changes are undone."""
        start = F.struct(F.array().cast("array<string>").alias("values"), F.lit(0).alias("undone"))

        def step(held: Column, e: Column) -> Column:
            n = F.size(held["values"])
            edited = F.struct(F.array_append(held["values"], e["value"]).alias("values"), held["undone"].alias("undone"))
            popped = F.struct(F.slice(held["values"], 1, F.greatest(n - 1, F.lit(0))).alias("values"), (held["undone"] + F.when(n == 0, 1).otherwise(0)).alias("undone"))
            return F.when(e["column"] != c, held).when((e["action"] == "edit") & e["readable"], edited).when(e["action"] == "undo", popped).otherwise(held)

        return F.aggregate("_edits", start, step)

    def of(c: str) -> Column:
        return F.filter("changes", lambda x: x["column"] == c)

    out = out.withColumns({f"_by_{c}": folded(c) for c in kinds} | {f"_log_{c}": of(c) for c in kinds})
    kept, added = F.col("changes"), []
    for c, kind in kinds.items():
        hand, log = F.col(f"_by_{c}"), F.col(f"_log_{c}")
        left = F.greatest(F.size(log) - hand["undone"], F.lit(0))
        old = F.get(log, left)["from"]  # of the earliest change that is undone
        back = old.try_cast("double") if kind == "number" else F.try_to_date(old) if kind == "date" else old
        base = F.when((hand["undone"] > 0) & (F.size(log) > 0), back).otherwise(F.col(c))
        last = F.try_element_at(hand["values"], F.lit(-1))
        given = last.try_cast("double") if kind == "number" else F.try_to_date(last) if kind == "date" else last
        new[c] = F.when(F.size(hand["values"]) > 0, given).otherwise(base)
        gone = F.slice(log, left + 1, F.size(log))
        kept = F.when(hand["undone"] > 0, F.array_except(kept, gone)).otherwise(kept)
        before = F.concat(F.array(base.cast("string")), hand["values"])
        added.append(F.zip_with(F.slice(before, 1, F.size(hand["values"])), hand["values"], partial(_changed, c, reason)))
        bad = F.exists("_edits", partial(_unreadable, c))
        issues = F.concat(issues, F.when(bad, F.array(issue("invalid-edit", c, "The new value could not be read"))).otherwise(F.array().cast(f"array<{ISSUE}>")))
    return out.withColumns({**new, "issues": issues, "changes": F.concat(kept, *added)}).select(*rows.columns)


def revert_changes(rows: DataFrame, column: str, reason: str, values_like: str) -> DataFrame:
    """Take back automatic changes of a column for a reason, from values that match a
    pattern, where their result still stands."""

    def old(x):
        return (x["column"] == column) & (x["reason"] == reason) & x["from"].rlike(values_like)

    last = F.try_element_at(F.filter("changes", old), F.lit(-1))
    stands = last.isNotNull() & (F.col(column) == last["to"])
    return rows.withColumns({
        column: F.when(stands, last["from"]).otherwise(F.col(column)),
        "changes": F.when(stands, F.filter("changes", lambda x: ~old(x))).otherwise(F.col("changes")),
    })
