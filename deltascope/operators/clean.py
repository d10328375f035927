"""The cleaning pass: typed columns, and for each row what was changed and what is wrong."""

from __future__ import annotations

from pyspark.sql import Column as C
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import is_ambiguous, parse_date, parts_date
from ..functions.numbers import derived_amount, parse_number
from ..functions.text import UNKNOWN, bare_text, base_text, category_text, missing, normalise, title_case
from ..sources.scratch import materialise, spread
from .categories import apply_replacements, reconcile, simple_replacements
from .profile import Column, date_of, metric_of
from .review import CHANGE, ISSUE, ENTITY, change, exact_duplicates, issue, outliers, possible_duplicates

#: The reasons that changes are logged with.
NUMBER, DAY, PARTS, SPACE = "Standardised numeric or currency value", "Standardised date", "Resolved ambiguous date from Year/Month/Day columns", "Standardised category whitespace"


def _raw(name: str) -> C:
    return F.col("raw").getField(name)


def clean(rows: DataFrame, columns: list[Column], order: str = "row_number") -> DataFrame:
    """row_number, raw (a struct of the source's strings), a typed column for each profile,
    changes and issues. Values are parsed in one projection and audited in the next."""
    source = [c for c in rows.columns if c != order]
    out = rows.select(F.col(order), F.struct(*[F.col(f"`{c}`").cast("string").alias(c) for c in source]).alias("raw"))
    parts = next((c.parts for c in columns if c.parts), None)
    typed: dict[str, C] = {}
    if parts:
        typed["_parts"] = parts_date(*map(_raw, parts))
    for c in columns:
        raw = None if c.parts or c.recipe else _raw(c.name)
        if c.parts:
            continue
        if c.recipe:
            r = c.recipe
            of = lambda key: parse_number(_raw(r[key][0])) if key in r else None  # noqa: B023, E731
            mode = lambda key: r[key][1] if key in r else "amount"  # noqa: B023, E731
            typed[c.name] = derived_amount(parse_number(_raw(r["quantity"])), parse_number(_raw(r["unit"])), of("discount"), mode("discount"), of("tax"), mode("tax"))
        elif c.kind == "number":
            typed[c.name] = parse_number(raw)
        elif c.kind == "date":
            typed[f"_date_{c.name}"] = parse_date(raw, c.policy)
            typed[f"_unsure_{c.name}"] = is_ambiguous(raw)
        elif c.kind == "category":
            typed[c.name] = F.when(missing(raw), UNKNOWN).otherwise(category_text(raw))
        else:
            typed[c.name] = F.when(~missing(raw), base_text(raw))
        if raw is not None:
            typed[f"_none_{c.name}"] = missing(raw)
    out = out.withColumns(typed)
    final, changes, issues = {}, [], []

    def when(ok: C, what: C) -> C:
        return F.when(ok, what)

    for c in columns:
        if c.parts:
            final[c.name] = F.col("_parts")
            changes.append(when(F.col("_parts").isNotNull(), change(c.name, F.lit(None), F.col("_parts"), f"Derived date from {', '.join(c.parts)}")))
            issues.append(when(F.col("_parts").isNull(), issue("ambiguous-date", c.name, f"Could not derive a valid date from {', '.join(c.parts)}.")))
            continue
        if c.recipe:
            v = F.col(c.name)
            changes.append(when(v.isNotNull(), change(c.name, F.lit(None), v, f"Derived amount from {c.recipe['quantity']} x {c.recipe['unit']}")))
            issues.append(when(v.isNull(), issue("missing", c.name, f"Could not derive {c.label or c.name}: an input is missing or invalid.")))
            continue
        raw, none = _raw(c.name), F.col(f"_none_{c.name}")
        if c.kind == "number":
            v = F.col(c.name)
            bare = F.regexp_replace(bare_text(raw), ",", "")
            same = bare.rlike(r"^-?(0|[1-9]\d*)(\.\d*[1-9])?$") & (bare.try_cast("double") == v)
            changes.append(when(v.isNotNull() & ~F.coalesce(same, F.lit(False)), change(c.name, raw, v, NUMBER)))
            issues.append(when(none, issue("missing", c.name, "Missing numeric value")))
            issues.append(when(~none & v.isNull(), issue("invalid-number", c.name, "Could not parse numeric or currency value")))
        elif c.kind == "date":
            v, unsure = F.col(f"_date_{c.name}"), F.col(f"_unsure_{c.name}")
            by_parts = F.col("_parts").isNotNull() & (unsure | v.isNull()) if parts else F.lit(False)
            found = F.when(by_parts, F.col("_parts")).otherwise(v) if parts else v
            found = F.when(~none, found)
            final[c.name] = found
            why = F.when(by_parts, PARTS).otherwise(DAY)
            changes.append(when(found.isNotNull() & (found.cast("string") != raw), change(c.name, raw, found, why)))
            issues.append(when(~none & found.isNull(), issue("ambiguous-date", c.name, "Could not standardise date")))
            if parts:
                differs = v.isNotNull() & F.col("_parts").isNotNull() & (v != F.col("_parts")) & ~unsure & ~none
                issues.append(when(differs, issue("ambiguous-date", c.name, "Primary date conflicts with separate Year/Month/Day columns; kept for review.")))
        elif c.kind == "category":
            changes.append(when(~none & (F.col(c.name) != raw), change(c.name, raw, F.col(c.name), SPACE)))

    def known(xs: list[C], kind: str) -> C:
        return F.filter(F.array(*xs), lambda x: x.isNotNull()) if xs else F.array().cast(f"array<{kind}>")

    out = out.withColumns({**final, "changes": known(changes, CHANGE), "issues": known(issues, ISSUE)})
    return out.select(order, "raw", *[c.name for c in columns], "changes", "issues")


def review_table(rows: DataFrame, columns: list[Column], order: str = "row_number", fuzzy: bool = True, earlier: DataFrame | None = None, approximate: bool = False) -> DataFrame:
    """The whole import: clean, exact duplicates (on the cleaned rows before categories are
    merged), category reconciliation, possible duplicates and outliers (`approximate` takes
    their quartiles from a sketch of bounded size, for tables with many distinct numbers)."""
    import re

    names = [c.name for c in columns]
    out = exact_duplicates(materialise(clean(spread(rows), columns, order), "cleaned"), names, order, earlier)
    categories = [c.name for c in columns if c.kind == "category"]
    if categories:
        out = reconcile(materialise(out, "signed"), categories, fuzzy, names)
    out = materialise(out, "reconciled")
    metric, date = metric_of(columns), date_of(columns)
    entity = next((c.name for c in columns if c.kind in ("category", "identifier") and re.search(ENTITY, c.name)), None)
    out = possible_duplicates(out, entity, date.name, metric.name, order) if metric and date and entity else out.withColumn("possible_duplicate", F.lit(False))
    numbers = [c.name for c in columns if c.kind == "number"]
    return outliers(out, numbers, approximate) if numbers else out.withColumns({"is_outlier": F.lit(False), "outlier_columns": F.array().cast("array<string>")})


def cleaning_counts(review: DataFrame) -> DataFrame:
    """kind (change or issue), name and n: how often each reason and issue occurs."""
    each = F.concat(
        F.transform("changes", lambda c: F.struct(F.lit("change").alias("kind"), c["reason"].alias("name"))),
        F.transform("issues", lambda i: F.struct(F.lit("issue").alias("kind"), i["type"].alias("name"))),
    )
    return review.select(F.inline(each)).groupBy("kind", "name").agg(F.count("*").alias("n"))


#: What a line of the cleaning summary says besides its title and count.
DETAILS = {
    "duplicates": "Copies of a cleaned row are kept for review and left out of the calculation.",
    "possible": "Rows with the same company or customer, date and metric value are kept for a decision.",
    "outliers": "Flags by the interquartile range never remove values by themselves.",
    NUMBER: "Currency marks and grouping were removed; values are the same.",
    DAY: "Dates in known forms were written as ISO dates.",
    PARTS: "Dates with two readings were decided by the columns of year, month and day.",
    SPACE: "Cells of which only spaces at the ends or within changed.",
    "missing": "Missing numbers stay visible and do not count.",
    "invalid-number": "Unreadable numbers stay visible and do not count.",
}


def cleaning_log(review: DataFrame) -> DataFrame:
    """key, title, detail, n and severity of each line of the cleaning summary; the detail
    of outliers names the columns that raised them, most first."""
    flags = review.agg(*[F.count_if(F.col(c)).alias(c) for c in ("exact_duplicate", "possible_duplicate", "is_outlier")])
    by_flag = flags.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("key"), F.lit(t).alias("title"), F.col(c).alias("n"), F.when((F.col(c) > 0) & F.lit(warn), "warning").when(F.col(c) > 0, "success").otherwise("info").alias("severity"))
        for k, t, c, warn in (("duplicates", "Exact duplicates excluded", "exact_duplicate", False), ("possible", "Possible duplicates flagged", "possible_duplicate", True), ("outliers", "Outliers flagged for review", "is_outlier", True))
    ])))
    counts = cleaning_counts(review)
    title = F.when(F.col("kind") == "change", F.col("name")).otherwise(F.concat(F.lit("Issue: "), F.col("name")))
    lines = counts.select(F.concat_ws(":", "kind", "name").alias("key"), title.alias("title"), "n", F.when(F.col("kind") == "change", "success").otherwise("warning").alias("severity"))
    known = F.create_map(*[F.lit(x) for pair in DETAILS.items() for x in pair])
    detail = F.try_element_at(known, F.regexp_replace("key", "^(change|issue):", ""))
    raised = review.select(F.explode("outlier_columns").alias("c")).groupBy("c").agg(F.count("*").alias("k"))  # a row a number column
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("o"), "c")))
    named = raised.agg(F.array_join(F.transform(ordered, lambda x: F.format_string("%s: %d", x["c"], -x["o"])), "; ").alias("_by"))
    out = by_flag.unionByName(lines).join(F.broadcast(named), how="left")
    with_columns = F.concat(detail, F.when((F.col("key") == "outliers") & (F.col("_by") != ""), F.concat(F.lit(" Raised by "), F.col("_by"), F.lit("."))).otherwise(""))
    return out.select("key", "title", with_columns.alias("detail"), "n", "severity")


def refresh_log(review: DataFrame, stored: DataFrame) -> DataFrame | None:
    """The cleaning summary of rows as they are now, or None if the stored one says the same."""
    new = materialise(cleaning_log(review), "log")
    old = stored.select(*new.columns)
    return None if new.exceptAll(old).isEmpty() and old.exceptAll(new).isEmpty() else new


def simple_clean(rows: DataFrame, columns: list[Column], order: str = "row_number") -> DataFrame:
    """The lighter pass of the interactive mode: categories in title case and merged by its
    own rules, exact duplicates by the raw cells."""
    out = clean(rows, columns, order)
    names = [c.name for c in columns if c.kind == "category"]
    for c in names:
        out = out.withColumn(c, title_case(normalise(F.col(c))))
    out = materialise(out, "simple")
    if names:
        out = apply_replacements(out, simple_replacements(out, names), names)
    signed = out.withColumn("row_signature", F.sha2(F.to_json("raw", {"ignoreNullFields": "false"}), 256))
    return exact_duplicates(signed, None, order)
