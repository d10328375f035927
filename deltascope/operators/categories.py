"""Category reconciliation: equal formatting, controlled aliases, near-duplicates, and
proposals where one value contains another.

Everything works on the distinct values of a column and their counts; rows are touched
once, by a join with the replacements. By the rules of the merge, near-duplicates and
containment are only looked for in columns of at most MANY values: a column with more keeps
its values apart. `many=None` lifts that: neither looks at all pairs of values, near-duplicates
meet by an untouched part of their keys and decide in parallel rounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import UNKNOWN, alias, base_text, compact_key, display_form, match_key, normalise, similarity, unicode_form
from ..sources.scratch import materialise
from .review import change, row_signature

#: Fixed values of the merge rules.
MANY, SHORTEST, SCORE, LONG, LONG_SCORE, LEAD = 400, 4, 0.93, 8, 0.88, 0.04
SIMPLE_ALIAS = "Matched a high-confidence regional alias"
FORMAT, ALIAS, FUZZY = "Standardised equivalent category formatting", "Mapped a controlled category alias", "Merged a high-confidence near-duplicate category"


def value_counts(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, value and n of every known category value of rows not excluded."""
    live = rows.where("not excluded") if "excluded" in rows.columns else rows
    long = live.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])))
    return long.where(F.col("value").isNotNull() & (F.col("value") != UNKNOWN)).groupBy("column", "value").agg(F.count("*").alias("n"))


def format_replacements(counts: DataFrame) -> DataFrame:
    """column, value, replacement and reason: values with the same match key become the
    display form of the most frequent one (then the one already clean, then one with a
    capital, then by name)."""
    keyed = counts.withColumns({"key": match_key(unicode_form(F.col("value"), "NFKD")), "display": display_form(unicode_form(F.col("value"), "NFKC"))}).where("key <> ''")
    order = F.struct((-F.col("n")).alias("a"), (F.col("value") != F.col("display")).alias("b"), (~F.col("display").rlike("^[A-Z]")).alias("c"), F.col("display").alias("d"))
    best = keyed.groupBy("column", "key").agg(F.min_by("display", order).alias("replacement"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    out = keyed.join(best, ["column", "key"]).where("value <> replacement")
    return out.select("column", "value", "replacement", F.lit(FORMAT).alias("reason"))


def alias_replacements(counts: DataFrame, columns: Sequence[str]) -> DataFrame:
    label = F.lit(None).cast("string")
    for c in columns:
        label = F.when(F.col("column") == c, alias(F.col("value"), c)).otherwise(label)
    return counts.withColumn("replacement", label).where("replacement is not null and replacement <> value").select("column", "value", "replacement", F.lit(ALIAS).alias("reason"))


def few_values(counts: DataFrame, many: int | None) -> DataFrame:
    """The values of columns that have at most `many`."""
    if many is None:
        return counts
    small = counts.groupBy("column").agg(F.count("*").alias("_m")).where(F.col("_m") <= many).drop("_m")
    return counts.join(small, "column")


def segments(length: Column, edits: Column, i: Column) -> tuple[Column, Column]:
    """Start (from 1) and size of the i-th of edits + 1 even parts of a key of this length."""
    size, longer = F.floor(length / (edits + 1)), length % (edits + 1)
    before = i - 1
    start = 1 + before * size + F.greatest(F.lit(0), before - (edits + 1 - longer))
    return start.cast("int"), (size + (i > edits + 1 - longer).cast("int")).cast("int")


def close_pairs(values: DataFrame, least: float) -> DataFrame:
    """Pairs (x_.., y_..) of different values of a column whose keys' similarity is at least
    `least`, each once, y having the longer key (of equals the greater value), with score.

    Similarity bounds the edits between two keys by the longer one's length. Of k + 1 even
    parts of the shorter key one is then untouched and found in the longer key, near its
    place. So the parts are the index, the longer keys' substrings near each part's place
    are looked up in it by an equi-join, and what meets is measured. No pair of values that
    share no part is ever built."""
    edits = lambda n: F.floor(n * (1 - least) + 1e-9).cast("int")
    kept = [c for c in values.columns if c != "column"]
    sized = values.withColumn("_n", F.length("key"))
    longest = F.floor(F.col("_n") / least + 1e-9).cast("int")
    x = sized.select("column", "_n", *[F.col(c).alias(f"x_{c}") for c in kept], F.explode(F.array_distinct(F.transform(F.sequence("_n", longest), edits))).alias("_k"))
    x = x.select("*", F.explode(F.sequence(F.lit(1), F.col("_k") + 1)).alias("_i"))
    start, size = segments(F.col("_n"), F.col("_k"), F.col("_i"))
    x = x.where(size > 0).withColumn("_part", F.substring("x_key", start, size))
    y = sized.select("column", F.col("_n").alias("_m"), *[F.col(c).alias(f"y_{c}") for c in kept], edits(F.col("_n")).alias("_k"))
    y = y.select("*", F.explode(F.sequence(F.greatest(F.lit(1), F.col("_m") - F.col("_k")), F.col("_m"))).alias("_n"))
    y = y.select("*", F.explode(F.sequence(F.lit(1), F.col("_k") + 1)).alias("_i"))
    start, size = segments(F.col("_n"), F.col("_k"), F.col("_i"))
    left, right, moved = F.col("_i") - 1, F.col("_k") + 1 - F.col("_i"), F.col("_m") - F.col("_n")
    low = F.greatest(F.lit(1), start - left, start + moved - right)
    high = F.least(F.col("_m") - size + 1, start + left, start + moved + right)
    y = y.select("*", low.alias("_low"), high.alias("_high"), size.alias("_size")).where("_size > 0 and _low <= _high")
    y = y.select("*", F.explode(F.sequence("_low", "_high")).alias("_at")).withColumn("_part", F.substring("y_key", F.col("_at"), F.col("_size")))
    y = y.drop("_low", "_high", "_size", "_at", "_m").distinct()
    met = x.join(y, ["column", "_n", "_k", "_i", "_part"]).where((F.col("x_value") != F.col("y_value")) & ((F.length("y_key") > F.col("_n")) | (F.col("x_value") < F.col("y_value"))))
    met = met.select("column", *[f"{p}_{c}" for p in "xy" for c in kept]).distinct()
    return met.withColumn("score", similarity(F.col("x_key"), F.col("y_key"))).where(F.col("score") >= least)


def choose_targets(pairs: DataFrame) -> DataFrame:
    """column, value, replacement by the sequential rule: values decide in the order of their
    frequency and name, and a value that was replaced is no target for later ones.

    `pairs` has (a, b) where b may be a target of a. A value's decision hangs only on those of
    its targets that come before it. So in each round all values decide whose earlier
    targets have decided; the rounds are as many as the longest chain of such targets, and
    no column is gathered anywhere."""
    earlier = (F.col("a_n") == F.col("b_n")) & (F.col("b_value") < F.col("a_value"))
    pairs = materialise(pairs.withColumn("earlier", earlier), "fuzzy-pairs")
    left, decided, chosen = pairs, None, []
    while True:
        open_values = left.select("column", F.col("a_value").alias("b_value")).distinct().withColumn("waits", F.lit(True))
        seen = left.join(open_values, ["column", "b_value"], "left")
        if decided is not None:
            gone = decided.where("replaced").select("column", F.col("value").alias("b_value")).distinct().withColumn("gone", F.lit(True))
            seen = seen.join(gone, ["column", "b_value"], "left")
        else:
            seen = seen.withColumn("gone", F.lit(None).cast("boolean"))
        blocked = seen.where("earlier and waits").select("column", "a_value").distinct()
        ready = seen.join(blocked, ["column", "a_value"], "left_anti")
        order = Window.partitionBy("column", "a_value").orderBy(F.desc("score"), "b_value")
        two = ready.where("not (earlier and gone is not null)").withColumn("place", F.row_number().over(order)).where("place <= 2")
        top = two.groupBy("column", "a_value").agg(F.min_by(F.struct("b_value", "score", "a_key"), "place").alias("t"), F.min("score").alias("second"), F.count("*").alias("n"))
        strong = (F.col("t.score") >= SCORE) | ((F.length("t.a_key") >= LONG) & (F.length("t.b_value") >= LONG) & (F.col("t.score") >= LONG_SCORE))
        clear = (F.col("n") == 1) | (F.col("t.score") - F.col("second") >= LEAD)
        outcome = ready.select("column", "a_value").distinct().join(top, ["column", "a_value"], "left")
        now = materialise(outcome.select("column", F.col("a_value").alias("value"), F.coalesce(strong & clear, F.lit(False)).alias("replaced"), F.col("t.b_value").alias("replacement")), "fuzzy-round")
        if now.isEmpty():
            break
        chosen.append(now)
        decided = now if decided is None else decided.unionByName(now)
        left = pairs.join(decided.select("column", F.col("value").alias("a_value")), ["column", "a_value"], "left_anti")
    out = pairs.sparkSession.createDataFrame([], "column string, value string, replacement string")
    for c in chosen:
        out = out.unionByName(c.where("replaced").select("column", "value", "replacement"))
    return out


def fuzzy_replacements(counts: DataFrame, fixed: DataFrame, many: int | None = MANY) -> DataFrame:
    """Near-duplicates among the values that `fixed` does not replace, rarest first: the
    best target is more frequent (or as frequent and at least as long), similar enough,
    and well ahead of the runner-up; a replaced value is no target for later ones."""
    keyed = few_values(counts, many).withColumn("key", compact_key(unicode_form(F.col("value"), "NFKD"))).where(F.length("key") >= SHORTEST)
    done = fixed.select("column", "value")
    free = materialise(keyed.join(done, ["column", "value"], "left_anti").select("column", "value", "n", "key"), "free")
    met = close_pairs(free, LONG_SCORE - LEAD)
    sides = lambda a, b: met.select("column", *[F.col(f"{p}_{c}").alias(f"{q}_{c}") for p, q in ((a, "a"), (b, "b")) for c in ("value", "n", "key")], "score")
    better = (F.col("b_n") > F.col("a_n")) | ((F.col("b_n") == F.col("a_n")) & (F.length("b_key") >= F.length("a_key")))
    scored = sides("x", "y").unionByName(sides("y", "x")).where(better)
    return choose_targets(scored).withColumn("reason", F.lit(FUZZY))


def replacements(rows: DataFrame, columns: Sequence[str], fuzzy: bool = True, many: int | None = MANY) -> DataFrame:
    """All replacements of the columns: by format, else by alias, else near-duplicates."""
    counts = materialise(value_counts(rows, columns), "values")
    by_format = format_replacements(counts)
    by_alias = alias_replacements(counts, columns).join(by_format, ["column", "value"], "left_anti")
    fixed = materialise(by_format.unionByName(by_alias), "replacements")
    return fixed.unionByName(fuzzy_replacements(counts, fixed, many)) if fuzzy else fixed


def apply_replacements(rows: DataFrame, found: DataFrame, columns: Sequence[str], signed: Sequence[str] | None = None) -> DataFrame:
    """The rows with their values replaced, and a change logged if they have changes. With
    `signed`, the columns that row_signature is of, rows that changed are signed anew, so
    that later imports are compared with what is stored."""
    before = F.struct(*columns)
    if signed:
        rows = rows.withColumn("_before", before)
    for c in columns:
        own = found.where(F.col("column") == c).select(F.col("value").alias("_old"), F.col("replacement").alias("_new"), F.col("reason").alias("_why"))
        rows = rows.join(own, F.col(c) == F.col("_old"), "left")
        hit = F.col("_new").isNotNull()
        if "changes" in rows.columns:
            rows = rows.withColumn("changes", F.when(hit, F.array_append("changes", change(c, F.col(c), F.col("_new"), F.col("_why")))).otherwise(F.col("changes")))
        rows = rows.withColumn(c, F.coalesce("_new", F.col(c))).drop("_old", "_new", "_why")
    if signed:
        rows = rows.withColumn("row_signature", F.when(F.col("_before").eqNullSafe(before), F.col("row_signature")).otherwise(row_signature(signed))).drop("_before")
    return rows


def reconcile(rows: DataFrame, columns: Sequence[str], fuzzy: bool = True, signed: Sequence[str] | None = None, many: int | None = MANY) -> DataFrame:
    return apply_replacements(rows, replacements(rows, columns, fuzzy, many), columns, signed)


#: Fixed values of the interactive mode: regional names without spaces, and the columns they hold for.
REGIONS = {"ny": "New York", "nyc": "New York", "newyork": "New York", "la": "Los Angeles", "losangeles": "Los Angeles", "uk": "United Kingdom", "unitedkingdom": "United Kingdom", "greatbritain": "United Kingdom"}
REGIONAL = "region|state|city|location|area"


def simple_replacements(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The merges of the interactive mode: a regional name, else the most frequent value of
    the same normal form (of equals the first by name). No edit distances."""
    counts = value_counts(rows, columns).withColumn("key", normalise(F.col("value")))
    names = F.create_map(*[F.lit(x) for pair in REGIONS.items() for x in pair])
    name = F.when(F.lower("column").rlike(REGIONAL), F.try_element_at(names, F.regexp_replace("key", r"\s", "")))
    best = counts.groupBy("column", "key").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("same"))
    out = counts.join(best, ["column", "key"]).select("column", "value", F.coalesce(name, "same").alias("replacement"), F.when(name.isNotNull(), SIMPLE_ALIAS).otherwise(FUZZY).alias("reason"))
    return out.where("replacement <> value")


# containment ----------------------------------------------------------------------

PROPOSAL = "id string, column string, contained string, containing string, contained_n long, containing_n long, status string, label string"


def containment_id(column, short, long):
    return F.concat(F.lit("containment-"), F.sha2(F.to_json(F.array(column, short, long)), 256))


#: What a stored proposal's status can be.
STATUSES = ("pending", "merged", "kept-separate", "superseded")


def valid_proposals(stored: DataFrame) -> DataFrame:
    """Stored proposals that are whole: with an id, a column, both values and a known
    status; counts below 0 or missing are 0, an empty label is none."""
    need = ["id", "column", "contained", "containing"]
    ok = F.col("status").isin(*STATUSES)
    for c in need:
        ok = ok & (base_text(F.col(c)) != "")
    count = lambda c: F.greatest(F.coalesce(F.col(c).try_cast("long"), F.lit(0)), F.lit(0)).alias(c)
    return stored.where(ok).select(*[base_text(F.col(c)).alias(c) for c in need], count("contained_n"), count("containing_n"), "status", F.nullif(base_text(F.col("label")), F.lit("")).alias("label"))


def containment(rows: DataFrame, columns: Sequence[str], existing: DataFrame | None = None, many: int | None = MANY) -> DataFrame:
    """Proposals: one value's key is whole words within another's. Those known by id keep
    what is stored; decided ones that are no longer found stay, malformed ones go. A value
    meets another by its own words: the longer key's runs of words are looked up as keys."""
    counts = value_counts(rows, columns)
    keyed = few_values(counts, many).withColumn("key", match_key(unicode_form(F.col("value"), "NFKD"))).where(F.length("key") >= 3)
    keyed = materialise(keyed.select("column", "value", "n", "key"), "contained")
    a, b = (keyed.select("column", *[F.col(x).alias(f"{p}_{x}") for x in ("value", "n", "key")]) for p in ("a", "b"))
    words = F.split("b_key", " ")
    runs = F.flatten(F.transform(words, lambda _, i: F.transform(F.sequence(F.lit(1), F.size(words) - i), lambda n: F.array_join(F.slice(words, i + 1, n), " "))))
    inside = b.withColumn("a_key", F.explode(F.array_distinct(runs))).where(F.length("b_key") > F.length("a_key"))
    pairs = a.join(inside, ["column", "a_key"])
    found = pairs.select(
        containment_id(F.col("column"), F.col("a_value"), F.col("b_value")).alias("id"), "column", F.col("a_value").alias("contained"), F.col("b_value").alias("containing"),
        F.col("a_n").alias("contained_n"), F.col("b_n").alias("containing_n"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("label"),
    )
    if existing is None:
        return found
    existing = valid_proposals(existing)
    old = existing.select(*[F.col(c).alias(f"_{c}") for c in existing.columns])
    both = found.join(old, F.col("id") == F.col("_id"), "full")
    both = both.where(F.col("id").isNotNull() | (F.col("_status") != "pending"))
    return both.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) for c in found.columns])


def decide_containment(rows: DataFrame, proposals: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply decisions (id, action merge or keep, label) to proposals and rows. A merge puts
    a label (by default `a / b (merged)`, at most 160 characters) in the place of both
    values; other pending proposals with the same contained value are superseded."""
    d = decisions.select(F.col("id"), "action", F.col("label").alias("_label"))
    default = F.concat("contained", F.lit(" / "), "containing", F.lit(" (merged)"))
    joined = proposals.join(d, "id", "left")
    merged = F.col("action") == "merge"
    status = F.when(merged, "merged").when(F.col("action") == "keep", "kept-separate").otherwise(F.col("status"))
    label = F.when(merged, F.substring(F.coalesce(F.nullif(F.trim("_label"), F.lit("")), default), 1, 160)).otherwise(F.col("label"))
    new = joined.withColumns({"status": status, "label": label}).drop("action", "_label")
    taken = new.where("status = 'merged'").select("column", "contained").distinct().withColumn("_taken", F.lit(True))
    new = new.join(taken, ["column", "contained"], "left")
    new = new.withColumn("status", F.when((F.col("status") == "pending") & F.col("_taken"), "superseded").otherwise(F.col("status"))).drop("_taken")
    new = new.select(*proposals.columns)
    own = new.where("status = 'merged'").join(decisions.select("id"), "id", "left_semi")
    found = own.select("column", F.explode(F.array("contained", "containing")).alias("value"), F.col("label").alias("replacement"), F.lit("Merged after a containment review").alias("reason"))
    w = Window.partitionBy("column", "value").orderBy("replacement")  # one label for a value that several merges name
    found = found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    columns = [r.column for r in proposals.select("column").distinct().collect()]  # names of columns
    return apply_replacements(rows, found, [c for c in columns if c in rows.columns]), new


def reconciliation_counts(review: DataFrame, raw: str = "raw") -> DataFrame:
    """Distinct (column, final value) groups and cells that automatic category changes
    touched; review rows have `changes`."""
    hit = review.select(F.explode("changes").alias("c")).where(F.col("c.reason").isin(FORMAT, ALIAS, FUZZY))
    return hit.agg(F.count_distinct("c.column", "c.to").alias("groups"), F.count("*").alias("cells"))
