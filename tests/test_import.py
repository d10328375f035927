import pytest
from pyspark.sql import functions as F

from deltascope.operators import categories, clean, currency, explain, profile
from deltascope.operators import review as rv
from deltascope.sources import readers, store


@pytest.fixture(scope="module")
def demo(spark):
    rows = readers.with_row_number(readers.demo_sales(spark)).cache()
    columns = profile.profile(rows.drop("row_number"))
    return rows, columns, clean.review_table(rows, columns).cache()


def test_demo_profile(demo):
    _, columns, _ = demo
    kinds = {c.name: c.kind for c in columns}
    assert kinds["Order Date"] == "date" and kinds["Revenue"] == "number" and kinds["Product"] == kinds["Region"] == kinds["Channel"] == "category" and kinds["Order ID"] == "identifier"
    assert profile.metric_of(columns).name == "Revenue" and profile.date_of(columns).name == "Order Date"
    assert "Revenue: number" in profile.describe(columns)
    with pytest.raises(ValueError):
        profile.choose_metric(columns, "Product")


def test_demo_known_answer(demo):
    _, columns, review = demo
    e = explain.explain_change(review, "Revenue", "Order Date", profile.dimensions_of(columns))
    h = e["headline"].first()
    assert (h.previous_total, h.current_total, h.change) == (51255.0, 48920.0, -2335.0) and round(h.change_percent, 1) == -4.6
    causes = {(r.dimension, r.segment): r for r in e["causes"].collect()}
    for key in (("Product", "Shirts"), ("Region", "East Coast")):
        assert causes[key].impact == -3445.0 and causes[key].counterfactual == 52365.0 and causes[key].confidence == 99
    assert "decreased 4.6% from May 2026 to June 2026" in explain.summary(e["headline"], e["causes"]).first().summary


def test_impacts_of_a_dimension_add_up(demo):
    _, columns, review = demo
    e = explain.explain_change(review, "Revenue", "Order Date", profile.dimensions_of(columns))
    change = e["headline"].first().change
    for r in e["factors"].groupBy("dimension").agg(F.sum("impact").alias("s"), F.max(F.abs(F.col("counterfactual") + F.col("impact") - 48920.0)).alias("d")).collect():
        assert abs(r.s - change) < 1e-9 and r.d < 1e-9


def test_demo_flags(demo):
    _, _, review = demo
    row = review.agg(F.count_if("exact_duplicate").alias("d"), F.count_if("is_outlier").alias("o"), F.count_if(F.exists("issues", lambda i: i["type"] == "missing")).alias("m")).first()
    assert (row.d, row.o, row.m) == (1, 2, 1)  # the planted outlier, and the fall of the shirts
    assert {r.severity for r in clean.cleaning_log(review).collect()} <= {"info", "success", "warning"}


def test_derived_amount_and_parts(spark):
    rows = spark.createDataFrame([(1, "2025-01-13", "2", "10", "1", "5"), (2, "2025-02-14", "3", "5", "0", ""), (3, "2025-02-15", "x", "5", "0", "1")], "row_number long, InvoiceDate string, Quantity string, UnitPrice string, Discount string, Tax string")
    numbers = [profile.Column(c, "number", 90) for c in ("Quantity", "UnitPrice", "Discount", "Tax")]
    recipe = profile.derived_metric(numbers)
    assert recipe.recipe == {"quantity": "Quantity", "unit": "UnitPrice", "discount": ("Discount", "amount"), "tax": ("Tax", "amount")}
    out = clean.clean(rows, [*numbers, recipe]).orderBy("row_number").collect()
    assert [r[profile.DERIVED_AMOUNT] for r in out] == [24.0, 15.0, None]
    days = spark.createDataFrame([(1, "1/12/2025", "2025", "12", "1"), (2, "13/12/2025", "2025", "12", "13"), (3, "", "2025", "11", "2")], "row_number long, d string, Year string, Month string, Day string")
    cols = [profile.Column("d", "date", 90, policy=profile.DatePolicy("month-first")), profile.derived_date(days.drop("row_number"))]
    out = clean.clean(days, cols).orderBy("row_number").collect()
    assert [str(r.d) for r in out] == ["2025-12-01", "2025-12-13", "None"] and out[0].changes[0]["reason"] == clean.PARTS


def test_categories(spark):
    names = ["Port Harcourt"] * 3 + ["port-harcourt", "Port Harcourt.", "PH"] + ["São Paulo"] * 2 + ["sao paulo"] + ["Niger", "Nigeria", "Congo", "DR Congo"] + ["Manchester City Centre"] * 4 + ["Manchestr City Centre", "new york"]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "row_number long, Location string")
    got = [r.Location for r in categories.reconcile(rows, ["Location"]).orderBy("row_number").collect()]
    assert got == ["Port Harcourt"] * 5 + ["PH"] + ["São Paulo"] * 3 + ["Niger", "Nigeria", "Congo", "DR Congo"] + ["Manchester City Centre"] * 5 + ["New York"]


def test_containment(spark):
    rows = spark.createDataFrame([(v,) for v in ["Card", "Card", "DEBIT CARD", "DEBIT CARD", "Car"]], "Location string")
    p = categories.containment(rows, ["Location"])
    (one,) = p.collect()
    assert (one.contained, one.containing, one.contained_n, one.containing_n, one.status) == ("Card", "DEBIT CARD", 2, 2, "pending")
    decisions = spark.createDataFrame([(one.id, "merge", None)], "id string, action string, label string")
    new, kept = categories.decide_containment(rows, p, decisions)
    assert sorted(r.Location for r in new.collect()) == ["Car"] + ["Card / DEBIT CARD (merged)"] * 4
    assert [r.status for r in categories.containment(new, ["Location"], kept).collect()] == ["merged"]


def test_possible_duplicates_and_outliers(spark):
    rows = spark.createDataFrame([(1, "Oda", "2023-01-01", 10.0, False), (2, "ODA ", "2023-01-01", 10.0, False), (3, "oda", "2023-01-01", 10.0, False), (4, "Oda", "2023-01-02", 10.0, False), (5, "Oda", "2023-01-01", 10.0, True)], "row_number long, company string, day string, v double, excluded boolean")
    got = {r.row_number: r.possible_duplicate for r in rv.possible_duplicates(rows, "company", "day", "v").collect()}
    assert got == {1: True, 2: True, 3: True, 4: False, 5: False}
    n = spark.createDataFrame([(i, float(i), 5.0) for i in range(8)] + [(8, 900.0, 5.0)], "row_number long, a double, b double")
    out = {r.row_number: (r.is_outlier, r.outlier_columns) for r in rv.outliers(n, ["a", "b"]).collect()}
    assert out[8] == (True, ["a"]) and not any(v[0] for k, v in out.items() if k != 8)


def test_exact_duplicates_against_earlier_rows(spark):
    first = rv.exact_duplicates(spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "row_number long, x string"), ["x"])
    assert {r.row_number: r.exact_duplicate for r in first.collect()} == {1: False, 2: True, 3: False}
    later = rv.exact_duplicates(spark.createDataFrame([(4, "a"), (5, "b")], "row_number long, x string"), ["x"], earlier=first)
    assert {r.row_number: r.exact_duplicate for r in later.collect()} == {4: True, 5: False}


def test_currency(spark):
    values = lambda xs: spark.createDataFrame([(x,) for x in xs], "value string")
    for xs, want in ((["₦100", "₦2"], "NGN"), (["£5"], "GBP"), (["EUR 5", "$1"], "EUR"), (["12", "13"], "USD"), ([], "USD")):
        assert currency.detect(values(xs)).first().code == want
    assert currency.detect(values(["£5"]), manual="cad").first().source == "manual"
    assert currency.symbol("gbp") == "£" and currency.code_or_none("zz") is None


def test_csv_store_and_preview(spark, tmp_path):
    (tmp_path / "t.csv").write_text('﻿a,b\n1," x ""q"""\n\n2\n3,"two\nlines"\n', encoding="utf-8")
    df = readers.with_row_number(readers.read_table(spark, str(tmp_path / "t.csv")))
    assert [tuple(r) for r in df.orderBy("row_number").collect()] == [("1", ' x "q"', 1), ("2", None, 2), ("3", "two\nlines", 3)]
    with pytest.raises(ValueError):
        readers.read_table(spark, "x.xlsx")
    with pytest.raises(ValueError):
        readers.check_source(df, 2)
    path = str(tmp_path / "rows")
    store.write_rows(df, path, "one")
    store.write_rows(df, path, "two")
    store.upsert_rows(spark, spark.createDataFrame([("9", "new", 2)], df.schema), path, "one")
    assert [r.a for r in store.read_rows(spark, path, "one").collect()] == ["1", "9", "3"]
    assert [(r.a, r.total_rows) for r in store.preview(store.read_rows(spark, path, "two"), -1, 2).collect()] == [("1", 3), ("2", 3)]
    assert store.get_row(spark, path, "two", 3).first().a == "3"
    store.reset_import(spark, path, "two")
    assert spark.read.parquet(path).select("import_id").distinct().count() == 1


def test_edits(demo):
    _, columns, review = demo
    spark = review.sparkSession
    edits = spark.createDataFrame([(1, "exclude", None, None), (2, "edit", "Revenue", "$7.50"), (3, "undo", "Order Date", None), (4, "edit", "Revenue", "bad")], "row_number long, action string, column string, value string")
    out = {r.row_number: r for r in rv.apply_edits(review, edits, {"Revenue": "number", "Order Date": "date"}).where("row_number < 5").collect()}
    assert out[1].excluded and out[2].Revenue == 7.5 and out[2].changes[-1]["reason"] == "Edited by hand" and any(i["type"] == "invalid-edit" for i in out[4].issues)


def test_edits_take_effect_in_order(spark):
    schema = f"row_number long, excluded boolean, possible_duplicate boolean, v double, name string, changes array<{rv.CHANGE}>, issues array<{rv.ISSUE}>"
    rows = spark.createDataFrame([(i, False, True, 1.0, "a", [("v", "$1", "1.0", "x"), ("v", "0.5", "2.0", "y")], [("possible-duplicate", None, "m"), ("exact-duplicate", None, "m")]) for i in range(8)], schema)
    edits = [(0, 1, "edit", "v", "5"), (0, 2, "edit", "v", "7"), (1, 2, "edit", "v", "5"), (1, 1, "edit", "v", "7"), (2, 1, "exclude", None, None), (2, 2, "restore", None, None), (3, 1, "edit", "v", "5"), (3, 2, "undo", "v", None)]
    edits += [(4, 1, "undo", "v", None), (4, 2, "edit", "v", "9"), (5, 1, "edit", "v", "bad"), (6, 1, "keep", None, None), (6, 1, "edit", "name", " b "), (7, 1, "edit", "v", "5"), (7, 2, "edit", "v", "6"), (7, 3, "undo", "v", None)]
    e = spark.createDataFrame(edits, "row_number long, seq int, action string, column string, value string").orderBy(F.rand(3))
    out = {r.row_number: r for r in rv.apply_edits(rows, e, {"v": "number", "name": "category"}).collect()}
    assert [out[i].v for i in range(8)] == [7.0, 5.0, 1.0, 1.0, 9.0, 1.0, 1.0, 5.0]
    assert not out[2].excluded and [i.type for i in out[2].issues] == ["possible-duplicate"]
    assert [(c["from"], c["to"]) for c in out[0].changes][2:] == [("1.0", "5.0"), ("5.0", "7.0")] and len(out[3].changes) == 2
    assert [(c["from"], c["to"]) for c in out[4].changes] == [("$1", "1.0"), ("0.5", "9.0")] and [i.type for i in out[5].issues][-1] == "invalid-edit"
    assert out[6].name == "b" and not out[6].possible_duplicate and len(out[7].changes) == 3


def test_exact_quartiles(spark):
    import numpy as np

    r = np.random.default_rng(5)
    values = {"a": r.normal(size=101).round(1).tolist(), "b": [3.0] * 50 + [4.0], "c": [1.0], "d": list(range(10))}
    rows = spark.createDataFrame([(c, float(v)) for c, vs in values.items() for v in vs], "column string, value double").repartition(7)
    for q in rv.exact_quartiles(rows).collect():
        assert q.n == len(values[q["column"]]) and np.allclose([q.q1, q.q3], np.quantile(values[q["column"]], [0.25, 0.75]))


def test_links_of_possible_duplicates(spark):
    rows = spark.createDataFrame([(i, "A", "d", 1.0) for i in (4, 2, 9)] + [(5, "B", "d", 1.0)], "row_number long, company string, day string, v double")
    assert sorted(tuple(r) for r in rv.duplicate_links(rows, "company", "day", "v").collect()) == [(2, 4), (2, 9)]


def test_recalculation_after_a_review(demo):
    from deltascope.operators import recalculate

    rows, columns, review = demo
    spark = review.sparkSession
    first = recalculate.recalculate(review, columns)
    assert first["headline"].first().change == -2335.0 and first["sensitivity"].count() == 1
    shirts = review.where("Product = 'Shirts' and Region = 'East Coast'").agg(F.max("row_number").alias("n")).first().n
    edits = spark.createDataFrame([(shirts, "edit", "Revenue", "$5,000.00")], "row_number long, action string, column string, value string")
    again = recalculate.recalculate(review, columns, edits)
    assert again["headline"].first().change > first["headline"].first().change
    assert again["rows"].where(F.col("row_number") == shirts).first().Revenue == 5000.0
    proposals = spark.createDataFrame([("p", "Product", "Shirts", "Shoes", 1, 1, "pending", None), ("", "Product", "a", "b", 1, 1, "pending", None), ("q", "Product", "a", "b", -1, 1, "odd", None)], categories.PROPOSAL)
    assert [r.id for r in categories.valid_proposals(proposals).collect()] == ["p"]
    merged = recalculate.recalculate(review, columns, proposals=proposals.limit(1), decisions=spark.createDataFrame([("p", "merge", "Wear")], "id string, action string, label string"))
    assert {r.segment for r in merged["totals"].where("dimension = 'Product'").select("segment").distinct().collect()} == {"Wear", "Hats"}
    with pytest.raises(ValueError):
        recalculate.recalculate(review, [c for c in columns if c.kind != "date"])
    log = clean.cleaning_log(review)
    assert clean.refresh_log(review, log) is None and clean.refresh_log(again["rows"].withColumn("is_outlier", F.lit(False)), log) is not None
    assert "Revenue" in log.where("key = 'outliers'").first().detail


def test_edits_on_kept_totals_equal_a_full_recalculation(demo, tmp_path):
    from deltascope.operators import recalculate
    from deltascope.operators.profile import date_of, dimensions_of, metric_of
    from deltascope.sources.versioned import StoredImport

    _, columns, review = demo
    spark = review.sparkSession
    stored = StoredImport(spark, f"file://{tmp_path}/store", "demo")
    stored.write(review, 3)
    metric, date, dims = metric_of(columns).name, date_of(columns).name, dimensions_of(columns)
    kept, rows = recalculate.kept_totals(review, metric, date, dims), review
    plain = lambda df: sorted((tuple(str(x) if isinstance(x, str) else None if x is None else round(float(x), 4) if not hasattr(x, "year") else x for x in r) for r in df.collect()), key=str)
    for edits in (
        [(5, "edit", "Revenue", "$5,000.25"), (9, "exclude", None, None), (12, "edit", "Product", "Gloves"), (23, "exclude", None, None)],
        [(9, "restore", None, None), (12, "undo", "Product", None), (30, "edit", "Order Date", "2026-06-20"), (31, "edit", "Revenue", "nothing")],
        [],
    ):
        e = spark.createDataFrame(edits, "row_number long, action string, column string, value string")
        full = recalculate.recalculate(rows, columns, e)
        found = recalculate.recalculate_edits(stored, kept, e, columns)
        kept, rows = found["kept"], full["rows"]
        assert found["rows"].count() == len(edits)
        for name in ("totals", "headline", "causes", "offsets", "trend", "sensitivity"):
            assert plain(found[name].select(*full[name].columns)) == plain(full[name]), name
    assert stored.rows().count() == review.count()


def test_interactive_mode(spark):
    raw = spark.createDataFrame([(i, f"0{1 + i % 9}/13/2024", "new york" if i % 2 else "NYC", str(1000 + i), "N/A" if i == 3 else f"A-{i}") for i in range(12)], "row_number long, Day string, City string, Transaction string, Note string")
    columns = profile.profile(raw.drop("row_number"), strict=False)
    assert {c.name: c.kind for c in columns} == {"Day": "date", "City": "category", "Transaction": "number", "Note": "identifier"}
    out = clean.simple_clean(raw, columns).collect()
    assert {r.City for r in out} == {"New York"} and str(out[0].Day)[5:] in {f"0{k}-13" for k in range(1, 10)}
    assert profile.profile(raw.drop("row_number"))[2].kind == "identifier"


def test_json_payloads(spark):
    from deltascope.sources.payload import as_array, as_record

    rows = spark.createDataFrame([('{"a": 1, "b": "x"}',), ("[1]",), ("3",), (None,), ("{bad",)], "j string")
    assert [tuple(r) for r in rows.select(as_record(F.col("j"), "a int, b string").alias("r")).select("r.*").collect()] == [(1, "x")] + [(None, None)] * 4
    rows = spark.createDataFrame([('[{"a": 1}, null]',), ('{"a": 1}',), (None,)], "j string")
    assert [[x.a for x in r.r] for r in rows.select(as_array(F.col("j"), "struct<a:int>").alias("r")).collect()] == [[1], [], []]


def test_signatures_follow_merges(spark):
    rows = spark.createDataFrame([(1, "Port Harcourt", 1.0), (2, "port-harcourt", 1.0), (3, "Port Harcourt", 2.0)], "row_number long, city string, v double")
    signed = rv.exact_duplicates(rows, ["city", "v"])
    out = {r.row_number: r for r in categories.reconcile(signed, ["city"], signed=["city", "v"]).collect()}
    assert out[1].row_signature == out[2].row_signature != out[3].row_signature and not out[2].exact_duplicate
