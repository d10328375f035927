import datetime as dt

import pytest
from pyspark.sql import functions as F

from deltascope.operators import aggregate as agg
from deltascope.operators import explain as ex
from deltascope.operators import questions as ask
from deltascope.streaming import ingest

ROWS = [
    ("2023-02-06", 800.0, "United States", "Hardware", "North Co"), ("2023-02-08", 600.0, "Canada", "Software", "Maple"), ("2023-02-09", 400.0, "United States", "Software", "Acme"), ("2023-02-20", 200.0, None, "Retail", "Unknown"),
    ("2023-03-06", 500.0, "United States", "Hardware", "Atlassian"), ("2023-03-08", 500.0, "Canada", "Software", "Thoughtworks"), ("2023-03-09", 300.0, "United States", "Software", "Acme"), ("2023-03-20", 100.0, "Brazil", "Retail", "Sol"),
]
DIMS = ["country", "industry"]


@pytest.fixture(scope="module")
def parts(spark):
    rows = spark.createDataFrame([(dt.date.fromisoformat(d), *r) for d, *r in ROWS], "day date, laid_off double, country string, industry string, company string")
    e = ex.explain_change(rows, "laid_off", "day", DIMS)
    return rows, e["headline"].cache(), e["factors"].cache(), e


def test_headline_and_factors(parts):
    _, head, factors, e = parts
    h = head.first()
    assert (h.previous_total, h.current_total, h.change) == (2000.0, 1400.0, -600.0)
    by = {(r.dimension, r.segment): r.impact for r in factors.collect()}
    assert by["country", "United States"] == -400.0 and by["country", "Unknown"] == -200.0 and by["country", "Brazil"] == 100.0
    assert {(r.dimension, r.segment) for r in e["offsets"].collect()} == {("country", "Brazil")}


def test_rankings(parts):
    rows, head, factors, _ = parts
    assert [r.segment for r in ask.top_n(factors, "country", 2).collect()] == ["United States", "Brazil"]  # Canada ties by absolute change
    assert [r.segment for r in ask.compare_excluding(factors, "country", ["united  STATES"]).collect()] == ["Brazil"]
    companies = agg.two_period_factors(rows, "laid_off", "day", ["company"], head)
    assert {r.segment for r in ask.top_n(companies, "company", 1, "current").collect()} == {"Atlassian", "Thoughtworks"}
    assert ask.nth_factor(factors, 1).first().impact == -400.0
    assert ask.largest_record(rows, "laid_off", "day", "company").first()[:2] == ("North Co", dt.date(2023, 2, 6))
    assert ask.count_entities(rows, "laid_off", "day", "company", "2023-03").first().n == 4
    assert ask.counterfactual(factors, head, "country", "United States").first().if_flat == 1800.0
    assert ask.top_decliner(rows, "laid_off", "day", head, "company").first().segment == "North Co"
    assert ask.check_result(ask.top_n(factors, "country", 3, exclude=["Canada"]), "country", ["Canada"]).count() == 0


def test_inside_a_segment(parts):
    rows, head, factors, _ = parts
    ev = ask.evidence(rows, "laid_off", "day", DIMS, head, "company", "country", "United States")
    assert [(r.segment, r.impact) for r in ev["entities"].collect()] == [("North Co", -800.0), ("Atlassian", 500.0)]
    assert [(r.day, r.impact) for r in ev["dates"].collect()] == [(6, -300.0), (9, -100.0)]
    assert [r.segment for r in ev["overlaps"].collect()] == ["Hardware", "Software"]
    assert {r.role for r in ask.explain_segment(rows, factors, "laid_off", "day", head, "company", "country", "United States").collect()} == {"segment", "entity"}


def test_pairs_tell_the_same_without_the_rows(parts):
    rows, head, _, _ = parts
    pairs = agg.pair_totals(rows, "laid_off", "day", [*DIMS, "company"])
    for dimension, segment in (("country", "United States"), ("industry", "Software"), ("country", "Unknown"), ("country", "nowhere")):
        want = ask.evidence(rows, "laid_off", "day", DIMS, head, "company", dimension, segment)
        got = ask.evidence_of_pairs(pairs, [*DIMS, "company"], head, "company", dimension, segment)
        for name in want:
            assert [tuple(r) for r in got[name].select(*want[name].columns).collect()] == [tuple(r) for r in want[name].collect()], (name, segment)


def spread_rows(spark, n):
    """Rows whose companies and items hardly repeat, a third of them without a company."""
    k = F.col("id")
    company = F.when(k % 3 > 0, F.concat(F.lit("c"), k % (n // 2 + 1)))
    day = F.date_add(F.lit(dt.date(2023, 1, 30)), (k % 5).cast("int"))
    rows = spark.range(n).select(day.alias("day"), (k % 97).cast("decimal(12,2)").alias("laid_off"), F.concat(F.lit("r"), k % 4).alias("country"), F.when(k % 5 > 0, F.concat(F.lit("i"), k % 5)).alias("industry"), company.alias("company"), F.concat(F.lit("t"), (k * 7) % (n // 3 + 1)).alias("item"))
    return rows.unionByName(rows.limit(5).withColumn("laid_off", F.lit(None).cast("decimal(12,2)")))


@pytest.mark.parametrize("few_sums", [2_000_000, 1000, 100, 0])
def test_totals_of_pairs_whatever_dimensions_are_many(spark, monkeypatch, few_sums):
    monkeypatch.setattr(agg, "FEW_SUMS", few_sums, raising=False)
    monkeypatch.setattr(agg, "PART_ROWS", 40, raising=False)
    dims = ["company", "country", "item", "industry"]
    rows = spread_rows(spark, 200)
    got = agg.pair_totals(rows, "laid_off", "day", dims)
    want, names = {}, [*dims, agg.DAYS]
    for r in rows.where("laid_off is not null").collect():
        segments = [*("Unknown" if r[d] is None else r[d] for d in dims), str(r.day.day)]
        for i, a in enumerate(names):
            for j in range(i + 1, len(names)):
                key = ("laid_off", f"{r.day:%Y-%m}", a, segments[i], names[j], segments[j])
                total, n = want.get(key, (0, 0))
                want[key] = (total + r.laid_off, n + 1)
    found = [(tuple(r)[:6], tuple(r)[6:]) for r in got.collect()]
    assert len(found) == len(want) and dict(found) == want
    assert got.schema["metric_total"].dataType.simpleString() == "decimal(22,2)"


def test_a_task_holds_no_more_pairs_of_a_larger_table(spark, monkeypatch):
    monkeypatch.setattr(agg, "FEW_SUMS", 500, raising=False)
    monkeypatch.setattr(agg, "PART_ROWS", 250, raising=False)

    def most(n):
        pairs = agg.pair_totals(spread_rows(spark, n), "laid_off", "day", ["country", "industry", "company"])
        return pairs.groupBy(F.spark_partition_id().alias("task")).count().agg(F.max("count")).first()[0]

    assert most(8000) < 2 * most(1000)


def test_pairs_of_no_rows(spark):
    assert agg.pair_totals(spread_rows(spark, 200).limit(0), "laid_off", "day", ["company", "country"]).count() == 0


def test_values_cards_history(parts):
    rows, head, factors, e = parts
    assert [(r.dimension, r.segment, r.ambiguous) for r in ask.resolve_value(factors, "Why did the united-states fall?").collect()] == [("country", "United States", False)]
    cards = factors.where("segment = 'Canada'").withColumn("impact", factors.impact * 0)
    assert {r.segment: r.impact for r in ask.with_cards(factors, cards).where("dimension = 'country'").collect()}["Canada"] == 0.0
    spark = rows.sparkSession
    runs = spark.createDataFrame([("laid_off", "country", "United States", "2023-01", 1000.0, 1), ("laid_off", "country", "United States", "2023-02", 1800.0, 2)], "metric_column string, dimension string, segment string, current_period string, current_total double, created_at int")
    now = spark.createDataFrame([("laid_off", "country", "United States", "2023-03", 1400.0)], "metric_column string, dimension string, segment string, current_period string, current_total double")
    b = ask.benchmark(now.select("metric_column", "current_total"), runs).first()
    assert (b.mean_total, b.runs, b.delta_percent) == (1400.0, 2, 0.0)
    assert ask.recurring_pattern(now, runs).first().earlier_period == "2023-02"


def test_fewer_than_two_periods(spark):
    rows = spark.createDataFrame([(dt.date(2023, 1, 1), 1.0, "a", "b", "c")], "day date, laid_off double, country string, industry string, company string")
    e = ex.explain_change(rows, "laid_off", "day", DIMS)
    assert e["headline"].count() == 0 and e["causes"].count() == 0


def test_micro_batches(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(10 * k + i, f"v{(10 * k + i) % 7}", 1.0, dt.date(2024, 1 + k % 2, 1)) for i in range(4)], "row_number long, x string, m double, day date").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    q = ingest.ingest(ingest.file_stream(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "ck"), ["x"], totals=str(tmp_path / "totals"), metric="m", date="day", dims=["x"], import_id="s")
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 12 and out.select("batch").distinct().count() == 3
    assert out.where("not exact_duplicate").select("x").distinct().count() == out.where("not exact_duplicate").count()
    from deltascope.sources import store

    totals = store.read_totals(spark, str(tmp_path / "totals"), "s").where("dimension = '__total__'")
    assert sum(r.record_count for r in totals.collect()) == out.where("not excluded").count()
