from __future__ import annotations

import json
import random
import statistics
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sumwise.functions import basics
from sumwise.operators import clean, profile, schema, series, summary, values
from sumwise.operators.quantile import exact_medians
from sumwise.plans import analysis
from sumwise.sources import cases, tables
from sumwise.sources.order import scan_order
from conftest import by
from workload import tables as workload_tables
from workload.inputs import messy_orders

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def mixed(spark):
    rows = [
        (1, "g", "$1,000", "a", 1.0, datetime(2024, 1, 1)),
        (2, "g", "$2,000", "b", float("nan"), datetime(2024, 1, 3, 12)),
        (3, "g", None, "03/04/2024", 3.0, None),
        (4, "h", "$10", "5.125", 4.0, datetime(2024, 2, 1)),
    ]
    return spark.createDataFrame(rows, "id long, grp string, price string, note string, x double, at timestamp_ntz")


def test_numeric_summary(mixed):
    s = {(r["grp"], r["name"]): r for r in summary.numeric_summary(mixed, ["grp"], clean_text=True).collect()}
    assert s["g", "price"]["sum"] == 3000.0 and s["g", "price"]["missing_count"] == 1
    assert (s["g", "x"]["count"], s["g", "x"]["missing_count"], s["g", "x"]["median"]) == (2, 1, 2.0)
    assert s["h", "x"]["std"] is None
    assert ("g", "note") not in s
    assert {r["name"] for r in summary.numeric_summary(mixed, ["grp"]).collect()} == {"id", "x"}


def test_numeric_summary_of_nothing(spark):
    empty = spark.createDataFrame([], "a double, b string")
    r = summary.numeric_summary(empty).first()
    assert (r["count"], r["sum"], r["median"], r["std"]) == (0, None, None, None)
    assert summary.numeric_summary(empty.select("b")).count() == 0
    assert summary.date_summary(empty).count() == 0


def test_medians_of_large_groups(spark):
    """A third of the rows share one key, and half of those one value."""
    rng = random.Random(3)
    rows = []
    for i in range(6000):
        key = "hot" if i % 3 == 0 else rng.choice("abcde")
        value = 5.0 if key == "hot" and i % 2 else rng.choice([rng.gauss(0, 1) * 10 ** rng.randint(-6, 9), float(rng.randint(-3, 3))])
        rows.append((key, value))
    rows += [("one", 1.5), ("two", 1.0), ("two", 4.0), ("same", 2.0), ("same", 2.0), (None, 8.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, value double")
    expected = {k: statistics.median([v for q, v in rows if q == k and v is not None]) for k in {q for q, _ in rows} - {"none"}}
    assert {r["k"]: r["median"] for r in exact_medians(df, ["k"]).collect()} == expected


def test_median_of_more_rows_than_the_sketch_holds(spark):
    rng = random.Random(5)
    values = [float(rng.randint(0, 30_000)) for _ in range(61_000)] + [rng.expovariate(1e-3) for _ in range(40_001)]
    df = spark.createDataFrame([(v,) for v in values], "value double").repartition(7)
    assert exact_medians(df, []).first()["median"] == statistics.median(values)


def test_date_summary(mixed):
    r = summary.date_summary(mixed).first()
    assert (r["count"], r["missing_count"], r["min"], r["duration_days"]) == (3, 1, "2024-01-01T00:00:00", 31)


def test_table_profile(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("a", 1.0), ("b", None)], "k string, v double")
    assert tuple(profile.table_profile(df).first()) == (4, 2, False, 1)
    assert tuple(profile.table_profile(df.where("false")).first()) == (0, 2, True, 0)


def test_column_profile(mixed):
    p = by(profile.column_profile(mixed), "name")
    assert (p["x"]["unique_count"], p["x"]["missing_count"], p["x"]["missing_percentage"]) == (3, 1, 25.0)
    assert p["at"]["inferred_type"] == "date-like" and p["note"]["inferred_type"] == "text"
    assert p["id"]["position"] == 0 and p["price"]["dtype"] == "string"
    empty = by(profile.column_profile(mixed.where("false")), "name")
    assert empty["price"]["missing_percentage"] == 0.0 and empty["price"]["inferred_type"] == "text"


def test_dates_in_text_need_four_fifths(spark):
    rows = [("2024-01-01", "2024-01-01")] * 3 + [("2024-01-02", "x"), ("later", "y")]
    p = by(profile.column_profile(spark.createDataFrame(rows, "a string, b string")), "name")
    assert p["a"]["inferred_type"] == "date-like" and p["b"]["inferred_type"] == "text"


def test_missing_columns(mixed):
    r = profile.missing_columns(profile.column_profile(mixed)).first()
    assert r["value"] == 3 and [c["name"] for c in r["columns"]] == ["price", "x", "at"]


def test_cleaning(mixed):
    report = by(clean.cleaning_report(mixed, order_by=["id"]), "name")
    assert (report["price"]["changed_count"], report["price"]["missing_count"]) == (3, 1)
    assert [e["warning"] for e in report["note"]["unresolved_examples"]] == [
        "ambiguous_date_format",
        "ambiguous_decimal_or_thousands",
    ]
    assert report["x"]["missing_count"] == 1 and report["x"]["unresolved_examples"] == []
    done = clean.cleaned_table(mixed)
    assert dict(done.dtypes)["price"] == "double" and dict(done.dtypes)["note"] == "string"
    assert [r["price"] for r in done.orderBy("id").collect()] == [1000.0, 2000.0, None, 10.0]


def test_examples_stop_at_five(spark):
    df = spark.range(20).select("id", F.lit("k").alias("k"), F.concat(F.lit("1,2"), F.col("id")).alias("t"))
    for keys in ([], ["k"]):
        report = by(clean.cleaning_report(df, keys, order_by=["id"], columns=["t"]), "name")
        assert report["t"]["unresolved_count"] == 10 and len(report["t"]["unresolved_examples"]) == 5
        assert report["t"]["unresolved_examples"][0]["raw"] == "1,20"


@pytest.mark.parametrize("format", ["parquet", "csv", "json", "orc"])
def test_first_values_in_file_order(spark, tmp_path, format):
    """One file and twenty files, read in many splits, give the first values of the same order."""
    rows = [(i * 7919 % 1000, "g" if i % 3 else "h", f"1,{i}" if i % 5 == 0 else f"{i}.5") for i in range(1000)]
    df = spark.createDataFrame(rows, "id int, grp string, cell string")
    df.coalesce(1).write.format(format).option("header", True).save(f"{tmp_path}/one")
    parts = spark.createDataFrame([(*r, f"{i // 50:02d}") for i, r in enumerate(rows)], "id int, grp string, cell string, part string")
    parts.coalesce(1).write.format(format).option("header", True).partitionBy("part").save(f"{tmp_path}/many")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        for folder in ("one", "many"):
            read = tables.load_table(spark, f"{tmp_path}/{folder}", schema=df.schema, format=format).select(df.columns)
            wanted = {g: [r for r in rows if r[1] == g] for g in "gh"}
            found = schema.column_schema(read, ["grp"], columns=["id", "cell"]).collect()
            assert {(r["grp"], r["name"]): r["evidence"]["sample_values"] for r in found} == {
                (g, name): [str(r[i]) for r in wanted[g][:3]] for g in "gh" for i, name in ((0, "id"), (2, "cell"))
            }
            for r in clean.cleaning_report(read.where("id >= 0"), ["grp"], columns=["cell"]).collect():
                bad = [x[2] for x in wanted[r["grp"]] if "," in x[2] and len(x[2]) != 5]
                assert [e["raw"] for e in r["unresolved_examples"]] == bad[:5]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_no_order_where_nothing_tells_it(spark, tmp_path):
    df = spark.createDataFrame([(1, "1,2")], "id int, cell string")
    assert scan_order(df) == [] and "unresolved_examples" not in clean.cleaning_report(df).columns
    df.write.csv(f"{tmp_path}/c")
    df.write.parquet(f"{tmp_path}/p")
    assert scan_order(spark.read.csv(f"{tmp_path}/c").repartition(3)) == []
    assert len(scan_order(spark.read.parquet(f"{tmp_path}/p").repartition(3))) == 2
    assert scan_order(spark.read.parquet(f"{tmp_path}/p").groupBy("id").count()) == []


def test_column_schema(spark):
    rows = [
        (i, f"$ {i}.00", f"{i}%", f"ID-{i}", "north" if i % 2 else "south", datetime(2024, 1, 1, i % 24), "2024-01-01", None)
        for i in range(20)
    ]
    columns = "n long, Net string, margin string, code string, region string, at timestamp_ntz, day string, void string"
    df = spark.createDataFrame(rows, columns)
    s = by(schema.column_schema(df, order_by=["n"]), "name")
    got = {k: (r["role"], r["semantic_type"], r["unit"], r["time_role"], r["confidence"]) for k, r in s.items()}
    assert got == {
        "n": ("measure", "numeric", None, "none", 0.9),
        "Net": ("measure", "currency", "USD", "none", 0.65),
        "margin": ("measure", "percentage", "%", "none", 0.65),
        "code": ("identifier", "identifier", None, "none", 0.65),
        "region": ("dimension", "text", None, "none", 0.65),
        "at": ("date", "date", None, "timestamp", 0.9),
        "day": ("date", "date", None, "period", 0.9),
        "void": ("dimension", "text", None, "none", 0.65),
    }
    assert s["code"]["evidence"]["sample_values"] == ["ID-0", "ID-1", "ID-2"]
    assert s["void"]["evidence"]["sample_values"] == []
    nothing = by(schema.column_schema(df.where("false")), "name")
    assert nothing["region"]["role"] == "unknown" and nothing["region"]["confidence"] == 0.3


def test_proposals_are_merged_with_care(spark):
    df = spark.createDataFrame([(i, "x" if i % 2 else "y") for i in range(10)], "n long, region string")
    found = schema.column_schema(df)
    offers = spark.createDataFrame(
        [("n", "identifier", None, None, None), ("region", "identifier", "oops", "km", "none")],
        "name string, role string, semantic_type string, unit string, time_role string",
    )
    m = by(schema.merge_schema_proposals(found, offers), "name")
    assert m["n"]["role"] == "measure" and m["n"]["decisions"][0]["reason"] == "contradicts_strong_evidence"
    assert (m["region"]["role"], m["region"]["semantic_type"], m["region"]["unit"]) == ("identifier", "text", "km")
    assert [(d["field"], d["accepted"]) for d in m["region"]["decisions"]] == [
        ("role", True), ("semantic_type", False), ("unit", True), ("time_role", True),
    ]


def test_load_table(spark, tmp_path, mixed):
    path = str(tmp_path / "t.parquet")
    tables.write_table(mixed, path)
    back = tables.load_table(spark, path)
    assert back.where(F.isnan("x")).count() == 0 and back.where("x is null").count() == 1
    with pytest.raises(FileNotFoundError):
        tables.load_table(spark, str(tmp_path / "no.parquet"))
    other = tmp_path / "t.xlsx"
    other.write_text("x")
    with pytest.raises(ValueError):
        tables.load_table(spark, str(other))
    csv = tmp_path / "t.csv"
    csv.write_text("a,b\n1,x\n2,\n")
    assert tables.load_table(spark, str(csv)).dtypes == [("a", "string"), ("b", "string")]
    assert tables.load_table(spark, str(csv), schema="a int, b string").dtypes == [("a", "int"), ("b", "string")]
    folder = str(tmp_path / "parts")
    mixed.drop("at").write.partitionBy("grp").parquet(folder)
    assert tables.load_table(spark, folder, format="parquet").count() == 4
    with pytest.raises(ValueError):
        tables.load_table(spark, folder)
    with pytest.raises(ValueError):
        tables.load_table(spark, folder, format="xlsx")


def test_filters_reach_the_scan(spark, tmp_path, mixed):
    path = str(tmp_path / "t.parquet")
    tables.write_table(mixed, path)
    df = tables.load_table(spark, path).where("id > 2").select("price")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,2)" in plan and "ReadSchema: struct<id:bigint,price:string>" in plan


def test_catalogs(spark, mixed):
    names = tables.unique_names(["a", "b", "a"])
    assert names == ["a__0", "b", "a__2"]
    df = spark.createDataFrame([(1, 2, 3)], names)
    catalog = tables.column_catalog(df, ["a", "b", "a"], "d1")
    assert [r["name"] for r in profile.duplicate_column_names(catalog, ["dataset_id"]).collect()] == ["a"]
    one = tables.register_dataset(spark, "/x/sales.parquet", role="previous").first()
    assert one["display_name"] == "sales.parquet" and len(one["dataset_id"]) == 32
    with pytest.raises(ValueError):
        tables.register_dataset(spark, "/x", role="boss")
    stacked = tables.stack_datasets({"p": mixed.select("id"), "q": mixed.select("id", "x")})
    assert stacked.columns == ["dataset_id", "id", "x"] and stacked.count() == 8


def test_json_output(mixed):
    rows = [json.loads(r["json"]) for r in tables.as_json(mixed.orderBy("id")).collect()]
    assert rows[1]["at"] == "2024-01-03T12:00:00" and "x" not in rows[1]


def test_load_cases(spark, tmp_path):
    path = tmp_path / "cases.json"
    path.write_text(json.dumps([{"case_id": "c1", "category": "x", "input": {"a": [1, "b"]}}, {"case_id": "c2", "category": "y"}]))
    got = by(cases.load_cases(spark, str(path)), "case_id")
    assert json.loads(got["c1"]["input"]) == {"a": [1, "b"]} and got["c2"]["expected"] == "{}"


def test_load_cases_goes_to_the_file_once(spark, tmp_path):
    """Parts stay as they are written, over lines and with all digits, and no part is fetched by itself."""
    text = '{"a": [1.50,\n  "\u00e9 \\u0000"],  "b": 0.10000000000000000001}'
    (tmp_path / "a.json").write_text('[{"case_id": "c1", "input": %s},\n {"case_id": "c2", "category": "y"}]' % text, encoding="utf-8")
    (tmp_path / "b.json").write_text('{"case_id": "c3", "expected": null}', encoding="utf-8")
    read = cases.load_cases(spark, str(tmp_path))
    got = by(read, "case_id")
    assert set(got) == {"c1", "c2", "c3"} and got["c1"]["input"] == text and got["c3"]["expected"] == "{}"
    assert "multiline" not in read._jdf.queryExecution().optimizedPlan().collectLeaves().head().relation().options().toString().lower()


def alike(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    rows = []
    for df in (a, b):
        at = sorted(df.columns)
        rows.append(sorted(([float(f"{r[c]:.9e}") if isinstance(r[c], float) else r[c] for c in at] for r in df.collect()), key=str))
    assert rows[0] == rows[1]


def test_results_from_value_counts(spark):
    """Everything that follows from the counts equals what the operators make of the raw table."""
    rng = random.Random(8)
    texts = ["$1,000", "$2,000.50", "10%", "", " 7 ", "1.234", "03/04/2024", "March 5, 2024", "x", None, "$5"]
    rows = []
    for i in range(900):
        key = "hot" if i % 3 == 0 else rng.choice(["a", "b", None])
        at = None if i % 50 == 0 else datetime(2023 + i % 2, 1 + i % 12, 1 + i % 28, i % 5)
        rows.append(
            (
                key, rng.choice(texts), f"${rng.randint(1, 40)}.5" if key != "b" or i % 7 else "soon", rng.choice([1, 2, 2**60 + 1, 2**60, None]),
                rng.choice([0.5, float("nan"), rng.gauss(0, 1), None]), rng.random() < 0.5, at, Decimal(rng.randint(0, 9)) / 4, None, rng.choice(["2024-01-05", "Jan 2024", "soon"]),
            )
        )
    kind = "k string, mixed string, price string, whole long, number double, flag boolean, at timestamp_ntz, exact decimal(9,2), nothing string, day string"
    df = spark.createDataFrame(rows, kind).repartition(4)
    for frame in (df, df.where("false")):
        for keys in (["k"], []):
            for measure, period in (("number", "at"), ("price", "at"), ("whole", "day")):
                counts = values.value_counts(frame, keys, measure, period)
                alike(values.monthly_series_of(counts), series.monthly_series(frame, period, measure, keys))
            alike(profile.profile_of(values.column_facts_of(counts), keys), profile.column_profile(frame, keys))
            alike(values.column_facts_of(counts), profile.column_facts(frame, keys))
            alike(values.cleaning_counts_of(counts), clean.cleaning_report(frame, keys, most_examples=0))
            alike(values.numeric_summary_of(counts), summary.numeric_summary(frame, keys, clean_text=True))
            alike(values.date_summary_of(counts), summary.date_summary(frame, keys))
    assert values.monthly_series_of(values.value_counts(df)).count() == 0


def test_counts_for_one_result_are_not_written(spark):
    """Each of the two queries wants one result of its counts."""
    store = list(basics._STORED)
    found = workload_tables.QUERIES["column_profile_from_counts"](spark, FOLDER)
    assert basics._STORED == store
    alike(found, workload_tables.QUERIES["column_profile_by_key"](spark, FOLDER))


def test_a_cleaning_report_from_counts_reads_no_dates_of_columns(spark):
    store = list(basics._STORED)
    found = workload_tables.QUERIES["cleaning_report_from_counts"](spark, FOLDER)
    assert basics._STORED == store
    assert "september" not in found._jdf.queryExecution().optimizedPlan().toString()
    raw = clean.cleaning_report(messy_orders(spark, FOLDER), ["grp"], most_examples=0)
    alike(found, raw)


def test_cells_are_counted_by_the_families_that_occur_and_dealt_to_all_cores(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "x", None), ("b", None, 1)], "k string, t string, n long")
    counts = values.value_counts(df, ["k"], kept=False)
    assert counts.rows.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    plan = counts.rows.select("n")._jdf.queryExecution().optimizedPlan().toString()
    (grouped,) = [line for line in plan.splitlines() if "Aggregate [" in line]
    assert grouped.split("Aggregate ")[1].split("]")[0].count("#") == 4  # k, position, text, whole
    got = sorted((r.k, r.position, str(r.text), str(r.whole), r.n) for r in counts.rows.collect())
    assert got == [("a", 0, "x", "None", 2), ("a", 1, "None", "1", 1), ("a", 1, "None", "None", 1), ("b", 0, "None", "None", 1), ("b", 1, "None", "1", 1)]


def test_kept_analysis_reads_the_table_once(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5, datetime(2024, 1, 1)), ("a", 2.5, datetime(2024, 2, 1))], "k string, v double, at timestamp_ntz")
    df.write.parquet(f"{tmp_path}/t")
    lazy = analysis.analyze(tables.load_table(spark, f"{tmp_path}/t", format="parquet"), ["k"], "v", "at")
    kept = lazy.kept()
    for name in ("profile", "numeric_summary", "date_summary", "series", "trend", "changes", "anomalies"):
        alike(getattr(kept, name), getattr(lazy, name))
        assert str(tmp_path) not in getattr(kept, name)._jdf.queryExecution().optimizedPlan().toString()


def test_medians_leave_no_group_in_one_task(spark):
    """The values of a column or group are not sorted in one task to meet their bracket."""
    df = spark.range(100_000).selectExpr("id % 2 as k", "double(id) as v")
    whole = summary.numeric_summary(df)
    # One join is left, that of the finished summary with its medians.
    assert whole._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == 1
    assert {r["name"]: r["median"] for r in whole.collect()} == {"k": 0.5, "v": 49999.5}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keyed = summary.numeric_summary(df, ["k"])
        joins = [line for line in keyed._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning(" in line]
        assert any("__salt" in line for line in joins)
        assert {r["k"]: r["median"] for r in keyed.collect()} == {0: 49999.0, 1: 50000.0}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
