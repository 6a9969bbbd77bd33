from __future__ import annotations

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sumwise.operators import dates, profile, schema, series
from conftest import by


@pytest.mark.parametrize(
    "texts, order, share",
    [
        (["13/02/2024", "03/04/2024", "05/05/2024"], "day_first", 3),
        (["02/13/2024", "03/04/2024"], "month_first", 2),
        (["03/04/2024", "05/05/2024", "1/2/24"], None, 1),
        (["02-Jan-24", "3-February-2024", "04 sep 2023", "Sept. 5, 2023", "Mar 6 24", "7jan2024"], None, 6),
        (["20240105", "20231231", "20241305", "2024.1.5", "2024-01-05T10:11", "2024/01/05 23:59:59"], None, 5),
        (["13/02/2024", "02/13/2024", "14.02.2024 10:30", "31/02/2024", "x"], "day_first", 2),
        (["1-2-3", "1/2-2024", "99/99/9999", "12345678", "May", "1,234", ""], None, 0),
    ],
)
def test_orders(spark, texts, order, share):
    r = dates.date_orders(spark.createDataFrame([(t,) for t in texts], "t string"), "t").first()
    assert (r["order"], r["cells"], r["dates"]) == (order, len(texts), share)


def test_dates_match_brute_force(spark):
    """Random dates in many spellings come back as what they were, under the order of their key."""
    rng = random.Random(2)
    rows = []
    for i in range(400):
        key = rng.choice(["dmy", "mdy", "any"])
        at = datetime(rng.randint(1970, 2067), rng.randint(1, 12), rng.randint(1, 28), rng.randint(0, 23), rng.randint(0, 59))
        spell = {"dmy": ["%d/%m/%Y", "%d.%m.%y", "%d-%m-%Y %H:%M"], "mdy": ["%m/%d/%Y", "%m-%d-%y"], "any": ["%Y%m%d", "%d-%b-%y", "%B %d, %Y", "%Y.%m.%d %H:%M"]}
        how = rng.choice(spell[key])
        rows.append((key, at.strftime(how), at if "%H" in how else at.replace(hour=0, minute=0)))
    df = spark.createDataFrame(rows, "k string, t string, want timestamp_ntz").repartition(3)
    read = dates.with_dates(df, "t", "got", ["k"])
    assert read.columns == [*df.columns, "got"] and read.where("got is distinct from want").collect() == []
    months = series.monthly_series(read.withColumn("v", F.lit(1.0)), "got", "v", ["k"])
    assert months.agg(F.sum("value")).first()[0] == 400.0
    alone = dates.with_dates(df.where("k = 'dmy'"), "t", "got")
    assert alone.where("got is distinct from want").count() == 0


def test_profile_and_schema_know_mined_dates(spark):
    rows = [(f"{d:02d}/02/2024", f"{d:02d}-Jan-24", f"202401{d:02d}", f"0{d % 9 + 1}/0{d % 8 + 2}/2024", f"1{d}") for d in range(1, 25)]
    df = spark.createDataFrame(rows, "dmy string, named string, compact string, unclear string, other string")
    for approx in (False, True):
        kinds = {n: r["inferred_type"] for n, r in by(profile.column_profile(df, approx=approx), "name").items()}
        assert kinds == {"dmy": "date-like", "named": "date-like", "compact": "date-like", "unclear": "text", "other": "text"}
    roles = {n: r["role"] for n, r in by(schema.column_schema(df), "name").items()}
    assert roles["dmy"] == roles["named"] == roles["compact"] == "date" and roles["unclear"] != "date"
