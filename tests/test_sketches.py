from __future__ import annotations

import random

from pyspark.sql import functions as F

from sumwise.operators import sketches as sk
from conftest import by


def table(spark, n=30_000, seed=1):
    rng = random.Random(seed)
    rows = [
        (i % 3, None if i % 10 == 0 else rng.gauss(0, 100), rng.randint(0, 5000), f"t{rng.randint(0, 700)}", float("nan") if i % 2 else 0.0)
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "k int, x double, n long, t string, z double").repartition(5)


def within(profile, df):
    """Exact parts are equal, the others within the bounds of the sketches."""
    for name, r in by(profile, "name").items():
        value = F.col(name) if name == "t" else F.when(~F.isnan(name), F.col(name)) if name in ("x", "z") else F.col(name)
        values = [v[0] for v in df.select(value).where(value.isNotNull()).collect()]
        assert (r["row_count"], r["missing_count"]) == (df.count(), df.count() - len(values))
        exact = len(set(values))
        assert abs(r["unique_count"] - exact) <= sk.DISTINCT_ERROR * exact + 1
        if name == "t":
            assert r["median"] is None and r["sum"] is None
            continue
        assert (r["min"], r["max"]) == (min(values), max(values)) and abs(r["sum"] - sum(values)) < 1e-6 * sum(map(abs, values)) + 1e-9
        for q, quantile in zip(sk.QUARTILES, ("lower_quartile", "median", "upper_quartile")):
            below, upto = sum(v < r[quantile] for v in values), sum(v <= r[quantile] for v in values)
            assert below <= (q + sk.RANK_ERROR) * len(values) + 1 and upto >= (q - sk.RANK_ERROR) * len(values) - 1


def test_merged_parts_are_as_good_as_the_whole(spark, tmp_path):
    df = table(spark)
    within(sk.sketched_profile(sk.column_sketches(df.drop("k"))), df)
    parts = [sk.column_sketches(df.where(F.col("k") == k).drop("k")) for k in range(3)]
    within(sk.sketched_profile(sk.merged_sketches(parts)), df)
    for k, part in enumerate(parts):  # files that arrive one after another
        part.write.mode("append").parquet(f"{tmp_path}/kept")
        so_far = df.where(F.col("k") <= k)
        within(sk.sketched_profile(sk.merged_sketches(spark.read.parquet(f"{tmp_path}/kept"))), so_far)


def test_keys_and_nothing(spark):
    df = table(spark, 3000)
    keyed = sk.merged_sketches([sk.column_sketches(df.where("n % 2 = 0"), ["k"]), sk.column_sketches(df.where("n % 2 = 1"), ["k"])], ["k"])
    for k in range(3):
        within(sk.sketched_profile(keyed, ["k"]).where(F.col("k") == k), df.where(F.col("k") == k))
    nothing = by(sk.sketched_profile(sk.merged_sketches(sk.column_sketches(df.where("false")))), "name")
    assert nothing["x"]["row_count"] == 0 and nothing["x"]["median"] is None and nothing["t"]["unique_count"] == 0
    missing = sk.column_sketches(spark.createDataFrame([(None, None)], "x double, t string"))
    both = by(sk.sketched_profile(sk.merged_sketches([missing, missing])), "name")
    assert (both["x"]["missing_count"], both["x"]["unique_count"], both["x"]["median"], both["t"]["unique_count"]) == (2, 0, None, 0)
