"""Tables, their columns by position, and the catalog of registered datasets."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Mapping, Sequence
from functools import reduce
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sumwise.functions.basics import FLOATS
from sumwise.operators.summary import iso_text
from sumwise.sources.workbooks import KEYS, load_workbooks

READERS = {".parquet": "parquet", ".csv": "csv", ".json": "json", ".orc": "orc"}
WORKBOOK = "xlsx"
FILE_ROLES = ["previous", "current", "reference", "comparison"]
DATASET_TYPE = "dataset_id string, path string, display_name string, role string"


def load_table(
    spark: SparkSession, path: str, nan_as_null: bool = True, schema=None, format: str | None = None
) -> DataFrame:
    """A table from parquet, CSV, JSON, ORC or workbooks (`.xlsx`): a file, or a folder of files.

    `format` names the format of a folder, whose name mostly has no extension; else the
    extension decides.  Raises FileNotFoundError for a path that does not exist and ValueError
    for another extension or format.  Without a `schema` all columns of a CSV are text, so
    the data is read once, and the cleaning decides what they hold.  NaN becomes NULL in
    floating point columns only, so filters on all other columns still reach the scan.  Of a
    workbook the first sheet is read; `load_workbooks` has the others.
    """
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location):
        raise FileNotFoundError(f"table not found: {path}")
    suffix = PurePosixPath(path).suffix.lower()
    kinds = {**READERS, f".{WORKBOOK}": WORKBOOK}
    if format is None and suffix not in kinds:
        raise ValueError(f"unsupported file extension: {suffix}")
    kind = format or kinds[suffix]
    if kind not in kinds.values():
        raise ValueError(f"unsupported format: {kind}")
    if kind == WORKBOOK:
        return load_workbooks(spark, path, 0, schema).drop(*KEYS)
    reader = spark.read.format(kind)
    if kind == "csv":
        reader = reader.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    return without_nan(df) if nan_as_null else df


def without_nan(df: DataFrame) -> DataFrame:
    fields = df.schema.fields
    if not any(isinstance(f.dataType, FLOATS) for f in fields):
        return df
    return df.select(
        *[
            F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, FLOATS) else F.col(f.name)
            for f in fields
        ]
    )


def unique_names(names: Sequence[str]) -> list[str]:
    """Names that address one column each: a repeated name gets its position appended."""
    seen = Counter(names)
    return [n if seen[n] == 1 else f"{n}__{i}" for i, n in enumerate(names)]


def column_catalog(df: DataFrame, names: Sequence[str] | None = None, dataset_id: str | None = None) -> DataFrame:
    """`dataset_id, position, name, physical_name, dtype`: one row per column of one table.

    `names` are the names as they were read, which may repeat; `df` carries unique ones.
    """
    shown = list(names) if names is not None else df.columns
    rows = [
        (dataset_id, i, name, f.name, f.dataType.simpleString())
        for i, (name, f) in enumerate(zip(shown, df.schema.fields, strict=True))
    ]
    return df.sparkSession.createDataFrame(
        rows, "dataset_id string, position int, name string, physical_name string, dtype string"
    )


def register_dataset(spark: SparkSession, path: str, display_name: str | None = None, role: str | None = None) -> DataFrame:
    """One row of the dataset catalog with a fresh id; the name defaults to the file name."""
    if role is not None and role not in FILE_ROLES:
        raise ValueError(f"unknown role: {role}")
    row = (uuid.uuid4().hex, path, display_name or PurePosixPath(path).name, role)
    return spark.createDataFrame([row], DATASET_TYPE)


def stack_datasets(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Several tables as one, told apart by `dataset_id`; columns a table lacks are NULL."""
    tagged = [df.select(F.lit(d).alias("dataset_id"), "*") for d, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def plain_values(df: DataFrame) -> DataFrame:
    """The table as JSON can carry it: NaN is NULL, moments are ISO text."""

    def plain(f: T.StructField) -> Column:
        c = F.col(f.name)
        if isinstance(f.dataType, FLOATS):
            return F.when(~F.isnan(c), c)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return iso_text(c.cast("timestamp_ntz"))
        return c

    return df.select(*[plain(f).alias(f.name) for f in df.schema.fields])


def as_json(df: DataFrame, keys: Sequence[str] = (), name: str = "json") -> DataFrame:
    """`keys, json`: every row as one JSON object, absent values left out."""
    plain = plain_values(df)
    rest = [c for c in plain.columns if c not in keys]
    return plain.select(*keys, F.to_json(F.struct(*rest)).alias(name))


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write parquet, JSON, CSV or ORC, by the extension of `path`."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix not in READERS:
        raise ValueError(f"unsupported file extension: {suffix}")
    out = plain_values(df) if suffix in (".json", ".csv") else df
    writer = out.write.mode(mode).format(READERS[suffix])
    (writer.option("header", True) if suffix == ".csv" else writer).save(path)
