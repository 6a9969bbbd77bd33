"""Small helpers around keys, missing values and types."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

TASKS_A_CORE = 4
FLOATS = (T.DoubleType, T.FloatType)
NUMBERS = (T.NumericType, T.BooleanType)
TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_number(c: Column | str) -> Column:
    """Double value in which NaN counts as missing, like NULL."""
    d = col(c).cast("double")
    return F.when(~F.isnan(d), d)


def number_of(df: DataFrame, name: str) -> Column:
    """`as_number` for a column of `df`; the NaN test is left out where NaN cannot occur."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.BooleanType):
        return F.col(name).cast("int").cast("double")
    return as_number(name) if isinstance(kind, FLOATS) else F.col(name).cast("double")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """What `use` makes of `value`, which is evaluated once however often `use` names it, and only where the result is.

    An expression that stands twice in a branch, or inside a function of array elements, is evaluated each time.
    """
    return F.transform(F.array(value), use)[0]


def by_keys(keys: Iterable[str], *order: Column | str) -> WindowSpec:
    spec = Window.partitionBy(*keys)
    return spec.orderBy(*order) if order else spec


def join_on(left: DataFrame, right: DataFrame, keys: Iterable[str], how: str = "left", shuffled: bool = False) -> DataFrame:
    """Null-safe equi-join on columns of the same name, which are kept once.

    `shuffled` joins never broadcast a side: for sides with a row for each request, whose size Spark
    guesses from the files behind them, many times too small where texts are made or compress well.
    """
    keys = list(keys)
    if not keys:
        raise ValueError("a join needs a key; give a single table a constant column")
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    test = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys], F.lit(True)
    )
    joined = left.join(renamed.hint("merge") if shuffled else renamed, test, how)
    return joined.drop(*[f"__r_{k}" for k in keys]) if how not in ("left_semi", "left_anti") else joined


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor reaches, as the session names it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor reaches")
    return named


_STORED: list[str] = []


def new_folder(spark: SparkSession) -> str:
    """A fresh path in the shared folder; `drop_stored` or the end of the program removes it."""
    if not _STORED:
        atexit.register(drop_stored, spark)
    path = f"{shared_dir(spark).rstrip('/')}/sumwise/{uuid.uuid4().hex}"
    _STORED.append(path)
    return path


def drop_stored(spark: SparkSession) -> None:
    """Removes every folder that `new_folder` has named; results that still read them end here."""
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _STORED:
        path = jvm.org.apache.hadoop.fs.Path(_STORED.pop())
        path.getFileSystem(conf).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read back.

    For small results that many later steps read: their size is known from then on, and
    a lost executor does not bring back the scans they came from.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_together(*frames: DataFrame) -> list[DataFrame]:
    """`stored` for several results at once, so that their jobs share the cluster."""
    shared_dir(frames[0].sparkSession)
    with ThreadPoolExecutor(len(frames)) as pool:
        return list(pool.map(stored, frames))


def spread(df: DataFrame, *by: str) -> DataFrame:
    """`df` dealt by columns to TASKS_A_CORE tasks for each core, a number that Spark does not lower.

    For rows that cost far more than their bytes tell: dealt by size, one task more than there are
    cores doubles the time of a stage.
    """
    return df.repartition(TASKS_A_CORE * df.sparkSession.sparkContext.defaultParallelism, *by)


ASKED = "__asked"


def once_each(rows: DataFrame, ids: Sequence[str], fields: Sequence[str], made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`ids` of every row with what `made` finds for its `fields`, found once for all rows that are equal in them.

    `made` gets the different `fields` with a struct of them as `__asked`, and gives one row for each
    `__asked`.  Rows are compared as they are, so no two different ones share a result.
    """
    asked = F.struct(*fields).alias(ASKED)
    results = stored(made(stored(rows.select(*fields).distinct().select(asked, *fields))))
    return join_on(rows.select(*ids, asked), results.drop(*ids), [ASKED]).drop(ASKED)


def computed_once(df: DataFrame, kept: Iterable[Column | str], **made: Column) -> DataFrame:
    """`kept` columns of `df` and the `made` ones, which nothing later takes apart.

    A filter or projection on a computed column is otherwise merged with the expression
    behind it and evaluates it again.  A generator of one row stands between the two.
    """
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))
