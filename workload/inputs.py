"""Tables the queries read, and tables derived from them; the SQL twin is beside each."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumwise.functions.basics import spread, stored
from sumwise.sources.tables import load_table
from sumwise.sources.workbooks import workbook_bytes


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return load_table(spark, f"{folder}/{name}.parquet")


def rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def pick(value, *options):
    """The option at the place `value`; the last one for every other value."""
    branch = None
    for i, o in enumerate(options[:-1]):
        branch = F.when(value == i, o) if branch is None else branch.when(value == i, o)
    return branch.otherwise(options[-1])


# Orders with text as people write it: one kind of cell for each remainder of the key.


def messy_orders(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    whole = F.expr("cast(cast(round(o_totalprice * 100) as bigint) div 100 as string)")
    frac = F.lpad((cents % 100).cast("string"), 2, "0")
    base = F.concat(whole, F.lit("."), frac)
    grouped = F.format_number("o_totalprice", 2)
    day = F.col("o_orderdate")
    k = F.col("o_orderkey") % 20

    def joined(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    cell = pick(
        k,
        base,
        joined("$", base),
        joined(base, "€"),
        grouped,
        joined("£", grouped),
        joined(whole, "%"),
        joined(" ", base, " "),
        joined(whole, ".", F.lpad(frac, 3, "0")),
        joined(whole, ",", frac),
        joined("₹", base),
        joined("-$", base),
        joined("$-", base),
        F.date_format(day, "yyyy-MM-dd"),
        F.date_format(day, "dd/MM/yyyy"),
        F.date_format(day, "MMMM d, yyyy"),
        F.date_format(day, "yyyy/M/d"),
        joined(whole, "%%"),
        joined("$", base, "€"),
        F.lit(None).cast("string"),
        joined(F.col("o_orderpriority"), ""),
    )
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("grp"),
        cell.alias("mixed"),
        F.when(F.col("o_orderkey") % 9 != 0, joined("$", grouped)).alias("price"),
        joined((F.col("o_orderkey") % 100).cast("string"), "%").alias("share"),
        F.date_format(day, "yyyy-MM-dd").alias("day"),
        joined("O-", F.col("o_orderkey").cast("string")).alias("code"),
        F.col("o_orderstatus").alias("status"),
    )


MESSY = """messy0 AS (
  SELECT *, CAST(CAST(round(o_totalprice * 100) AS BIGINT) // 100 AS VARCHAR) AS whole,
         lpad(CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0') AS frac,
         format('{:,.2f}', o_totalprice) AS grouped
  FROM orders),
messy AS (
  SELECT o_orderkey AS id, o_orderpriority AS grp,
    CASE o_orderkey % 20
      WHEN 0 THEN whole || '.' || frac
      WHEN 1 THEN '$' || whole || '.' || frac
      WHEN 2 THEN whole || '.' || frac || '€'
      WHEN 3 THEN grouped
      WHEN 4 THEN '£' || grouped
      WHEN 5 THEN whole || '%'
      WHEN 6 THEN ' ' || whole || '.' || frac || ' '
      WHEN 7 THEN whole || '.' || lpad(frac, 3, '0')
      WHEN 8 THEN whole || ',' || frac
      WHEN 9 THEN '₹' || whole || '.' || frac
      WHEN 10 THEN '-$' || whole || '.' || frac
      WHEN 11 THEN '$-' || whole || '.' || frac
      WHEN 12 THEN strftime(o_orderdate, '%Y-%m-%d')
      WHEN 13 THEN strftime(o_orderdate, '%d/%m/%Y')
      WHEN 14 THEN strftime(o_orderdate, '%B %-d, %Y')
      WHEN 15 THEN strftime(o_orderdate, '%Y/%-m/%-d')
      WHEN 16 THEN whole || '%%'
      WHEN 17 THEN '$' || whole || '.' || frac || '€'
      WHEN 18 THEN NULL
      ELSE o_orderpriority END AS mixed,
    CASE WHEN o_orderkey % 9 <> 0 THEN '$' || grouped END AS price,
    CAST(o_orderkey % 100 AS VARCHAR) || '%' AS share,
    strftime(o_orderdate, '%Y-%m-%d') AS day,
    'O-' || CAST(o_orderkey AS VARCHAR) AS code,
    o_orderstatus AS status
  FROM messy0)"""


def _number(c: str) -> str:
    return (
        f"CASE WHEN regexp_matches({c}, '^-?[0-9]+\\.[0-9]{{3}}$') THEN NULL"
        f" WHEN regexp_matches({c}, '^-?([0-9]+|[0-9]{{1,3}}(,[0-9]{{3}})+)(\\.[0-9]+)?$')"
        f" THEN CAST(replace({c}, ',', '') AS DOUBLE) END"
    )


def _number_warning(c: str) -> str:
    return (
        f"CASE WHEN regexp_matches({c}, '^-?[0-9]+\\.[0-9]{{3}}$') THEN 'ambiguous_decimal_or_thousands'"
        f" WHEN regexp_matches({c}, '^-?([0-9]+|[0-9]{{1,3}}(,[0-9]{{3}})+)(\\.[0-9]+)?$') THEN NULL"
        f" WHEN regexp_matches({c}, '^-?[0-9]+(,[0-9]+)+(\\.[0-9]+)?$') THEN 'ambiguous_thousands_separator' END"
    )


def cells_sql(source: str, raw: str = "raw") -> str:
    """CTEs that read the text column `raw` of `source` into `cells`, rule by rule."""
    symbols = f"len(regexp_extract_all(s, '\\p{{Sc}}'))"
    return f"""c1 AS (SELECT *, trim({raw}) AS s FROM {source}),
c2 AS (SELECT *,
    CASE WHEN s LIKE '%\\%%' ESCAPE '\\' THEN
           CASE WHEN regexp_matches(s, '^[^%]*%$') THEN '%' ELSE 'invalid_percentage_format' END
         WHEN {symbols} > 1 THEN 'multiple_currency_symbols'
         WHEN {symbols} = 1 THEN
           CASE WHEN NOT regexp_matches(s, '^\\p{{Sc}}|\\p{{Sc}}$') THEN 'unsupported_currency_symbol_position'
                WHEN NOT regexp_matches(s, '[$€£¥]') THEN 'unrecognized_currency_symbol' ELSE '$' END
         ELSE '' END AS mark,
    trim(regexp_replace(s, '[%$€£¥]', '', 'g')) AS body FROM c1),
c3 AS (SELECT *,
    CASE WHEN mark IN ('%', '$', '') THEN {_number("body")} END AS n,
    CASE WHEN mark IN ('%', '$', '') THEN {_number_warning("body")} ELSE mark END AS w,
    CASE WHEN mark = '' THEN coalesce(try_strptime(s, '%Y-%m-%d'), try_strptime(s, '%Y/%m/%d'),
         try_strptime(s, '%B %d, %Y'), try_strptime(s, '%d %B %Y')) END AS d FROM c2),
cells AS (SELECT *,
    CASE WHEN mark = '%' THEN n / 100.0 ELSE n END AS num,
    CASE WHEN n IS NULL THEN CASE WHEN w IS NULL AND d IS NOT NULL THEN strftime(d, '%Y-%m-%d') ELSE {raw} END END AS txt,
    CASE WHEN n IS NOT NULL THEN CASE mark WHEN '%' THEN 'percentage' WHEN '$' THEN 'currency' ELSE 'numeric' END
         WHEN w IS NULL AND d IS NOT NULL THEN 'date' END AS type,
    CASE WHEN n IS NOT NULL THEN NULL WHEN w IS NOT NULL THEN w
         WHEN d IS NOT NULL THEN NULL
         WHEN mark = '%' THEN 'invalid_percentage_format' WHEN mark = '$' THEN 'invalid_currency_format'
         WHEN regexp_matches(s, '^[0-9]{{1,2}}[/-][0-9]{{1,2}}[/-][0-9]{{2,4}}$') THEN 'ambiguous_date_format' END AS warning
    FROM c3)"""


# Shipments as six datasets; quantities are whole numbers, so their sums are exact.


def shipments(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    return lines.select(
        F.concat_ws("-", "l_returnflag", "l_linestatus").alias("dataset_id"),
        F.when(F.col("l_orderkey") % 11 != 0, F.col("l_quantity")).alias("quantity"),
        F.col("l_linenumber").alias("line_number"),
        F.col("l_shipdate").alias("shipped"),
    )


SHIPMENTS = """ships AS (
  SELECT l_returnflag || '-' || l_linestatus AS dataset_id,
         CASE WHEN l_orderkey % 11 <> 0 THEN l_quantity END AS quantity,
         l_linenumber AS line_number, l_shipdate AS shipped FROM lineitem)"""


BOOK_ROWS = 5000
BOOK_COLUMNS = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"]


def order_books(spark, folder):
    """`path, content`: a workbook for every BOOK_ROWS order keys, with a sheet for each order status in it."""

    def book(key, rows):
        sheets = {
            status: (BOOK_COLUMNS, part.sort_values("o_orderkey")[BOOK_COLUMNS].astype(object).values.tolist())
            for status, part in rows.groupby("o_orderstatus")
        }
        return pd.DataFrame({"path": [f"orders_{key[0]}.xlsx"], "content": [workbook_bytes(sheets)]})

    orders = table(spark, folder, "orders").withColumn("book", F.floor(F.col("o_orderkey") / BOOK_ROWS))
    return stored(spread(orders, "book").groupBy("book").applyInPandas(book, "path string, content binary"))
