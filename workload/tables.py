"""Sources, cleaning, summaries, profiles and column meaning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sumwise.functions.basics import stored
from sumwise.functions.text import read_cells
from sumwise.operators import clean, dates, profile, schema, sketches, summary, values
from sumwise.sources import tables
from sumwise.sources.workbooks import read_workbooks, workbook_columns
from workload.inputs import BOOK_ROWS, MESSY, cells_sql, messy_orders, order_books, pick, rounded, table

MONEY = ["sum", "mean", "min", "max", "std"]
GROUPS = ["grp"]


def q_load_table(spark, folder):
    return table(spark, folder, "customer")


def q_stack_datasets(spark, folder):
    stacked = tables.stack_datasets(
        {"customer": table(spark, folder, "customer"), "supplier": table(spark, folder, "supplier")}
    )
    return stacked.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("c_custkey").alias("customers"),
        F.count("s_suppkey").alias("suppliers"),
        F.round(F.sum(F.coalesce("c_acctbal", "s_acctbal")), 2).alias("balance"),
    )


def q_plain_values(spark, folder):
    return tables.plain_values(table(spark, folder, "events")).select("event_id", "ts", "value", "props")


def q_as_json(spark, folder):
    """Rows as JSON, read back field by field."""
    json = tables.as_json(table(spark, folder, "events"), ["event_id"])
    return json.select(
        "event_id",
        F.get_json_object("json", "$.ts").alias("ts"),
        F.get_json_object("json", "$.event_type").alias("event_type"),
        F.get_json_object("json", "$.value").cast("double").alias("value"),
    )


def _messy_with_date(spark, folder):
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), "o_orderdate")
    return messy_orders(spark, folder).join(orders, "id")


def q_read_cells(spark, folder):
    found = read_cells(messy_orders(spark, folder).select("id", "mixed"), {"mixed": "found"})
    df = found.select("id", "found.*")
    return rounded(df, 6, "num").select("id", "num", F.col("text").alias("txt"), "type", "was_changed", "warning")


def q_normalize_table(spark, folder):
    df = clean.normalize_table(messy_orders(spark, folder))
    return df.select(
        "id", F.round("mixed__num", 6).alias("mixed__num"), "mixed__text", "price__num", "price__text", "day__text"
    )


def q_resolved_columns(spark, folder):
    return clean.resolved_columns(messy_orders(spark, folder), GROUPS)


def q_cleaned_table(spark, folder):
    df = clean.cleaned_table(messy_orders(spark, folder).select("id", "price", "share", "day"))
    return rounded(df, 4, "price", "share")


def q_cleaning_report(spark, folder):
    return clean.cleaning_report(messy_orders(spark, folder), GROUPS, most_examples=0)


def q_cleaning_examples_in_file_order(spark, folder):
    """The first unresolved cells of each group as they stand in the file."""
    df = clean.cleaning_report(messy_orders(spark, folder), GROUPS, columns=["mixed", "price"])
    shown = F.transform("unresolved_examples", lambda e: F.concat(e["raw"], F.lit("|"), e["warning"]))
    return df.select("grp", "name", "unresolved_count", F.array_join(shown, ";").alias("examples"))


def q_cleaning_examples(spark, folder):
    df = clean.cleaning_report(messy_orders(spark, folder), order_by=["id"], columns=["mixed", "price", "id"])
    return df.select(
        "position",
        "name",
        "unresolved_count",
        F.array_join(
            F.transform("unresolved_examples", lambda e: F.concat(e["raw"], F.lit("|"), e["warning"])), ";"
        ).alias("examples"),
    )


def q_cleaning_examples_by_group(spark, folder):
    df = clean.cleaning_report(messy_orders(spark, folder), GROUPS, order_by=["id"], columns=["mixed"])
    return df.select(
        "grp",
        "unresolved_count",
        F.array_join(F.transform("unresolved_examples", lambda e: e["raw"]), ";").alias("examples"),
    )


def q_numeric_summary(spark, folder):
    df = summary.numeric_summary(table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"])
    return rounded(rounded(df, 2, *MONEY), 3, "median")


def q_numeric_summary_all(spark, folder):
    df = summary.numeric_summary(table(spark, folder, "lineitem"))
    return rounded(rounded(df, 2, *MONEY), 3, "median")


def q_numeric_summary_narrowed(spark, folder):
    """Groups of a third of all rows."""
    df = summary.numeric_summary(table(spark, folder, "lineitem"), ["l_returnflag"])
    return rounded(rounded(df, 2, *MONEY), 3, "median")


def q_numeric_summary_cleaned(spark, folder):
    df = summary.numeric_summary(messy_orders(spark, folder), GROUPS, clean_text=True)
    return rounded(rounded(df, 2, *MONEY), 3, "median")


def q_numeric_summary_approx(spark, folder):
    df = summary.numeric_summary(table(spark, folder, "lineitem"), ["l_returnflag"], approx=True)
    return rounded(rounded(df, 2, *MONEY), 3, "median")


def q_approximate_median_rank(spark, folder):
    """Whether the rank of every approximate median is within the bound of its sketch."""
    lines, keys = table(spark, folder, "lineitem"), ["l_returnflag"]
    names = [name for _, name in summary.numeric_columns(lines, keys)]
    about = summary.numeric_summary(lines, keys, approx=True).select(*keys, "name", "median")
    cells = lines.select(*keys, *[F.col(n).cast("double").alias(n) for n in names]).unpivot(keys, names, "name", "value")
    n, off = F.count("value"), F.count("value") / 10_000 + 1
    within = (F.count_if(F.col("value") < F.col("median")) <= n / 2 + off) & (F.count_if(F.col("value") <= F.col("median")) >= n / 2 - off)
    return cells.join(about, [*keys, "name"]).groupBy(*keys, "name").agg(n.alias("n"), within.alias("within_bound"))


def q_approximate_distinct_bound(spark, folder):
    """Whether every approximate distinct count is within three deviations of its sketch."""
    lines, keys = table(spark, folder, "lineitem"), ["l_returnflag"]
    about = profile.column_profile(lines, keys, approx=True).select(*keys, "name", F.col("unique_count").alias("about"))
    exact = profile.column_profile(lines, keys).select(*keys, "name", "unique_count")
    within = F.abs(F.col("about") - F.col("unique_count")) <= 3 * 0.05 * F.col("unique_count") + 1
    return exact.join(about, [*keys, "name"]).select(*keys, "name", "unique_count", within.alias("within_bound"))


def _spelled(spark, folder):
    """Order dates, in each priority spelled in another way."""
    o, day = table(spark, folder, "orders"), F.col("o_orderdate")
    spelling = pick(
        F.substring("o_orderpriority", 1, 1).cast("int"), F.lit(None).cast("string"), F.date_format(day, "dd/MM/yyyy"), F.date_format(day, "d.M.yy"),
        F.date_format(day, "MM/dd/yyyy"), F.date_format(day, "dd-MMM-yy"), F.date_format(day, "yyyyMMdd"),
    )
    return o.select("o_orderkey", "o_orderpriority", "o_totalprice", spelling.alias("written"))


def q_date_orders(spark, folder):
    return dates.date_orders(_spelled(spark, folder), "written", ["o_orderpriority"])


def q_dates_of_a_column(spark, folder):
    """Every spelled date read back in the order its column tells."""
    read = dates.with_dates(_spelled(spark, folder), "written", "moment", ["o_orderpriority"])
    return read.select("o_orderkey", "written", F.date_format("moment", "yyyy-MM-dd").alias("day"))


def q_mined_date_columns(spark, folder):
    found = profile.column_profile(_spelled(spark, folder), ["o_orderpriority"], columns=["written"])
    return found.select("o_orderpriority", "inferred_type", "unique_count")


def q_sketched_profile_bound(spark, folder):
    """Sketches of every month of orders, merged to priorities: what is exact, and whether the rest is within its bounds."""
    o = table(spark, folder, "orders").select("o_orderpriority", F.trunc("o_orderdate", "MM").alias("month"), "o_custkey", "o_totalprice", "o_orderstatus")
    keys, names = ["o_orderpriority"], ["o_custkey", "o_totalprice", "o_orderstatus"]
    monthly = sketches.column_sketches(o, [*keys, "month"]).drop("month")
    about = stored(sketches.sketched_profile(sketches.merged_sketches(monthly, keys), keys))
    cells = o.select(*keys, *[F.col(n).cast("string").alias(n) for n in names]).unpivot(keys, names, "name", "value").join(about, [*keys, "name"])
    number, n = F.col("value").try_cast("double"), F.count("value")
    off = sketches.RANK_ERROR * n + 1
    ranked = F.lit(True)
    for q, name in zip(sketches.QUARTILES, ("lower_quartile", "median", "upper_quartile")):
        ranked = ranked & (F.count_if(number < F.col(name)) <= q * n + off) & (F.count_if(number >= F.col(name)) >= (1 - q) * n - off)
    distinct = F.count_distinct("value")
    counted = F.abs(F.first("unique_count") - distinct) <= sketches.DISTINCT_ERROR * distinct + 1
    return cells.groupBy(*keys, "name").agg(
        F.first("row_count").alias("row_count"),
        F.round(F.first("sum"), 2).alias("total"),
        F.first("max").alias("most"),
        counted.alias("distinct_within"),
        (ranked | F.first("median").isNull()).alias("ranks_within"),
    )


def q_register_dataset(spark, folder):
    """Catalog rows of four tables, each with a fresh id, and what is loaded from their paths."""
    wanted = [("customer", "previous"), ("supplier", "current"), ("part", None), ("nation", "reference")]
    rows = [tables.register_dataset(spark, f"{folder}/{name}.parquet", name.title() if role else None, role) for name, role in wanted]
    catalog = reduce(DataFrame.unionByName, rows)
    loaded = [table(spark, folder, name).agg(F.count("*").alias("n"), F.lit(f"{folder}/{name}.parquet").alias("path")) for name, _ in wanted]
    fresh = F.col("dataset_id").rlike("^[0-9a-f]{32}$") & (F.count("*").over(Window.partitionBy("dataset_id")) == 1)
    return catalog.withColumn("fresh", fresh).join(reduce(DataFrame.unionByName, loaded), "path").select("display_name", "role", "fresh", "n")


def _counts(spark, folder, kept=True):
    return values.value_counts(messy_orders(spark, folder), GROUPS, kept=kept)


def q_numeric_summary_from_counts(spark, folder):
    df = values.numeric_summary_of(_counts(spark, folder))
    return rounded(rounded(df, 2, *MONEY), 3, "median")


def q_column_profile_from_counts(spark, folder):
    df = profile.profile_of(values.column_facts_of(_counts(spark, folder, kept=False)), GROUPS).drop("dtype")
    return rounded(df, 4, "missing_percentage")


def q_cleaning_report_from_counts(spark, folder):
    return values.cleaning_counts_of(_counts(spark, folder, kept=False))


def q_date_summary_from_counts(spark, folder):
    return values.date_summary_of(values.value_counts(table(spark, folder, "events"), ["event_type"]))


def q_known_columns(spark, folder):
    df = summary.numeric_summary(messy_orders(spark, folder), clean_text=True)
    return df.select("name").distinct()


def q_date_summary(spark, folder):
    return summary.date_summary(table(spark, folder, "events"), ["event_type"])


def _copies(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_returnflag", "l_linestatus", "l_quantity", F.when(F.col("l_tax") > 0.04, F.col("l_tax")).alias("l_tax")
    )


def q_table_profile(spark, folder):
    return profile.table_profile(_copies(spark, folder))


def q_table_profile_by_key(spark, folder):
    return profile.table_profile(_copies(spark, folder), ["l_returnflag"])


def q_duplicate_column_names(spark, folder):
    """Customers as datasets whose columns are named by the segment, which repeats."""
    c = table(spark, folder, "customer")
    catalog = c.select(F.col("c_nationkey").alias("dataset_id"), F.col("c_mktsegment").alias("name"))
    return profile.duplicate_column_names(catalog, ["dataset_id"])


def q_column_profile(spark, folder):
    df = profile.column_profile(table(spark, folder, "lineitem"))
    return df.drop("dtype")


def q_column_profile_by_key(spark, folder):
    df = profile.column_profile(messy_orders(spark, folder), GROUPS).drop("dtype")
    return rounded(df, 4, "missing_percentage")


def q_column_profile_approx(spark, folder):
    return profile.column_profile(messy_orders(spark, folder), GROUPS, approx=True)


def q_date_like_columns(spark, folder):
    return profile.date_like_columns(profile.column_profile(_messy_with_date(spark, folder)))


def q_missing_columns(spark, folder):
    df = profile.missing_columns(profile.column_profile(messy_orders(spark, folder), GROUPS), GROUPS)
    shown = F.transform(
        "columns", lambda c: F.concat(c["name"], F.lit(":"), c["missing_count"].cast("string"))
    )
    return df.select("grp", "value", F.array_join(shown, ";").alias("columns"))


def _meaning(df):
    return df.select(
        *[c for c in df.columns if c != "evidence"],
        F.array_join("evidence.sample_values", ";").alias("samples"),
    )


def q_column_schema(spark, folder):
    return _meaning(schema.column_schema(_messy_with_date(spark, folder), order_by=["id"]))


def q_column_schema_by_key(spark, folder):
    return _meaning(schema.column_schema(messy_orders(spark, folder), GROUPS, order_by=["id"]))


def q_column_schema_in_file_order(spark, folder):
    """The first values of each column of each kind of event as they stand in the file."""
    df = schema.column_schema(table(spark, folder, "events"), ["event_type"], columns=["event_id", "ts", "user_id", "props"])
    return _meaning(df).select("event_type", "position", "name", "samples")


def q_candidate_metadata(spark, folder):
    found = schema.column_schema(messy_orders(spark, folder), order_by=["id"])
    df = schema.candidate_metadata(found)
    return df.withColumn("sample_values", F.array_join("sample_values", ";")).drop("dtype")


def _proposals(spark, folder):
    """For every order status a proposal for the columns of that group."""
    o = messy_orders(spark, folder)
    rows = o.groupBy("grp").agg(F.min("id").alias("seed"))
    each = rows.select("grp", "seed", F.explode(F.array(*[F.lit(c) for c in ("id", "price", "code", "status")])).alias("name"))
    pick = F.pmod(F.col("seed"), F.lit(3))
    return each.select(
        "grp",
        "name",
        F.when(F.col("name") == "id", "identifier").when(pick == 0, "measure").when(pick == 1, "wrong").alias("role"),
        F.when(F.col("name") == "price", "numeric").alias("semantic_type"),
        F.when(F.col("name") == "price", "EUR").alias("unit"),
        F.when(F.col("name") == "status", "sometimes").otherwise("none").alias("time_role"),
    )


def q_merge_schema_proposals(spark, folder):
    found = schema.column_schema(messy_orders(spark, folder), GROUPS)
    df = schema.merge_schema_proposals(found, _proposals(spark, folder), GROUPS)
    log = F.transform(
        "decisions",
        lambda d: F.concat(d["field"], F.lit("="), F.coalesce(d["value"], d["reason"])),
    )
    return df.select(
        "grp", "name", "role", "semantic_type", "unit", "time_role", F.array_join(log, ";").alias("decisions")
    )


def q_load_workbooks(spark, folder):
    """All sheets of all workbooks as one table, names and types found in the files."""
    books = read_workbooks(order_books(spark, folder))
    return books.withColumn("o_orderdate", F.col("o_orderdate").cast("date"))


def q_workbook_columns(spark, folder):
    return workbook_columns(order_books(spark, folder)).select("file", "sheet", "position", "name", "type")


QUERIES = {name[2:]: f for name, f in list(globals().items()) if name.startswith("q_")}


def _summary_sql(source: str, columns: list[tuple[int, str, str]], keys: str = "") -> str:
    """One SELECT per column; `columns` holds position, name and expression."""
    group = f" GROUP BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return "\nUNION ALL ".join(
        f"SELECT {lead}{p} AS position, '{n}' AS name, count({e}) AS count, count(*) - count({e}) AS missing_count, "
        f"round(sum({e}), 2) AS sum, round(avg({e}), 2) AS mean, round(quantile_cont({e}, 0.5), 3) AS median, "
        f"round(min({e}), 2) AS min, round(max({e}), 2) AS max, round(stddev_samp({e}), 2) AS std FROM {source}{group}"
        for p, n, e in columns
    )


def _doubles(*columns: tuple[int, str]) -> list[tuple[int, str, str]]:
    return [(p, c, f"CAST({c} AS DOUBLE)") for p, c in columns]


_LINES = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_NUMBERS = _doubles(*enumerate(_LINES))
_PRICE = "CAST(replace(replace(price, '$', ''), ',', '') AS DOUBLE)"
_SHARE = "CAST(replace(share, '%', '') AS DOUBLE) / 100.0"
_TEXTS = ["mixed", "price", "share", "day", "code", "status"]


def _profile_sql(source: str, columns: list[tuple[int, str, str]], keys: str = "") -> str:
    lead, group = (f"{keys}, ", f" GROUP BY {keys}") if keys else ("", "")
    return "\nUNION ALL ".join(
        f"SELECT {lead}{p} AS position, '{n}' AS name, {t} AS inferred_type, count(DISTINCT {n}) AS unique_count, "
        f"count(*) - count({n}) AS missing_count, round((count(*) - count({n})) / count(*) * 100, 4) AS missing_percentage "
        f"FROM {source}{group}"
        for p, n, t in columns
    )


def _messy_columns(first: int) -> list[tuple[int, str, str]]:
    kinds = {"id": "'numeric'", "day": "'date-like'", "grp": "'text'"}
    names = ["id", "grp", *_TEXTS] if first else ["id", *_TEXTS]
    return [(i, n, kinds.get(n, "'text'")) for i, n in enumerate(names)]


def _samples(columns: list[str], keys: str = "") -> str:
    """The first three values of each column in the order of the id."""
    lead = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    group = f" GROUP BY {keys}" if keys else ""
    return "\nUNION ALL ".join(
        f"SELECT {lead}'{c}' AS name, string_agg(v, ';' ORDER BY rn) AS samples FROM (SELECT {lead}CAST({c} AS VARCHAR) AS v, "
        f"row_number() OVER ({part}ORDER BY id) AS rn FROM messy WHERE {c} IS NOT NULL) WHERE rn <= 3{group}"
        for c in columns
    )


_MEANING = """CASE name WHEN 'id' THEN 'measure' WHEN 'price' THEN 'measure' WHEN 'share' THEN 'measure'
         WHEN 'day' THEN 'date' WHEN 'o_orderdate' THEN 'date' WHEN 'code' THEN 'identifier' ELSE 'dimension' END AS role,
       CASE name WHEN 'id' THEN 'numeric' WHEN 'price' THEN 'currency' WHEN 'share' THEN 'percentage'
         WHEN 'day' THEN 'date' WHEN 'o_orderdate' THEN 'date' WHEN 'code' THEN 'identifier' ELSE 'text' END AS semantic_type,
       CASE name WHEN 'price' THEN 'USD' WHEN 'share' THEN '%' END AS unit,
       CASE name WHEN 'day' THEN 'period' WHEN 'o_orderdate' THEN 'period' ELSE 'none' END AS time_role,
       CASE name WHEN 'id' THEN 0.9 WHEN 'day' THEN 0.9 WHEN 'o_orderdate' THEN 0.9 ELSE 0.65 END AS confidence"""


def _positions(names: list[str]) -> str:
    return "CASE name " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(names)) + " END AS position"


_WITH_DATE = "dated AS (SELECT messy.*, o_orderdate FROM messy JOIN orders ON id = o_orderkey)"
_ALL = ["id", "grp", *_TEXTS]

SQL = {
    "load_workbooks": f"""SELECT 'orders_' || (o_orderkey // {BOOK_ROWS}) || '.xlsx' AS file, o_orderstatus AS sheet,
        (1 + row_number() OVER (PARTITION BY o_orderkey // {BOOK_ROWS}, o_orderstatus ORDER BY o_orderkey))::INTEGER AS row,
        o_orderkey, o_custkey, o_totalprice, o_orderdate::DATE AS o_orderdate, o_orderpriority FROM orders""",
    "workbook_columns": f"""WITH kinds AS (
        SELECT 'orders_' || (o_orderkey // {BOOK_ROWS}) || '.xlsx' AS file, o_orderstatus AS sheet,
          CASE WHEN bool_and(o_totalprice = floor(o_totalprice)) THEN 'bigint' ELSE 'double' END AS price FROM orders GROUP BY 1, 2
      ) SELECT file, sheet, position::INTEGER AS position, name, CASE position WHEN 2 THEN price ELSE type END AS type FROM kinds,
        (VALUES (0, 'o_orderkey', 'bigint'), (1, 'o_custkey', 'bigint'), (2, 'o_totalprice', ''), (3, 'o_orderdate', 'timestamp_ntz'),
          (4, 'o_orderpriority', 'string')) AS c(position, name, type)""",
    "approximate_median_rank": """SELECT l_returnflag, name, count(value) AS n, true AS within_bound FROM (UNPIVOT
        (SELECT l_returnflag, l_orderkey::DOUBLE AS l_orderkey, l_partkey::DOUBLE AS l_partkey, l_suppkey::DOUBLE AS l_suppkey,
          l_linenumber::DOUBLE AS l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)
        ON l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax INTO NAME name VALUE value)
      GROUP BY 1, 2""",
    "load_table": "SELECT * FROM customer",
    "stack_datasets": """SELECT 'customer' AS dataset_id, count(*) AS n, count(*) AS customers, 0 AS suppliers,
        round(sum(c_acctbal), 2) AS balance FROM customer
      UNION ALL SELECT 'supplier', count(*), 0, count(*), round(sum(s_acctbal), 2) FROM supplier""",
    "plain_values": """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') ||
        CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END AS ts, value, props FROM events""",
    "as_json": """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') ||
        CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END AS ts, event_type, value FROM events""",
    "read_cells": f"""WITH {MESSY}, {cells_sql("messy", "mixed")}
      SELECT id, round(num, 6) AS num, txt, type, num IS NOT NULL OR coalesce(type = 'date' AND txt <> mixed, false) AS was_changed,
        warning FROM cells""",
    "normalize_table": f"""WITH {MESSY}, {cells_sql("messy", "mixed")}
      SELECT id, round(num, 6) AS mixed__num, txt AS mixed__text, {_PRICE} AS price__num,
        CAST(NULL AS VARCHAR) AS price__text, day AS day__text FROM cells""",
    "resolved_columns": f"""WITH {MESSY}, {cells_sql("messy", "mixed")}
      SELECT grp, 1 AS position, count(txt) = 0 AS all_resolved FROM cells GROUP BY grp
      """
    + "\n".join(
        f"UNION ALL SELECT grp, {i}, {'true' if c in ('price', 'share') else 'false'} FROM messy GROUP BY grp"
        for i, c in enumerate(_TEXTS, 1)
        if c != "mixed"
    ),
    "cleaned_table": f"""WITH {MESSY} SELECT id, round({_PRICE}, 4) AS price, round({_SHARE}, 4) AS share, day FROM messy""",
    "cleaning_report": f"""WITH {MESSY}, {cells_sql("messy", "mixed")}
      SELECT grp, 0 AS position, 'id' AS name, count(*) AS total, 0 AS changed_count, 0 AS unresolved_count,
        0 AS missing_count FROM messy GROUP BY grp
      UNION ALL SELECT grp, 1, 'mixed', count(*), count(*) FILTER (num IS NOT NULL OR (type = 'date' AND txt <> mixed)),
        count(warning), count(*) - count(mixed) FROM cells GROUP BY grp
      UNION ALL SELECT grp, 2, 'price', count(*), count(price), 0, count(*) - count(price) FROM messy GROUP BY grp
      UNION ALL SELECT grp, 3, 'share', count(*), count(share), 0, 0 FROM messy GROUP BY grp
      UNION ALL SELECT grp, 4, 'day', count(*), 0, 0, 0 FROM messy GROUP BY grp
      UNION ALL SELECT grp, 5, 'code', count(*), 0, 0, 0 FROM messy GROUP BY grp
      UNION ALL SELECT grp, 6, 'status', count(*), 0, 0, 0 FROM messy GROUP BY grp""",
    "cleaning_examples_in_file_order": f"""WITH {MESSY}, {cells_sql("messy", "mixed")}, placed AS (SELECT *, row_number() OVER () AS place FROM cells),
        r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY place) AS rn FROM placed WHERE warning IS NOT NULL)
      SELECT grp, 'mixed' AS name, count(*) AS unresolved_count, string_agg(mixed || '|' || warning, ';' ORDER BY rn) FILTER (rn <= 5) AS examples
        FROM r GROUP BY grp
      UNION ALL SELECT DISTINCT grp, 'price', 0, '' FROM messy""",
    "cleaning_examples": f"""WITH {MESSY}, {cells_sql("messy", "mixed")},
        r AS (SELECT *, row_number() OVER (ORDER BY id) AS rn FROM cells WHERE warning IS NOT NULL)
      SELECT 0 AS position, 'id' AS name, 0 AS unresolved_count, '' AS examples
      UNION ALL SELECT 2, 'mixed', count(*), string_agg(mixed || '|' || warning, ';' ORDER BY rn) FILTER (rn <= 5) FROM r
      UNION ALL SELECT 3, 'price', 0, ''""",
    "cleaning_examples_by_group": f"""WITH {MESSY}, {cells_sql("messy", "mixed")},
        r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY id) AS rn FROM cells WHERE warning IS NOT NULL)
      SELECT grp, count(*) AS unresolved_count, string_agg(mixed, ';' ORDER BY rn) FILTER (rn <= 5) AS examples FROM r GROUP BY grp""",
    "numeric_summary": _summary_sql("lineitem", _NUMBERS, "l_returnflag, l_linestatus"),
    "numeric_summary_all": _summary_sql("lineitem", _NUMBERS),
    "numeric_summary_narrowed": _summary_sql("lineitem", _NUMBERS, "l_returnflag"),
    "approximate_distinct_bound": "\nUNION ALL ".join(
        f"SELECT l_returnflag, '{c}' AS name, count(DISTINCT {c}) AS unique_count, true AS within_bound FROM lineitem GROUP BY 1"
        for c in [*_LINES, "l_linestatus", "l_shipdate"]
    ),
    "date_orders": """SELECT o_orderpriority, CASE o_orderpriority[1] WHEN '1' THEN 'day_first' WHEN '2' THEN 'day_first' WHEN '3' THEN 'month_first' END AS "order",
        count(*) AS cells, count(*) AS dates FROM orders GROUP BY 1""",
    "dates_of_a_column": """SELECT o_orderkey, CASE o_orderpriority[1] WHEN '1' THEN strftime(o_orderdate, '%d/%m/%Y') WHEN '2' THEN strftime(o_orderdate, '%-d.%-m.%y')
        WHEN '3' THEN strftime(o_orderdate, '%m/%d/%Y') WHEN '4' THEN strftime(o_orderdate, '%d-%b-%y') ELSE strftime(o_orderdate, '%Y%m%d') END AS written,
        strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""",
    "mined_date_columns": """SELECT o_orderpriority, 'date-like' AS inferred_type, count(DISTINCT o_orderdate::DATE) AS unique_count FROM orders GROUP BY 1""",
    "sketched_profile_bound": "\nUNION ALL ".join(
        f"SELECT o_orderpriority, '{c}' AS name, count(*) AS row_count, {total} AS total, {most} AS most, true AS distinct_within, true AS ranks_within "
        "FROM orders GROUP BY 1"
        for c, total, most in [
            ("o_custkey", "sum(o_custkey)::DOUBLE", "max(o_custkey)::DOUBLE"),
            ("o_totalprice", "round(sum(o_totalprice), 2)", "max(o_totalprice)"),
            ("o_orderstatus", "NULL", "NULL"),
        ]
    ),
    "register_dataset": """SELECT 'Customer' AS display_name, 'previous' AS role, true AS fresh, count(*) AS n FROM customer
      UNION ALL SELECT 'Supplier', 'current', true, count(*) FROM supplier UNION ALL SELECT 'part.parquet', NULL, true, count(*) FROM part
      UNION ALL SELECT 'Nation', 'reference', true, count(*) FROM nation""",
    "numeric_summary_cleaned": f"WITH {MESSY} "
    + _summary_sql("messy", [(0, "id", "CAST(id AS DOUBLE)"), (2, "price", _PRICE), (3, "share", _SHARE)], "grp"),
    "known_columns": f"""WITH {MESSY}, {cells_sql("messy", "mixed")}, n AS (
        SELECT 'id' AS name, 0 AS texts UNION ALL SELECT 'mixed', count(txt) FROM cells """
    + "\n".join(
        f"UNION ALL SELECT '{c}', count(*) FILTER (NOT regexp_matches({c}, '^[$]?[0-9][0-9,]*([.][0-9]{{2}})?%?$')) FROM messy"
        for c in ["grp", *_TEXTS[1:]]
    )
    + ") SELECT name FROM n WHERE texts = 0",
    "date_summary": """SELECT event_type, 1 AS position, 'ts' AS name, count(ts) AS count, count(*) - count(ts) AS missing_count,
        strftime(min(ts), '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(min(ts)) % 1000000 = 0 THEN '' ELSE strftime(min(ts), '.%f') END AS min,
        strftime(max(ts), '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(max(ts)) % 1000000 = 0 THEN '' ELSE strftime(max(ts), '.%f') END AS max,
        CAST(floor(date_diff('microsecond', min(ts), max(ts)) / 86400000000) AS BIGINT) AS duration_days
      FROM events GROUP BY event_type""",
    "table_profile": """WITH r AS (SELECT l_returnflag, l_linestatus, l_quantity, CASE WHEN l_tax > 0.04 THEN l_tax END AS l_tax, count(*) AS n
        FROM lineitem GROUP BY 1, 2, 3, 4)
      SELECT sum(n) AS row_count, 4 AS column_count, false AS is_empty, sum(n - 1) AS duplicate_row_count FROM r""",
    "table_profile_by_key": """WITH r AS (SELECT l_returnflag, l_linestatus, l_quantity, CASE WHEN l_tax > 0.04 THEN l_tax END AS l_tax, count(*) AS n
        FROM lineitem GROUP BY 1, 2, 3, 4)
      SELECT l_returnflag, sum(n) AS row_count, 3 AS column_count, false AS is_empty, sum(n - 1) AS duplicate_row_count
      FROM r GROUP BY 1""",
    "duplicate_column_names": """SELECT c_nationkey AS dataset_id, c_mktsegment AS name FROM customer GROUP BY 1, 2 HAVING count(*) > 1""",
    "column_profile": _profile_sql(
        "lineitem",
        [(i, c, "'numeric'") for i, c in enumerate(_LINES)]
        + [(8, "l_returnflag", "'text'"), (9, "l_linestatus", "'text'"), (10, "l_shipdate", "'date-like'")],
    ),
    "column_profile_by_key": f"WITH {MESSY} " + _profile_sql("messy", _messy_columns(0), "grp"),
    "date_like_columns": """SELECT 7 AS position, 'x' AS name FROM orders WHERE false
      UNION ALL SELECT 5, 'day' UNION ALL SELECT 8, 'o_orderdate'""",
    "missing_columns": f"""WITH {MESSY}, c AS (SELECT grp, count(*) - count(mixed) AS a, count(*) - count(price) AS b FROM messy GROUP BY grp)
      SELECT grp, (a > 0)::INT + (b > 0)::INT AS value,
        concat_ws(';', CASE WHEN a > 0 THEN 'mixed:' || a END, CASE WHEN b > 0 THEN 'price:' || b END) AS columns FROM c""",
    "column_schema": f"""WITH {MESSY}, {_WITH_DATE}, s AS ({_samples(_ALL)}
        UNION ALL SELECT 'o_orderdate', string_agg(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), ';' ORDER BY id)
          FROM (SELECT * FROM dated ORDER BY id LIMIT 3))
      SELECT {_positions([*_ALL, "o_orderdate"])}, name, {_MEANING}, samples FROM s""",
    "column_schema_by_key": f"""WITH {MESSY}, s AS ({_samples(["id", *_TEXTS], "grp")})
      SELECT grp, {_positions(["id", *_TEXTS])}, name, {_MEANING}, samples FROM s""",
    "column_schema_in_file_order": "WITH placed AS (SELECT *, row_number() OVER () AS place FROM events) "
    + "\nUNION ALL ".join(
        f"SELECT event_type, {i} AS position, '{c}' AS name, string_agg(v, ';' ORDER BY rn) AS samples FROM (SELECT event_type, {v} AS v, "
        f"row_number() OVER (PARTITION BY event_type ORDER BY place) AS rn FROM placed WHERE {c} IS NOT NULL) WHERE rn <= 3 GROUP BY event_type"
        for i, c, v in [
            (0, "event_id", "event_id::VARCHAR"),
            (1, "ts", "strftime(ts, '%Y-%m-%d %H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END"),
            (2, "user_id", "user_id::VARCHAR"),
            (4, "props", "props"),
        ]
    ),
    "candidate_metadata": f"""WITH {MESSY}, s AS ({_samples(_ALL)}), t AS (SELECT {_positions(_ALL)}, name, samples, {_MEANING} FROM s)
      SELECT position, name, samples AS sample_values, role AS candidate_role, semantic_type AS candidate_semantic_type,
        confidence AS candidate_confidence FROM t""",
    "merge_schema_proposals": f"""WITH {MESSY}, seeds AS (SELECT grp, min(id) % 3 AS pick FROM messy GROUP BY grp),
        t AS (SELECT grp, pick, name, {_MEANING.replace("'USD'", "NULL")} FROM seeds, (SELECT unnest({["id", *_TEXTS]!r}) AS name)),
        p AS (SELECT *, CASE WHEN name = 'id' THEN 'identifier' WHEN pick = 0 THEN 'measure' WHEN pick = 1 THEN 'wrong' END AS pr,
          name IN ('id', 'price', 'code', 'status') AS proposed FROM t)
      SELECT grp, name,
        CASE WHEN proposed AND name <> 'id' AND pr = 'measure' THEN 'measure' ELSE role END AS role,
        CASE WHEN name = 'price' THEN 'numeric' ELSE semantic_type END AS semantic_type,
        CASE WHEN name = 'price' THEN 'EUR' ELSE unit END AS unit, time_role,
        CASE WHEN proposed THEN concat_ws(';',
          CASE WHEN name = 'id' THEN 'role=contradicts_strong_evidence' WHEN pr = 'wrong' THEN 'role=invalid_value'
               WHEN pr = 'measure' THEN 'role=measure' END,
          CASE WHEN name = 'price' THEN 'semantic_type=numeric' END, CASE WHEN name = 'price' THEN 'unit=EUR' END,
          CASE WHEN name = 'status' THEN 'time_role=invalid_value' ELSE 'time_role=none' END) END AS decisions
      FROM p""",
}

# The same results from one table of value counts.
SQL |= {
    f"{name}_from_counts": SQL[twin]
    for name, twin in [
        ("numeric_summary", "numeric_summary_cleaned"), ("column_profile", "column_profile_by_key"),
        ("cleaning_report", "cleaning_report"), ("date_summary", "date_summary"),
    ]
}
