"""The order in which rows stand in the files of a table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps of a plan that leave the rows of a task in the order of the scan.
KEEPS_ORDER = {"Project", "Filter", "SubqueryAlias", "View", "LogicalRelation"}
IN_TASK = (1 << 33) - 1  # the part of the running number that counts within a task


def scan_order(df: DataFrame) -> list[Column]:
    """What to sort by for the order of the files and of the rows in them; [] where nothing tells it.

    Files follow each other by their paths.  Parquet knows the number of each row, whatever
    happens to it later.  Elsewhere the start of the row's block and a running number within
    the task order the rows; that holds as long as they stay where they were read, so such a
    table has no order after a shuffle.  Nothing is computed unless the order is used, and no
    column is added to the table.
    """
    try:
        about = df.metadataColumn("_metadata")
        fields = df.select(about.alias("about")).schema["about"].dataType.names
    except AnalysisException:
        return []
    file = about["file_path"]
    if "row_index" in fields:
        return [file, about["row_index"]]
    if not _as_scanned(df._jdf.queryExecution().analyzed()):
        return []
    return [file, about["file_block_start"], F.monotonically_increasing_id().bitwiseAND(F.lit(IN_TASK))]


def _as_scanned(plan) -> bool:
    children = plan.children()
    return plan.nodeName() in KEEPS_ORDER and all(_as_scanned(children.apply(i)) for i in range(children.size()))
