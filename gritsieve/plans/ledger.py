"""The ledger of findings: one row for each, in one fixed shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IDX = "_idx"
SCHEMA = "idx long, check string, errtype string, column string, column2 string, value1 string, value2 string, num1 double, num2 double"


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def finding(rows: DataFrame, check: str, errtype: str, column: Column, column2: Column | None = None, value1: Column | None = None, value2: Column | None = None, num1: Column | None = None, num2: Column | None = None) -> DataFrame:
    """Ledger rows of ``rows``, which has the row id in ``_idx``.

    Values are given as text for display and, where they are numbers, as doubles too.
    """
    text = lambda c: F.lit("") if c is None else c.cast("string")
    number = lambda c: F.lit(None).cast("double") if c is None else c.cast("double")
    return rows.select(
        F.col(IDX).cast("long").alias("idx"), F.lit(check).alias("check"), F.lit(errtype).alias("errtype"), column.alias("column"),
        (F.lit(None).cast("string") if column2 is None else column2).alias("column2"), text(value1).alias("value1"), text(value2).alias("value2"), number(num1).alias("num1"), number(num2).alias("num2"),
    )


def report(ledger: DataFrame) -> DataFrame:
    """The five columns of the export; a pair of columns is shown as ``a,b``."""
    return ledger.select("idx", F.concat_ws(",", "column", "column2").alias("column"), "errtype", "value1", "value2")
