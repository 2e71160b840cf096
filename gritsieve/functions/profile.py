"""Column kinds, roles and profiles; one job for all columns of a table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from gritsieve.functions.scalar import frac_year, parse_date
from gritsieve.plans.ledger import IDX
from gritsieve.plans.storage import materialize

#: Rows that are looked at before a column is read through.
PROBE = 1000
#: Columns in one aggregate, to stay clear of the limits of generated code.
CHUNK = 100
#: Bytes of dictionaries, one for each column, that every task may hold.
MOST_CODES = 64 << 20


@dataclass
class Roles:
    """Which columns count as text and which as numbers; ``dates`` are numbers by fractional year."""

    strings: list[str] = field(default_factory=list)
    numbers: list[str] = field(default_factory=list)
    dates: list[str] = field(default_factory=list)
    kinds: dict[str, str] = field(default_factory=dict)


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != IDX]


def kinds(df: DataFrame) -> dict[str, str]:
    """Of each column: int, float, date, str, or none (no role: booleans, binary, nested, all null).

    Decimals are floats.  Text is a date if all of its values are; a column of four-digit
    years in text is therefore one.
    """
    out: dict[str, str] = {}
    asked = []
    for f in df.schema.fields:
        t = f.dataType
        if f.name == IDX:
            continue
        if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            out[f.name] = "int"
        elif isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
            out[f.name] = "float"
        elif isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            out[f.name] = "date"
        elif isinstance(t, (T.StringType, T.VarcharType, T.CharType)):
            out[f.name] = "str"
        else:
            out[f.name] = "none"
        if out[f.name] != "none":
            asked.append(f.name)
    # one value settles that a column isn't empty, one text that it holds no dates: a few rows
    # settle most columns, and only the others are read through
    counts: dict[str, int] = {}
    bad: dict[str, int] = {}
    for rows in (df.limit(PROBE), df):
        open_ = [c for c in asked if not counts.get(c) or out[c] == "str" and not bad.get(c)]
        for k in range(0, len(open_), CHUNK):
            part = open_[k : k + CHUNK]
            no_date = lambda c: F.count_if(F.col(f"`{c}`").isNotNull() & parse_date(F.col(f"`{c}`")).isNull()) if out[c] == "str" else F.lit(0)
            row = rows.agg(*(x for i, c in enumerate(part) for x in (F.count(F.col(f"`{c}`")).alias(f"n{i}"), no_date(c).alias(f"d{i}")))).first()
            counts |= {c: row[f"n{i}"] for i, c in enumerate(part)}
            bad |= {c: row[f"d{i}"] for i, c in enumerate(part)}
    for c in asked:
        if out[c] == "str" and counts[c] and not bad[c]:
            out[c] = "date"
    return {c: "none" if counts.get(c, 1) == 0 else kind for c, kind in out.items()}


def roles(df: DataFrame) -> Roles:
    k = kinds(df)
    of = lambda *which: [c for c in data_columns(df) if k[c] in which]
    return Roles(of("str"), of("int", "float", "date"), of("date"), k)


def kinds_table(df: DataFrame) -> DataFrame:
    k = kinds(df)
    return df.sparkSession.createDataFrame([(c, k[c]) for c in data_columns(df)], "column string, kind string")


def numeric_view(df: DataFrame, r: Roles, columns: list[str] | None = None) -> DataFrame:
    """The row id and the number columns as doubles, dates as fractional years."""
    out = []
    for c in r.numbers if columns is None else columns:
        x = F.col(c)
        if c in r.dates:
            x = frac_year(parse_date(x) if isinstance(df.schema[c].dataType, T.StringType) else x)
        out.append(x.cast("double").alias(c))
    return df.select(IDX, *out)


def converted(df: DataFrame, r: Roles) -> DataFrame:
    """``df`` with its date columns as fractional years."""
    view = {c: frac_year(parse_date(F.col(c)) if isinstance(df.schema[c].dataType, T.StringType) else F.col(c)) for c in r.dates}
    return df.withColumns(view) if view else df


def uniqueness(df: DataFrame, columns: list[str], approximate: bool = False) -> dict[str, float]:
    """Distinct values over non-null ones of each column, 0 where there are none.

    ``approximate`` counts by HyperLogLog, for tables where exact counts cost too much.
    """
    out: dict[str, float] = {}
    distinct = (lambda c: F.approx_count_distinct(c, 0.01)) if approximate else (lambda c: F.count_distinct(F.col(c)))
    for k in range(0, len(columns), CHUNK):
        part = columns[k : k + CHUNK]
        row = df.agg(*(e for i, c in enumerate(part) for e in (distinct(c).alias(f"d{i}"), F.count(c).alias(f"n{i}")))).first()
        out |= {c: row[f"d{i}"] / row[f"n{i}"] if row[f"n{i}"] else 0.0 for i, c in enumerate(part)}
    return out


def uniqueness_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, uniqueness)`` in one plan: values are counted once for each column, then per column."""
    rows = df.select(*(F.col(c).cast("string").alias(c) for c in columns)).unpivot([], columns, "column", "value").filter("value is not null")
    counted = rows.groupBy("column", "value").agg(F.count("*").alias("n")).groupBy("column").agg(F.count("*").alias("d"), F.sum("n").alias("n"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return names.join(F.broadcast(counted), "column", "left").select("column", F.coalesce(F.col("d") / F.col("n"), F.lit(0.0)).alias("uniqueness"))


def null_fractions(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    row = df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(f"f{i}") for i, c in enumerate(columns))).first() if columns else []
    return {c: row[i] for i, c in enumerate(columns)}


def null_fraction_table(df: DataFrame, columns: list[str]) -> DataFrame:
    one = df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns))
    return one.unpivot([], columns, "column", "null_fraction")


def numbered(df: DataFrame, order: Column) -> DataFrame:
    """``df`` with ``id``, 0, 1, ... in an order that no two rows share, without sorting it in one task."""
    rows = materialize(df.orderBy(order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    first = rows.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))  # a row for each partition
    first = first.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(F.broadcast(first), "_part").select(*df.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias("id"))


def label_codes(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(value, code)``: one dictionary of all values of the columns, in sorted order; null is the last."""
    values = df.select(*(F.col(c).cast("string").alias(c) for c in columns)).unpivot([], columns, "column", "value").select("value").distinct()
    return numbered(values, F.col("value").asc_nulls_last()).select("value", F.col("id").alias("code"))


def string_correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column1, column2, corr)`` of the coded columns, each pair once in either order.

    Rows are coded and summed in one pass where the dictionary is small enough to be sent to
    all tasks; else equal rows are counted first and joined with it column by column.
    """
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "column1 string, column2 string, corr double")
    codes = materialize(label_codes(df, columns))
    held = codes.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("value"), F.lit(0)) + 64), F.lit(0))).first()[0] * len(columns)
    coded = df.select(*(F.col(c).cast("string").alias(c) for c in columns))
    small = held <= MOST_CODES
    grouped = coded.withColumn("count", F.lit(1)) if small else coded.groupBy(*columns).count()
    for i, c in enumerate(columns):
        d = codes.select(F.col("value").alias(f"_v{i}"), F.col("code").alias(f"_c{i}"))
        grouped = grouped.join(F.broadcast(d) if small else d, grouped[c].eqNullSafe(d[f"_v{i}"]), "left").drop(c, f"_v{i}")
    w = F.col("count").cast("double")
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    x = lambda i: F.col(f"_c{i}").cast("double")
    sums = [F.sum(w).alias("n")] + [F.sum(w * x(i)).alias(f"s{i}") for i in range(len(columns))] + [F.sum(w * x(i) * x(i)).alias(f"q{i}") for i in range(len(columns))] + [F.sum(w * x(i) * x(j)).alias(f"p{i}_{j}") for i, j in pairs]
    total = grouped.agg(*sums)
    n = F.col("n")
    cov = lambda i, j: n * F.col(f"p{i}_{j}") - F.col(f"s{i}") * F.col(f"s{j}")
    var = lambda i: n * F.col(f"q{i}") - F.col(f"s{i}") * F.col(f"s{i}")
    rows = [F.struct(F.lit(columns[a]).alias("column1"), F.lit(columns[b]).alias("column2"), F.try_divide(cov(i, j), F.sqrt(var(i) * var(j))).alias("corr")) for i, j in pairs for a, b in ((i, j), (j, i))]
    return total.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
