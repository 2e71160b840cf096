"""Loading of tables: CSV, JSON, SQL, Excel and Parquet; export of ledgers."""

from __future__ import annotations

import io
import json
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from gritsieve.functions.scalar import null_if_nan
from gritsieve.plans.ledger import IDX, report

KINDS = ("csv", "json", "sql", "xlsx", "parquet")
#: Texts that count as missing in a CSV file, as readers of data frames take them.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
#: Largest workbook that is read on the driver, in bytes; Excel itself stops at a million rows.
MOST_WORKBOOK = 1 << 28


def check_extension(path: str) -> str:
    """``csv``, ``json``, ``sql``, ``xlsx``, ``parquet`` or ``none``, by suffix in either case."""
    m = re.search(r"\.([A-Za-z]+)/?$", path)
    kind = m[1].lower() if m else ""
    return kind if kind in KINDS else "none"


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """The table at ``path`` as its reader gives it; options go to the reader."""
    kind = check_extension(path)
    if kind == "none":
        raise TypeError(f"{path}: the suffix must be one of {', '.join(KINDS)}")
    return {"csv": _csv, "json": _json, "sql": _sql, "xlsx": _xlsx, "parquet": lambda s, p, **o: s.read.options(**o).parquet(p)}[kind](spark, path, **options)


def _csv(spark: SparkSession, path: str, **options) -> DataFrame:
    schema = options.pop("schema", None)
    given = {"header": True, "escape": '"', "nullValue": "NA"} | options
    if not any(k.lower() == "multiline" for k in options):
        given["multiLine"] = _broken_lines(spark, path)
    reader = spark.read.options(**given)
    if schema is not None:
        return reader.schema(schema).csv(path)
    # all as text first, for readers know one text for missing only; then narrowed column by column
    raw = reader.option("inferSchema", False).csv(path)
    raw = raw.select(*(F.when(~F.trim(F.col(f"`{c}`")).isin(*MISSING), F.col(f"`{c}`")).alias(c) for c in raw.columns))
    return narrowed(raw)


def _broken_lines(spark: SparkSession, path: str) -> bool:
    """Whether a line has an odd number of quotes, so that a value may go on in the next; without one, large files can be split."""
    return bool(spark.read.text(path).filter((F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1).take(1))


def narrowed(raw: DataFrame) -> DataFrame:
    """Text columns as long or double where all values can be; one job for all columns."""
    columns = [f.name for f in raw.schema.fields if isinstance(f.dataType, T.StringType)]
    if not columns:
        return raw
    bad = lambda c, kind: F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(kind).isNull())
    broken = lambda c: F.count_if(F.col(f"`{c}`").rlike(r"[^0-9+\-\s]"))
    row = raw.agg(*(x for k, c in enumerate(columns) for x in (bad(c, "long").alias(f"l{k}"), broken(c).alias(f"b{k}"), bad(c, "double").alias(f"d{k}"), F.count(f"`{c}`").alias(f"n{k}")))).first()
    out = {}
    for k, c in enumerate(columns):
        if row[f"n{k}"] and not row[f"l{k}"] and not row[f"b{k}"]:
            out[c] = F.col(f"`{c}`").cast("long")
        elif row[f"n{k}"] and not row[f"d{k}"]:
            out[c] = F.col(f"`{c}`").cast("double")
    return raw.withColumns(out) if out else raw


#: Options that say which files of a path are read.
_LISTING = ("basepath", "pathglobfilter", "recursivefilelookup", "modifiedbefore", "modifiedafter")


def _whole_files(spark: SparkSession, path: str, options: dict) -> tuple[list[str], list[str]]:
    """The JSON files that hold one value over several lines, and the others, whose lines are values.

    A value over several lines has a first line that is none.  So has a file of lines whose
    first is broken, but that one as a whole is broken too.
    """
    listing = {k: v for k, v in options.items() if k.lower() in _LISTING}
    name = lambda: F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("file")
    order = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    lines = spark.read.options(**listing).text(path).select(name(), F.get_json_object("value", "$").isNotNull().alias("whole"), order.alias("order"), F.trim("value").alias("text"))
    first = lines.filter("text != ''").groupBy("file").agg(F.min_by("whole", "order").alias("whole")).collect()  # a row for each file
    several, by_line = [r.file for r in first if not r.whole], [r.file for r in first if r.whole]
    if several:
        given = options | {"multiLine": True, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
        rows = spark.read.options(**given).schema("_broken string, _any string").json(several)
        counts = rows.groupBy(name()).agg(F.count("_broken").alias("n"), F.count("_any"))  # Spark reads no broken records alone
        broken = {r.file for r in counts.collect() if r.n}
        several, by_line = [x for x in several if x not in broken], by_line + sorted(broken)
    return several, by_line


def _json(spark: SparkSession, path: str, **options) -> DataFrame:
    """Records, one to a line or in an array, decided file by file; or columns, ``{column: {label: value}}``."""
    if any(k.lower() == "multiline" for k in options):
        got = spark.read.options(**options).json(path)
    else:
        several, by_line = _whole_files(spark, path, options)
        if several and by_line:
            given = ({} if re.search(r"[*?{\[]", path) else {"basePath": path}) | options
            got = spark.read.options(**given, multiLine=True).json(several).unionByName(spark.read.options(**given).json(by_line), allowMissingColumns=True)
        else:
            got = spark.read.options(**options, multiLine=not by_line).json(path)
    structs = [f for f in got.schema.fields if isinstance(f.dataType, T.StructType)]
    if structs and len(structs) == len(got.schema.fields) and len({tuple(f.dataType.names) for f in structs}) == 1 and len(got.head(2)) == 1:
        size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]
        if size > MOST_WORKBOOK:
            raise ValueError(f"{path}: a table by columns of {size} bytes")
        text = "".join(r.value for r in spark.read.option("wholetext", True).text(path).collect())
        data = json.loads(text)  # a table of one line by columns is a driver-side file
        labels = list(next(iter(data.values()), {}))
        kinds = {f.name: f.dataType.fields[0].dataType if len({x.dataType.typeName() for x in f.dataType.fields}) == 1 else T.DoubleType() for f in structs}
        schema = T.StructType([T.StructField(c, kinds[c]) for c in data])
        cast = lambda c, v: float(v) if v is not None and isinstance(kinds[c], T.DoubleType) else v
        return spark.createDataFrame([tuple(cast(c, data[c][x]) for c in data) for x in labels], schema)
    return got


def _sql(spark: SparkSession, path: str, **options) -> DataFrame:
    """The result of the query in the file: by JDBC where a ``url`` is given, else by this session."""
    query = "\n".join(r.value for r in spark.read.option("wholetext", True).text(path).collect()).strip().rstrip(";")
    return spark.read.format("jdbc").options(query=query, **options).load() if "url" in options else spark.sql(query)


def _xlsx(spark: SparkSession, path: str, sheet: int = 0, **_: object) -> DataFrame:
    """A sheet of a workbook, first row as names; read with the standard library."""
    found = spark.read.format("binaryFile").load(path).select("length", "content").first()
    if found.length > MOST_WORKBOOK:
        raise ValueError(f"{path}: a workbook of {found.length} bytes")
    rows = sheet_rows(bytes(found.content), sheet)
    if not rows:
        raise ValueError(f"{path}: the sheet is empty")
    names, body = [str(x) for x in rows[0]], rows[1:]
    body = [[*r, *[None] * (len(names) - len(r))][: len(names)] for r in body]
    fields = []
    for k, name in enumerate(names):
        values = [r[k] for r in body if r[k] is not None]
        if values and all(isinstance(v, bool) for v in values):
            kind: T.DataType = T.BooleanType()
        elif values and all(isinstance(v, float) for v in values):
            kind = T.LongType() if all(v.is_integer() for v in values) and len(values) == len(body) else T.DoubleType()
        else:
            kind = T.StringType()
        cast = {T.LongType: int, T.DoubleType: float, T.StringType: lambda v: str(int(v)) if isinstance(v, float) and v.is_integer() else str(v), T.BooleanType: bool}[type(kind)]
        for r in body:
            r[k] = None if r[k] is None else cast(r[k])
        fields.append(T.StructField(name, kind))
    return spark.createDataFrame([tuple(r) for r in body], T.StructType(fields))


def sheet_rows(data: bytes, sheet: int = 0) -> list[list]:
    """Cells of a sheet: floats, booleans, texts or None."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        texts = []
        if "xl/sharedStrings.xml" in names:
            texts = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        sheets = sorted((x for x in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", x)), key=lambda x: int(re.search(r"\d+", x)[0]))
        root = ElementTree.fromstring(z.read(sheets[sheet]))
    out = []
    for row in root.iter(f"{{{ns['m']}}}row"):
        cells: list = []
        for c in row.findall("m:c", ns):
            letters = re.match(r"[A-Z]+", c.get("r", "")) if c.get("r") else None
            at = len(cells)
            if letters:
                at = 0
                for ch in letters[0]:
                    at = at * 26 + ord(ch) - 64
                at -= 1
            cells += [None] * (at + 1 - len(cells))
            v, kind = c.find("m:v", ns), c.get("t")
            if kind == "inlineStr":
                cells[at] = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t"))
            elif v is None or v.text is None:
                cells[at] = None
            elif kind == "s":
                cells[at] = texts[int(v.text)]
            elif kind == "b":
                cells[at] = v.text == "1"
            elif kind in ("str", "e"):
                cells[at] = v.text
            else:
                cells[at] = float(v.text)
            if cells[at] in MISSING:
                cells[at] = None
        out.append(cells)
    return out


def workbook(names: list[str], rows: list[tuple]) -> bytes:
    """A workbook of one sheet; the counterpart of :func:`sheet_rows` for numbers and texts."""
    cell = lambda v: "<c/>" if v is None else f'<c t="inlineStr"><is><t>{escape(v)}</t></is></c>' if isinstance(v, str) else f"<c><v>{v}</v></c>"
    body = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in [tuple(names), *rows])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def with_index(df: DataFrame, index_col: str | None = None) -> DataFrame:
    """``df`` with the row id ``_idx``: the given column, or 0, 1, ... in reading order.

    Positions need no shuffle: rows are numbered in their partitions, and a table with a row
    for each partition says how many rows stand before it.
    """
    if index_col is not None:
        return df.withColumn(IDX, F.col(index_col).cast("long"))
    numbered = df.withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33)
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = numbered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", before.alias("start"))
    joined = numbered.join(F.broadcast(starts), part == F.col("part"))  # one row for each partition
    return joined.withColumn(IDX, F.col("start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "part", "start")


def canonical(df: DataFrame) -> DataFrame:
    """NaN as null, and no negative zeros."""
    out = {f.name: null_if_nan(F.col(f"`{f.name}`")) + F.lit(0.0).cast(f.dataType) for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.withColumns(out) if out else df


def prepare(df: DataFrame, drop_first_col: bool = True, index_col: str | None = None) -> DataFrame:
    out = with_index(df, index_col)
    return canonical(out.drop(df.columns[0]) if drop_first_col else out)


def save(ledger: DataFrame, path: str, index: bool = True, format: str = "csv", single_file: bool = True) -> None:
    """Writes the report; ``index`` adds a row number, as exports of data frames have it."""
    out = report(ledger)
    if index:
        out = out.select(F.monotonically_increasing_id().alias("row"), "*") if not single_file else out.coalesce(1).select(F.monotonically_increasing_id().alias("row"), "*")
    elif single_file:
        out = out.coalesce(1)
    writer = out.write.mode("overwrite")
    writer.option("header", True).option("escape", '"').csv(path) if format == "csv" else writer.format(format).save(path)
