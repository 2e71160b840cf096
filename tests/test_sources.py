import json
import zipfile

import pytest

from gritsieve.plans.engine import DataQuality
from gritsieve.plans.ledger import IDX
from gritsieve.sources import tables


@pytest.mark.parametrize(("path", "kind"), [("x.CSV", "csv"), ("x.json", "json"), ("x.sql", "sql"), ("x.xlsx", "xlsx"), ("x.csv.gz", "none"), ("x", "none"), ("d/x.parquet", "parquet")])
def test_extension(path, kind):
    assert tables.check_extension(path) == kind


def test_unknown_extension(spark):
    with pytest.raises(TypeError):
        DataQuality.load(spark, "x.csv.gz")


def test_csv_types_and_missing_values(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,a,b,c\n1,1,x,2.5\n2,NA,"y, z",n/a\n3,3,,4\n')
    df = tables.read(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes) == {"id": "bigint", "a": "bigint", "b": "string", "c": "double"}
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, 1, "x", 2.5), (2, None, "y, z", None), (3, 3, None, 4.0)]


def test_json_shapes(spark, tmp_path):
    rows = [{"a": 1, "b": "x"}, {"a": 2, "b": None}]
    (tmp_path / "r.json").write_text(json.dumps(rows))
    (tmp_path / "l.json").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "c.json").write_text(json.dumps({"a": {"0": 1, "1": 2}, "b": {"0": "x", "1": None}}))
    for name in "rlc":
        assert sorted((r.a, r.b) for r in tables.read(spark, str(tmp_path / f"{name}.json")).collect()) == [(1, "x"), (2, None)], name


def test_json_in_several_files(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 7 as v").repartition(4).write.json(str(tmp_path / "parts.json"))
    assert sorted((r.id, r.v) for r in tables.read(spark, str(tmp_path / "parts.json")).collect()) == [(i, i % 7) for i in range(100)]
    assert DataQuality.load(spark, str(tmp_path / "parts.json")).data.count() == 100
    mixed = tmp_path / "a +%20 b" / "mixed.json"
    mixed.mkdir(parents=True)
    (mixed / "lines.json").write_text('\n{"id": 1}\n{"id": 2}\n')
    (mixed / "array.json").write_text('[\n{"id": 3},\n{"id": 4}\n]\n')
    (mixed / "record.json").write_text(json.dumps({"id": 5, "more": "x"}, indent=1))
    (mixed / "one line.json").write_text('[{"id": 6}, {"id": 7}]')
    (mixed / "broken.json").write_text('{"id": \n{"id": 8}\n{"id": 9}\n')
    got = tables.read(spark, str(mixed)).collect()
    assert sorted(r.id for r in got if r.id) == list(range(1, 10)) and len(got) == 10 and [r.id for r in got if r.more] == [5]
    (tmp_path / "nested.json").write_text('{"a": {"x": 1}, "b": {"x": 2}}\n{"a": {"x": 3}, "b": {"x": 4}}\n')
    assert sorted((r.a.x, r.b.x) for r in tables.read(spark, str(tmp_path / "nested.json")).collect()) == [(1, 2), (3, 4)]


def test_sql_file(spark, tmp_path):
    (tmp_path / "q.sql").write_text("select 1 as a,\n 'x' as b;\n")
    assert [tuple(r) for r in tables.read(spark, str(tmp_path / "q.sql")).collect()] == [(1, "x")]


def workbook(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>id</t></si><si><t>name</t></si><si><t>bolt</t></si></sst>')
        z.writestr(
            "xl/worksheets/sheet1.xml",
            '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
            '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="inlineStr"><is><t>w</t></is></c></row>'
            '<row r="2"><c r="A2"><v>1</v></c><c r="B2" t="s"><v>2</v></c><c r="C2"><v>1.5</v></c></row><row r="3"><c r="A3"><v>2</v></c><c r="C3"><v>2</v></c></row></sheetData></worksheet>',
        )


def test_workbook(spark, tmp_path):
    workbook(tmp_path / "t.xlsx")
    assert [tuple(r) for r in tables.read(spark, str(tmp_path / "t.xlsx")).collect()] == [(1, "bolt", 1.5), (2, None, 2.0)]


def test_positions_follow_the_file(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,v\n" + "\n".join(f"{i},{i * 2}" for i in range(100)))
    q = DataQuality.load(spark, str(tmp_path / "t.csv"))
    assert q.data.columns == ["v", IDX] and [(r.v, r[IDX]) for r in q.data.orderBy("v").collect()] == [(2 * i, i) for i in range(100)]
    df = tables.with_index(spark.range(0, 1000, 1, 7))
    assert [r[IDX] for r in df.orderBy("id").collect()] == list(range(1000))


def test_report_is_saved(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,v\n" + "\n".join(f"{i},{5 if i % 2 else 6}" for i in range(50)) + "\n50,1000\n")
    q = DataQuality.load(spark, str(tmp_path / "t.csv"), drop_first_col=False)
    q.check_extreme_value(thresh_unique1=0.9)
    q.save_result(str(tmp_path / "out.csv"), index=False)
    got = tables.read(spark, str(tmp_path / "out.csv")).collect()
    assert [(r.idx, r.column, r.errtype, r.value1) for r in got] == [(50, "v", "extreme", 1000.0)]
