"""Readers and writers on small files made here."""

import json
import struct
import zipfile

import numpy as np
import pytest

from gridweave import constants as C
from gridweave.sources import formats, sinks


def living_csv(days):
    head = ",".join(f"h{i}" for i in range(33))
    rows = [f'{d},"{h}",11110515 , c{h},{t},' + ",".join(["*", "4", ""] + ["1"] * 25) + ",,,," for d, h, t in days]
    return ("\r\n".join([head, *rows]) + "\r\n").encode("cp949")


def test_zip_csv(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x_20250101.csv", living_csv([("20250101", 0, "12.5"), ("20250101", 7, "*")]))
        z.writestr("x_20250102.csv", living_csv([("20250102", 23, " 4 ")]))
        z.writestr("readme.txt", b"nothing")
    rows = formats.read_living(spark, str(tmp_path / "a.zip")).orderBy("date", "hour").collect()
    assert [(str(r.date), r.hour, r.grid_id, r.total_pop) for r in rows] == [("2025-01-01", 0, "c0", 12.5), ("2025-01-01", 7, "c7", None), ("2025-01-02", 23, "c23", 4.0)]
    assert (rows[0].M_0_9, rows[0].M_10_14, rows[0].M_15_19, rows[0].F_70_over) == (None, 4.0, None, 1.0)
    assert len(rows[0]) == 5 + 28


def test_a_count_that_is_no_number_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(living_csv([("20250101", 0, "many")]))
    with pytest.raises(Exception, match="many|CAST"):
        formats.read_living(spark, str(tmp_path / "a.csv")).collect()


def test_bus(spark, tmp_path):
    row = ["202501", "100", "100번", "s1", "01", "정류장", *(str(i) for i in range(48)), "1", "bus", "x"]
    (tmp_path / "b.csv").write_bytes(("head\n" + ",".join(f'"{v}"' for v in row) + "\n").encode("cp949"))
    got = formats.read_bus(spark, str(tmp_path / "b.csv")).orderBy("hour").collect()
    assert [(r.hour, r.board, r.alight) for r in got] == [(h, 2.0 * h, 2.0 * h + 1) for h in range(24)]
    assert got[0].route_name == "100번"
    (tmp_path / "c.csv").write_bytes(("head\n" + ",".join(row[:-1]) + "\n").encode("cp949"))
    with pytest.raises(Exception, match="56 columns"):
        formats.read_bus(spark, str(tmp_path / "c.csv")).collect()


def test_named_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_bytes("이름,위도,x\n 강남 ,37.5,1\n,36,2\n".encode("cp949"))
    got = formats.read_named_csv(spark, str(tmp_path / "m.csv"), {"이름": "name", "위도": "lat"}).collect()
    assert [tuple(r) for r in got] == [("강남", "37.5"), (None, "36")]


def test_shapefile(spark, tmp_path):
    rings = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)], [(1.0, 1.0), (2.0, 1.0), (1.0, 1.0)]]
    points = [p for r in rings for p in r]
    body = struct.pack("<i4d", 5, 0, 0, 4, 4) + struct.pack("<ii2i", 2, len(points), 0, 4) + b"".join(struct.pack("<dd", *p) for p in points)
    null = struct.pack("<i", 0)
    (tmp_path / "z.shp").write_bytes(bytes(100) + b"".join(struct.pack(">ii", i + 1, len(b) // 2) + b for i, b in enumerate((body, null))))
    fields = b"CODE\0\0\0\0\0\0\0C" + bytes(4) + bytes([6]) + bytes(15) + b"LABEL\0\0\0\0\0\0C" + bytes(4) + bytes([8]) + bytes(15)
    records = b"".join(b" " + a.encode("cp949").ljust(6) + b.encode("cp949").ljust(8) for a, b in (("ZON510", "도심"), ("ZON520", "x")))
    (tmp_path / "z.dbf").write_bytes(struct.pack("<4BIHH", 3, 0, 0, 0, 2, 32 + 64 + 1, 15) + bytes(20) + fields + b"\r" + records)
    got = formats.read_shapefile(spark, str(tmp_path / "z"), ["CODE", "LABEL"]).orderBy("ord").collect()
    assert [(r.ord, r.CODE, r.LABEL) for r in got] == [(0, "ZON510", "도심"), (1, "ZON520", "x")]
    assert [[(p.x, p.y) for p in ring] for ring in got[0].rings] == rings and got[1].rings == []


def test_sheet(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>head</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>7</v></c></row><row><c r="A3" t="inlineStr"><is><t>c</t></is></c></row></sheetData></worksheet>')
    got = formats.read_sheet(spark, str(tmp_path / "s.xlsx"), ["p", "q", "r"], "r").collect()
    assert [tuple(x) for x in got] == [("ab", None, "7")]


def test_paged_service(spark, tmp_path):
    rows = [{"USE_MM": "202501", "SBWY_ROUT_LN_NM": " 2호선 ", "STTN": f"s{i % 5}", "HR_4_GET_ON_NOPE": str(i % 5), "HR_4_GET_OFF_NOPE": "1", "HR_0_GET_ON_NOPE": "2", "HR_0_GET_OFF_NOPE": None} for i in range(7)]
    for first, last in ((1, 4), (5, 7)):
        (tmp_path / f"202501_{first}_{last}.json").write_text(json.dumps({"CardSubwayTime": {"list_total_count": 7, "RESULT": {"CODE": "INFO-000"}, "row": rows[first - 1 : last]}}))
    got = formats.read_subway(spark, url=f"{tmp_path}/{{month}}_{{start}}_{{end}}.json", months="202501", page="4", pause="0").where("hour in (0, 4)").orderBy("station_name", "hour").collect()
    assert [(r.line, r.station_name, r.hour, r.board, r.alight) for r in got] == [x for i in range(5) for x in (("2호선", f"s{i}", 0, 2.0, None), ("2호선", f"s{i}", 4, float(i), 1.0))]
    (tmp_path / "202502_1_4.json").write_text(json.dumps({"CardSubwayTime": {"RESULT": {"CODE": "ERROR-300"}}}))
    with pytest.raises(Exception, match="ERROR-300"):
        formats.read_subway(spark, url=f"{tmp_path}/{{month}}_{{start}}_{{end}}.json", months="202502", page="4", pause="0", retries="2").collect()


def test_tensors_and_csv(spark, tmp_path):
    a, b = np.arange(6.0).reshape(2, 3), np.array([1, 2], np.int16)
    np.savez(tmp_path / "z.npz", one=a, two=b)
    np.save(tmp_path / "y.npy", b)
    got = {r.name: (r.shape, r["values"]) for r in formats.read_tensors(spark, f"{tmp_path}/*.np*").collect()}
    assert got == {"one": ([2, 3], list(range(6))), "two": ([2], [1.0, 2.0]), "y": ([2], [1.0, 2.0])}
    (tmp_path / "t.csv").write_text('a,b\n1,"x, y"\n2,\n')
    assert [tuple(r) for r in formats.read_csv(spark, str(tmp_path / "t.csv"), "a int, b string").collect()] == [(1, "x, y"), (2, None)]


def test_a_short_month_is_an_error(spark, tmp_path):
    for first, last, rows in ((1, 4, [{"USE_MM": "202501", "STTN": str(i)} for i in range(4)]), (5, 7, [])):
        (tmp_path / f"202501_{first}_{last}.json").write_text(json.dumps({"CardSubwayTime": {"list_total_count": 7, "row": rows}}))
    with pytest.raises(Exception, match="3 of 7 rows of 202501 are missing"):
        formats.read_subway(spark, url=f"{tmp_path}/{{month}}_{{start}}_{{end}}.json", months="202501", page="4", pause="0").collect()


def test_days_are_accounted(spark, tmp_path):
    at = str(tmp_path / "d")
    day = lambda rows: spark.createDataFrame(rows, "date string, v int").selectExpr("cast(date as date) as date", "v")
    account = lambda df: sorted((r.date, r.rows, r.written) for r in df.collect())
    assert account(sinks.write_days(day([("2025-01-01", 1), ("2025-01-01", 2)]), at)) == [("2025-01-01", 2, True)]
    assert account(sinks.write_days(day([("2025-01-01", 9), ("2025-01-02", 3)]), at)) == [("2025-01-01", 2, False), ("2025-01-02", 1, True)]
    assert account(sinks.write_days(day([]), str(tmp_path / "none"))) == []


def test_key(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("OTHER=1\nA_KEY = 'abc'\n")
    monkeypatch.delenv("A_KEY", raising=False)
    assert formats.service_key("A_KEY", str(tmp_path / ".env")) == "abc"
    monkeypatch.setenv("A_KEY", " env ")
    assert formats.service_key("A_KEY") == "env"


def test_months_are_written_once(spark, tmp_path):
    df = spark.createDataFrame([("202501", 1), ("202502", 2)], "year_month string, v int")
    at = str(tmp_path / "t")
    assert sinks.write_months(df, at) == ["202501", "202502"]
    more = spark.createDataFrame([("202502", 9), ("202503", 3)], "year_month string, v int")
    assert sinks.write_months(more, at) == ["202503"]
    assert sorted(r.v for r in spark.read.parquet(at).collect()) == [1, 2, 3]
    assert sinks.write_months(more, at, force=True) == ["202502", "202503"]
    assert sorted(r.v for r in spark.read.parquet(at).collect()) == [1, 3, 9]


def test_texts(spark, tmp_path):
    assert [sinks.tex_cell(v) for v in (7, 20500, -1234567, None, "a_b & 5%", 0.5)] == ["7", "20{,}500", "-1{,}234{,}567", "", r"a\_b \& 5\%", "0.5"]
    small = spark.createDataFrame([("x_1", 1200, 0.5)], "name string, n int, v double")
    assert sinks.tex_table(small).splitlines() == [r"\begin{tabular}{lrr}", r"\toprule", r"name & n & v \\", r"\midrule", r"x\_1 & 1{,}200 & 0.5 \\", r"\botrule", r"\end{tabular}"]
    assert sinks.config_hash({"b": 1, "a": 2}) == sinks.config_hash({"a": 2, "b": 1}) and len(sinks.config_hash({})) == 10
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    sinks.write_document(df, str(tmp_path / "j"))
    sinks.write_csv(df, str(tmp_path / "c"))
    sinks.write_small(df, str(tmp_path / "p"))
    assert json.loads(sinks.document(df)) == [{"a": 1, "b": "x"}]
    assert sinks.manifest(spark, str(tmp_path / "p")).where("path like '%parquet'").count() == 1
    assert formats.read_document(spark, str(tmp_path / "j" / "*.json")) == {"a": 1, "b": "x"}


def test_codes():
    assert len(C.MIX) == 16 and len(C.FEATURES) == 26 and len(formats.LIVING_COLUMNS) == 33 and len(formats.STAY_COLUMNS) == 24 and len(formats.BUS_COLUMNS) == 57
