"""Readers of the original file formats: CSV in ZIP archives, code page 949, shapefiles, spreadsheets, paged JSON.

Files reach the tasks through Spark's own binaryFile source, so any store that Spark reads will do; a file is the unit of
work (a day's or a month's file of counts, a layer of polygons). Schemas are fixed in code, never inferred.
"""

from __future__ import annotations

import csv
import io
import json
import os
import re
import struct
import time
import urllib.request
import zipfile
from collections.abc import Iterator, Sequence
from itertools import chain
from pathlib import Path
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridweave import constants as C
from gridweave.functions import columns as X

# The order of columns in the raw files.
LIVING_META = ["date", "hour", "admin_dong", "grid_id", "total_pop"]
LIVING_COLUMNS = [*LIVING_META, *(f"{s}_{b}" for s in C.SEXES for b in C.LIVING_BANDS)]
STAY_META = ["date", "admin_dong", "cell_id", "utm_x", "utm_y", "start_tz", "stay_dur", "total"]
STAY_COLUMNS = [*STAY_META, *(f"{s}_{b}" for s in C.SEXES for b in C.STAY_BANDS)]
BUS_HOURS = ["00", *(str(h) for h in range(1, 24))]
BUS_META = ["use_ym", "route_no", "route_name", "stop_id", "ars_no", "stop_name"]
BUS_COLUMNS = [*BUS_META, *(f"{k}_{h}" for h in BUS_HOURS for k in ("b", "a")), "transit_type_code", "transit_type_name", "reg_date"]


def read_months(spark: SparkSession, path: str, months: Sequence[str] | None = None, month: str = "year_month") -> DataFrame:
    """A table of folders month=...; with months, only the folders of these that exist are read."""
    df = spark.read.parquet(path)
    return df if months is None else df.where(F.col(month).cast("string").isin([str(m) for m in months]))


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _csv_rows(data: bytes, encoding: str) -> Iterator[list[str]]:
    rows = csv.reader(io.StringIO(data.decode(encoding, errors="replace"), newline=""), quotechar='"')
    next(rows, None)
    return rows


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV files with a header, under a given schema; a row that does not fit it is an error."""
    return spark.read.csv(path, schema=schema, header=True, mode="FAILFAST", enforceSchema=False)


def read_tensors(spark: SparkSession, path: str) -> DataFrame:
    """Arrays in NPY files and NPZ archives: path, name (of the member; of an NPY file, its own), shape, and values in C order as doubles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at, data in zip(b["path"], b["content"], strict=True):
                held = np.load(io.BytesIO(data), allow_pickle=False)
                members = {n: held[n] for n in held.files} if hasattr(held, "files") else {at.rsplit("/", 1)[-1].removesuffix(".npy"): held}
                yield pd.DataFrame({"path": [at] * len(members), "name": list(members), "shape": [list(a.shape) for a in members.values()], "values": [a.astype(np.float64).ravel() for a in members.values()]})

    return binary_files(spark, path).mapInPandas(run, "path string, name string, shape array<int>, values array<double>")


def csv_columns(spark: SparkSession, path: str, names: Sequence[str], encoding: str = "cp949", exact: bool = False, block: int = 20_000) -> DataFrame:
    """Text columns of CSV files, or of the CSV members of ZIP archives, by position.

    The header is skipped, rows may be longer than names (`exact`: must not be) and shorter rows end in nulls. `member` names the file that a row is from.
    """
    width = len(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at, data in zip(b["path"], b["content"], strict=True):
                if zipfile.is_zipfile(io.BytesIO(data)):
                    z = zipfile.ZipFile(io.BytesIO(data))
                    parts = ((m, z.read(m)) for m in sorted(z.namelist()) if m.lower().endswith(".csv"))
                else:
                    parts = iter([(at, data)])
                for member, raw in parts:
                    held: list[list[str | None]] = []
                    for row in _csv_rows(raw, encoding):
                        if exact and len(row) != width:
                            raise ValueError(f"{member}: a row has {len(row)} columns, not {width}")
                        if row:
                            held.append([member, *row[:width], *[None] * (width - len(row))])
                        if len(held) >= block:
                            yield pd.DataFrame(held, columns=["member", *names], dtype=object)
                            held = []
                    if held:
                        yield pd.DataFrame(held, columns=["member", *names], dtype=object)

    ddl = ", ".join(f"`{n}` string" for n in ["member", *names])
    return binary_files(spark, path).mapInPandas(run, ddl)


def read_living(spark: SparkSession, path: str) -> DataFrame:
    raw = csv_columns(spark, path, LIVING_COLUMNS)
    demo = LIVING_COLUMNS[len(LIVING_META) :]
    return raw.select(X.compact_date(X.strip(F.col("date"))).alias("date"), X.strip(F.col("hour")).cast("tinyint").alias("hour"), *(X.strip(F.col(c)).alias(c) for c in ("admin_dong", "grid_id")), *(X.masked_number(F.col(c)).alias(c) for c in ["total_pop", *demo]))


def read_stay(spark: SparkSession, path: str) -> DataFrame:
    raw = csv_columns(spark, path, STAY_COLUMNS)
    demo = STAY_COLUMNS[len(STAY_META) :]
    return raw.select(
        X.compact_date(X.strip(F.col("date"))).alias("date"),
        *(X.strip(F.col(c)).alias(c) for c in ("admin_dong", "cell_id")),
        *(X.strip(F.col(c)).cast("double").alias(c) for c in ("utm_x", "utm_y")),
        *(X.strip(F.col(c)).alias(c) for c in ("start_tz", "stay_dur")),
        *(X.masked_number(F.col(c)).alias(c) for c in ["total", *demo]),
    )


def read_bus(spark: SparkSession, path: str) -> DataFrame:
    """Bus ridership by route, stop and hour; every row must have the file's 57 columns."""
    from gridweave.operators.transit import long_hours

    raw = csv_columns(spark, path, BUS_COLUMNS, exact=True)
    named = raw.withColumnsRenamed({f"{k}_00": f"{k}_0" for k in "ab"})
    return long_hours(named, [*BUS_META, "transit_type_code", "transit_type_name"], "b_{h}", "a_{h}", range(24))


def read_named_csv(spark: SparkSession, path: str, columns: dict[str, str], encoding: str = "cp949") -> DataFrame:
    """Text columns of CSV files by their header's names: columns maps a header to the name it gets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["content"]:
                rows = csv.DictReader(io.StringIO(data.decode(encoding, errors="replace").removeprefix("﻿"), newline=""))
                got = [[(r.get(h) or "").strip() or None for h in columns] for r in rows]
                if got:
                    yield pd.DataFrame(got, columns=list(columns.values()), dtype=object)

    return binary_files(spark, path).mapInPandas(run, ", ".join(f"`{n}` string" for n in columns.values()))


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file, such as a parameter document."""
    return binary_files(spark, path).select(F.decode("content", "UTF-8").alias("t")).first().t


def read_document(spark: SparkSession, path: str):
    return json.loads(read_text(spark, path))


# Shapefiles.


def _dbf(data: bytes, encoding: str) -> list[dict[str, str]]:
    n, head, width = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("ascii", "replace"), data[at + 16]))
        at += 32
    out = []
    for i in range(n):
        at, row = head + i * width + 1, {}
        for name, size in fields:
            row[name] = data[at : at + size].decode(encoding, "replace").strip("\0 ")
            at += size
        out.append(row)
    return out


def _shp(data: bytes) -> list[list[list[tuple[float, float]]]]:
    """Rings (or, for points, one ring of one point) of each record; null shapes have none."""
    at, out = 100, []
    while at + 12 <= len(data):
        size = struct.unpack_from(">i", data, at + 4)[0] * 2
        kind = struct.unpack_from("<i", data, at + 8)[0]
        body = at + 12
        if kind in (5, 15, 25, 3, 13, 23):
            parts, points = struct.unpack_from("<ii", data, body + 32)
            first = [*struct.unpack_from(f"<{parts}i", data, body + 40), points]
            flat = struct.unpack_from(f"<{2 * points}d", data, body + 40 + 4 * parts)
            out.append([[(flat[2 * j], flat[2 * j + 1]) for j in range(a, b)] for a, b in zip(first, first[1:], strict=False)])
        elif kind in (1, 11, 21):
            out.append([[struct.unpack_from("<dd", data, body)]])
        else:
            out.append([])
        at += 8 + size
    return out


def read_shapefile(spark: SparkSession, path: str, attributes: Sequence[str], encoding: str = "cp949") -> DataFrame:
    """ord, the attributes as text, and rings of the layer whose files are path.shp and path.dbf."""
    both = binary_files(spark, f"{path}.shp").select(F.col("content").alias("shp")).crossJoin(binary_files(spark, f"{path}.dbf").select(F.col("content").alias("dbf")))  # a row each

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shp, dbf in zip(b["shp"], b["dbf"], strict=True):
                rows = [[i, *(a.get(n) for n in attributes), [[{"x": x, "y": y} for x, y in ring] for ring in rings]] for i, (a, rings) in enumerate(zip(_dbf(dbf, encoding), _shp(shp), strict=True))]
                if rows:
                    yield pd.DataFrame(rows, columns=["ord", *attributes, "rings"])

    ddl = ", ".join(["ord long", *(f"`{a}` string" for a in attributes), "rings array<array<struct<x:double,y:double>>>"])
    return both.mapInPandas(run, ddl)


# Spreadsheets.


def _sheet(data: bytes, sheet: int) -> list[list[str | None]]:
    """Cells of a worksheet as text."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
    out = []
    for row in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml")).iterfind(".//m:row", ns):
        cells: dict[int, str | None] = {}
        for i, c in enumerate(row.findall("m:c", ns)):
            letters = re.match("[A-Z]*", c.get("r", ""))[0]
            at = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters))) - 1 if letters else i
            v, inline = c.find("m:v", ns), c.find("m:is", ns)
            text = "".join(t.text or "" for t in inline.iter(f"{{{ns['m']}}}t")) if inline is not None else v.text if v is not None else None
            cells[at] = shared[int(text)] if c.get("t") == "s" and text is not None else text
        out.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
    return out


def read_sheet(spark: SparkSession, path: str, names: Sequence[str], required: str, sheet: int = 1) -> DataFrame:
    """The first columns of a worksheet without its header, rows with a value in `required`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["content"]:
                rows = [[*r[: len(names)], *[None] * (len(names) - len(r))] for r in _sheet(data, sheet)[1:]]
                if rows:
                    yield pd.DataFrame(rows, columns=list(names), dtype=object)

    return binary_files(spark, path).mapInPandas(run, ", ".join(f"`{n}` string" for n in names)).where(F.col(required).isNotNull())


# Paged JSON.


class _Month(InputPartition):
    def __init__(self, month: str) -> None:
        self.month = month


def _persist(fetch, tries: int, pause: float):
    """The result of fetch, which is called again after growing pauses while it fails."""
    for left in range(tries - 1, -1, -1):
        try:
            return fetch()
        except Exception:
            if not left:
                raise
        time.sleep(pause * (tries - left))


def _load(address: str) -> dict:
    if "://" not in address or address.startswith("file://"):
        return json.loads(Path(address.removeprefix("file://")).read_text(encoding="utf-8"))
    with urllib.request.urlopen(address, timeout=40) as answer:
        return json.load(answer)


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict, fields: list[str]) -> None:
        self.o, self.fields = options, fields

    def partitions(self) -> list[InputPartition]:
        return [_Month(m) for m in self.o["months"].split(",")]

    def page(self, month: str, rows: range) -> dict:
        """The rows of these numbers. Anything but the code for success (or none) is an error, and asked for again."""
        service = self.o["service"]
        address = self.o["url"].format(key=self.o.get("key", ""), service=service, start=rows[0], end=rows[-1], month=month)

        def fetch() -> dict:
            body = _load(address)[service]
            if (code := body.get("RESULT", {}).get("CODE", "INFO-000")) != "INFO-000":
                raise RuntimeError(f"the service answers {code}")
            return body

        return _persist(fetch, int(self.o.get("retries", 4)), float(self.o.get("pause", 1.5)))

    def read(self, partition: _Month) -> Iterator[tuple]:
        """The first page tells how many rows a month has, and so which pages follow; a month that comes out shorter is an error."""
        size, month = int(self.o.get("page", 1000)), partition.month
        head = self.page(month, range(1, size + 1))
        total = int(head.get("list_total_count", 0))
        later = (self.page(month, range(at, min(at + size, total + 1))) for at in range(size + 1, total + 1, size))
        missing = total
        for body in chain([head], later):
            for row in body.get("row", []):
                missing -= 1
                yield tuple(None if (v := row.get(f)) is None else str(v) for f in self.fields)
        if missing > 0:
            raise RuntimeError(f"{missing} of {total} rows of {month} are missing")


class PagedJson(DataSource):
    """A JSON service that answers pages of rows and their total number; a partition a month.

    Options: url (with {key}, {service}, {start}, {end}, {month}; a path of files serves too), service, months, fields, key, page, retries, pause.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return ", ".join(f"`{f}` string" for f in self.options["fields"].split(","))

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(dict(self.options), self.options["fields"].split(","))


def service_key(variable: str, env_file: str | None = None) -> str:
    """A key from the environment, else from a file of NAME=value lines."""
    if value := os.environ.get(variable):
        return value.strip()
    if env_file and os.path.exists(env_file):
        with open(env_file, encoding="utf-8") as f:
            for line in f:
                name, sign, value = line.partition("=")
                if sign and name.strip() == variable:
                    return value.strip().strip("\"'")
    raise KeyError(f"{variable} is neither set nor in {env_file}")


def read_subway(spark: SparkSession, **options: str) -> DataFrame:
    """Subway ridership by month, line, station and hour; rows that the service repeats are kept once."""
    from gridweave.operators.transit import SUBWAY_HOURS, dedup_first, long_hours

    on, off = "HR_{h}_GET_ON_NOPE", "HR_{h}_GET_OFF_NOPE"
    ids = {"USE_MM": "use_mm", "SBWY_ROUT_LN_NM": "line", "STTN": "station_name"}
    fields = [*ids, *(p.format(h=h) for h in SUBWAY_HOURS for p in (on, off))]
    spark.dataSource.register(PagedJson)
    wide = spark.read.format("paged_json").options(**{"fields": ",".join(fields), "service": "CardSubwayTime"} | options).load()
    return dedup_first(long_hours(wide, list(ids), on, off, SUBWAY_HOURS).withColumnsRenamed(ids), ["use_mm", "line", "station_name", "hour"])
