"""Writers: partitioned tables that can be written again, small tables, documents and LaTeX tables."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_parts(df: DataFrame, path: str, part: str, force: bool = False) -> DataFrame:
    """Writes the parts of df (values of the column `part`, such as days or months) that path does not hold yet (with force, all).

    A part is replaced as a whole, so a run that broke off is repeated by calling this again. Parts of any size are dealt to tasks by the
    adaptive planner, which cuts large ones in several. Returns the account of what is there now: part and rows, and whether this call wrote it.
    """
    spark = df.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    here = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) and not force else []
    done = [n.partition("=")[2] for n in here if n.startswith(f"{part}=")]  # a name a part
    new = df.where(~F.col(part).cast("string").isin(done)) if done else df
    ours = [r[0] for r in new.select(F.col(part).cast("string")).distinct().collect()]  # a row a part
    if ours:
        new.hint("rebalance", part).write.partitionBy(part).mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").parquet(path)
    if not fs.exists(root):
        return spark.createDataFrame([], f"{part} string, rows long, written boolean")
    rows = spark.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", "false").parquet(path).groupBy(F.col(part).cast("string").alias(part)).agg(F.count("*").alias("rows"))
    return rows.withColumn("written", F.col(part).isin(ours) if ours else F.lit(False))


def write_months(df: DataFrame, path: str, month: str = "year_month", force: bool = False) -> list[str]:
    """write_parts by month; returns the months written."""
    return sorted(r[0] for r in write_parts(df, path, month, force).where("written").select(month).collect())  # a row a month


def write_days(df: DataFrame, path: str, day: str = "date", force: bool = False) -> DataFrame:
    """write_parts by day: an ingest that broke off goes on with the days that are not there."""
    return write_parts(df, path, day, force)


def write_small(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_document(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def document(df: DataFrame) -> str:
    """A small result as JSON text."""
    return json.dumps([r.asDict(recursive=True) for r in df.collect()], ensure_ascii=False, indent=2, default=str)


_TEX = {c: f"\\{c}" for c in "&%$#_{}"} | {"~": r"\textasciitilde{}", "^": r"\textasciicircum{}", "\\": r"\textbackslash{}"}


def tex_cell(value: object) -> str:
    """A value as TeX: integers in groups of three digits (20500 is 20{,}500), floats as they are, text with TeX's own signs escaped, null empty."""
    if value is None:
        return ""
    if isinstance(value, int) and not isinstance(value, bool):
        return re.sub(r"(?<=\d)(?=(?:\d{3})+$)", "{,}", str(value))
    return "".join(_TEX.get(c, c) for c in str(value))


def tex_table(df: DataFrame, head: Sequence[str] | None = None, align: str | None = None) -> str:
    """A small result as a LaTeX tabular with a head (the columns' names); numbers stand to the right, all else to the left."""
    head, *body = [" & ".join(map(tex_cell, cells)) + r" \\" for cells in (head or df.columns, *df.collect())]
    align = align or "".join("r" if re.match("tinyint|smallint|int|bigint|float|double|decimal", t) else "l" for _, t in df.dtypes)
    return "\n".join([rf"\begin{{tabular}}{{{align}}}", r"\toprule", head, r"\midrule", *body, r"\botrule", r"\end{tabular}", ""])


def manifest(spark, path: str) -> DataFrame:
    """Size and SHA-256 of each file under path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def config_hash(config: dict) -> str:
    """Ten hex digits that name a configuration."""
    return hashlib.sha1(json.dumps(config, sort_keys=True).encode()).hexdigest()[:10]
