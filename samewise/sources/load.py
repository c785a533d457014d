"""Readers: frames, registered datasets, delimited and columnar files, spreadsheets."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Datasets by lower-case key (S-2).
DATASETS: dict[str, Callable[[SparkSession], DataFrame]] = {}
_SEPARATORS = [",", "\t", "|", ";", ":"]


def register(key: str, load: Callable[[SparkSession], DataFrame]) -> None:
    DATASETS[key.lower()] = load


def lowered(df: DataFrame) -> DataFrame:
    """The same columns with lower-case names; two that become equal are an error."""
    names = [c.lower() for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"column names clash in lower case: {names}")
    return df.toDF(*names)


def extension(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def separator(head: list[str]) -> str:
    """The separator that splits the lines into the most fields, evenly; what is in quotes doesn't count."""
    head = [re.sub('"[^"]*"', "", x) for x in head if x.strip()]

    def worth(sep: str) -> tuple[bool, int]:
        many = [x.count(sep) for x in head]
        return bool(many) and min(many) == max(many), min(many, default=0)

    best = max(_SEPARATORS, key=worth)
    return best if worth(best)[1] else ","


def sniffed(spark: SparkSession, path: str, lines: int = 20) -> str:
    """The separator of a file, by its first lines."""
    return separator([r.value for r in spark.read.text(path).limit(lines).collect()])


def delimited(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    return spark.read.csv(path, sep=sep or sniffed(spark, path), header=True, inferSchema=True, quote='"', escape='"', nullValue="NA", mode="PERMISSIVE", multiLine=False)


def remote(spark: SparkSession, url: str, seconds: float = 60.0) -> DataFrame:
    """A delimited file behind a URL, fetched by the driver: for tables that its memory holds."""
    from urllib.request import urlopen

    with urlopen(url, timeout=seconds) as answer:
        lines = answer.read().decode("utf-8-sig").splitlines()
    rows = spark.createDataFrame([(x,) for x in lines], "value string")
    return spark.read.csv(rows.rdd.map(lambda r: r.value), sep=separator(lines[:20]), header=True, inferSchema=True, quote='"', escape='"', nullValue="NA")


def spreadsheet(spark: SparkSession, path: str, sheet: int | str | None = None) -> DataFrame:
    """One sheet, the first by default; needs openpyxl."""
    import pandas as pd

    try:
        pdf = pd.read_excel(path, sheet_name=(sheet - 1 if isinstance(sheet, int) else sheet) if sheet else 0)
    except ImportError as e:
        raise RuntimeError("reading xlsx and xls needs the package openpyxl") from e
    return spark.createDataFrame(pdf)


def load_input(spark: SparkSession, data, sheet: int | str | None = None) -> DataFrame:
    """A DataFrame, a pandas frame, a registered key, a path, or a URL of a delimited file; names are lower-cased (S-1 to S-5, S-9)."""
    if isinstance(data, DataFrame):
        return lowered(data)
    if hasattr(data, "iloc"):
        return lowered(spark.createDataFrame(data))
    if not isinstance(data, str):
        raise TypeError("unsupported input: give a DataFrame, a dataset key or a path")
    if data.lower() in DATASETS:
        return lowered(DATASETS[data.lower()](spark))
    ext = extension(data)
    if data.startswith(("http://", "https://")):
        return lowered(remote(spark, data))
    if ext in ("xlsx", "xls"):
        return lowered(spreadsheet(spark, data, sheet))
    if ext in ("parquet", "json", "orc"):
        return lowered(spark.read.format(ext).load(data))
    return lowered(delimited(spark, data))


def load_truth(spark: SparkSession, path: str) -> DataFrame:
    """A truth file: tab for tsv, comma for csv, txt and psv, else as other input (S-6, S-7, T12)."""
    ext = extension(path)
    if ext in ("csv", "tsv", "txt", "psv"):
        return lowered(delimited(spark, path, "\t" if ext == "tsv" else ","))
    if ext in ("xlsx", "xls"):
        return lowered(spreadsheet(spark, path))
    return load_input(spark, path)
