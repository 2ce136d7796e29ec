"""Directory and workbook sources (SRC1-SRC3, SRC8, SRC10)."""

from __future__ import annotations

import hashlib
import os
from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession

from .mapping import COLUMNS, OPTIONAL, RawTables, build_raw_tables

WORKBOOK_BYTES = 100 << 20


class DataSource(ABC):
    """Where the five tables come from."""

    @abstractmethod
    def load(self) -> RawTables: ...


class DirectorySource(DataSource):
    """A folder with a file or folder for each table, in Parquet, ORC, CSV or JSON; any path Spark reads."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "parquet"):
        if kind not in ("parquet", "orc", "csv", "json"):
            raise ValueError(f"unknown format {kind}")
        self.spark, self.path, self.kind = spark, path.rstrip("/"), kind

    def sheets(self) -> dict[str, DataFrame]:
        """Tables under their external names; those that are not there are left out."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        found = {}
        for t in COLUMNS:
            for name in (f"{t}.{self.kind}", t):
                at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
                if at.getFileSystem(conf).exists(at):
                    reader = self.spark.read.option("header", True) if self.kind == "csv" else self.spark.read
                    found[t] = reader.format(self.kind).load(f"{self.path}/{name}")
                    break
        return found

    def for_editing(self) -> dict[str, DataFrame]:
        """SRC7: all tables under their external names; those that are not there are empty."""
        found = self.sheets()
        return {t: found[t] if t in found else self.spark.createDataFrame([], ", ".join(f"`{c}` string" for c in {**COLUMNS[t], **OPTIONAL.get(t, {})})) for t in COLUMNS}

    def load(self) -> RawTables:
        return build_raw_tables(self.spark, self.sheets(), os.path.basename(self.path))


class WorkbookSource(DataSource):
    """An .xlsx workbook of 100 MB at most, read where ``openpyxl`` is installed."""

    def __init__(self, spark: SparkSession, path: str):
        if not path.lower().endswith(".xlsx"):
            raise ValueError("a workbook must end in .xlsx")
        if not os.path.exists(path):
            raise FileNotFoundError(path)
        if os.path.getsize(path) > WORKBOOK_BYTES:
            raise ValueError("a workbook must not be larger than 100 MB")
        self.spark, self.path = spark, path

    def load(self) -> RawTables:
        import pandas as pd

        book = pd.read_excel(self.path, sheet_name=None, dtype=str)
        sheets = {t: self.spark.createDataFrame(book[t].astype(object).where(book[t].notna(), None)) for t in COLUMNS if t in book and len(book[t])}
        return build_raw_tables(self.spark, sheets, os.path.basename(self.path))


def fingerprint(path: str) -> str:
    """16 hex digits of the SHA-256 of an input file (SRC10)."""
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()[:16]


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows to import: CSV with a header, or what the ending says (SRC8)."""
    kind = path.rsplit(".", 1)[-1].lower()
    return spark.read.csv(path, header=True) if kind == "csv" else spark.read.format(kind).load(path)
