"""Column mapping and type coercion of the five input tables (SRC4-SRC7)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The external column names of each table, what they are called
# here, and their types.
COLUMNS: dict[str, dict[str, tuple[str, str]]] = {
    "bom": {
        "item_code": ("item_code", "string"),
        "item_description": ("description", "string"),
        "uom": ("uom", "string"),
        "unit_price_$": ("unit_price", "double"),
        "unit_wt_kg": ("unit_wt", "double"),
        "category_level1": ("cat_l1", "string"),
        "category_level2": ("cat_l2", "string"),
        "category_level3": ("cat_l3", "string"),
    },
    "consumption": {
        "date": ("date", "timestamp"),
        "item_code": ("item_code", "string"),
        "cons_qty_base_uom": ("qty_base", "double"),
        "cons_qty_ton": ("qty_ton", "double"),
        "cons_$": ("cost", "double"),
        "output_type": ("output_type", "string"),
        "production_line": ("line", "string"),
        "cons_rate": ("rate", "double"),
        "cons_rate_uom": ("rate_uom", "string"),
    },
    "prod": {
        "date": ("date", "timestamp"),
        "production_qty1": ("driver_qty", "double"),
        "production_uom1": ("driver_uom", "string"),
        "production_qty2": ("driver_qty2", "double"),
        "production_uom2": ("driver_uom2", "string"),
        "output_type": ("output_type", "string"),
        "production_line": ("line", "string"),
        "production_type": ("driver_type", "string"),
    },
    "consumption_figs": {
        "item_code": ("item_code", "string"),
        "std_cons_rate": ("std_rate", "double"),
        "std_cons_rate_uom": ("std_uom", "string"),
        "output_type": ("output_type", "string"),
        "production_line": ("line", "string"),
    },
    "context_calendar": {
        "period": ("period", "string"),
        "factor_name": ("factor_name", "string"),
        "factor_value": ("factor_value", "string"),
    },
}
OPTIONAL: dict[str, dict[str, tuple[str, str]]] = {"bom": {"mode": ("declared_mode", "string")}, "context_calendar": {"unit": ("unit", "string"), "stream": ("stream", "string")}}
REQUIRED = ("bom", "consumption")


class SchemaError(ValueError):
    """A required table or column is missing."""


@dataclass
class RawTables:
    """The input tables under internal names; a table that was not given is empty, never None. ``failures`` has a row for each column: how many values could not be read as its type."""

    items: DataFrame
    consumption: DataFrame
    driver: DataFrame
    standard_rates: DataFrame
    calendar: DataFrame
    failures: DataFrame
    source_name: str = ""
    extra: dict = field(default_factory=dict)


def _typed(name: str, kind: str):
    c = F.col(f"`{name}`")
    if kind == "string":
        return F.nullif(F.trim(c.cast("string")), F.lit(""))
    if kind == "timestamp":
        return F.coalesce(F.expr(f"try_cast(`{name}` AS timestamp)"), F.try_to_timestamp(c.cast("string")))
    return F.expr(f"try_cast(`{name}` AS {kind})")


def map_columns(df: DataFrame, table: str) -> DataFrame:
    """``df`` under internal names with internal types; unknown columns go, optional ones that are absent are null."""
    want, maybe = COLUMNS[table], OPTIONAL.get(table, {})
    if missing := [c for c in want if c not in df.columns]:
        raise SchemaError(f"{table}: missing columns {missing}")
    return df.select(*[_typed(e, k).alias(i) for e, (i, k) in want.items()], *[(_typed(e, k) if e in df.columns else F.lit(None).cast(k)).alias(i) for e, (i, k) in maybe.items()])


def coercion_failures(df: DataFrame, table: str) -> DataFrame:
    """``column_name, n``: values that are there but cannot be read as the column's type, in one pass."""
    cols = {e: v for e, v in {**COLUMNS[table], **OPTIONAL.get(table, {})}.items() if e in df.columns and v[1] != "string"}
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "column_name string, n long")
    counted = df.agg(*[F.count_if(F.col(f"`{e}`").isNotNull() & (F.trim(F.col(f"`{e}`").cast("string")) != "") & _typed(e, k).isNull()).alias(i) for e, (i, k) in cols.items()])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(f"{table}.{i}").alias("column_name"), F.col(i).alias("n")) for _, (i, _) in cols.items()])).alias("x")).select("x.column_name", "x.n")


def empty(spark: SparkSession, table: str) -> DataFrame:
    cols = {**COLUMNS[table], **OPTIONAL.get(table, {})}
    return spark.createDataFrame([], ", ".join(f"`{i}` {k}" for i, k in cols.values()))


def build_raw_tables(spark: SparkSession, sheets: dict[str, DataFrame], source_name: str = "") -> RawTables:
    if missing := [t for t in REQUIRED if t not in sheets]:
        raise SchemaError(f"missing tables {missing}")
    got = {t: map_columns(sheets[t], t) if t in sheets else empty(spark, t) for t in COLUMNS}
    failures = None
    for t, df in sheets.items():
        if t in COLUMNS:
            failures = coercion_failures(df, t) if failures is None else failures.unionByName(coercion_failures(df, t))
    return RawTables(got["bom"], got["consumption"], got["prod"], got["consumption_figs"], got["context_calendar"], failures, source_name)
