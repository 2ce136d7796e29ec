"""The five tables from a star schema of orders: brands are items, regions are lines, order states are output types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .mapping import RawTables

#: History ends and the driver's plan begins here.
CUTOFF = "2001-01-01"
#: Brands whose consumption comes as a rate: those that end in one of these digits.
RELATIVE = ("1", "3", "5")


def load(spark: SparkSession, sf_dir: str, cutoff: str = CUTOFF, grain: str = "p_brand") -> RawTables:
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("lineitem", "orders", "customer", "nation", "part")}
    place = t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").cast("string").alias("line"))
    orders = t["orders"].join(place, F.col("o_custkey") == F.col("c_custkey"))
    part = t["part"].select("p_partkey", F.col(grain).cast("string").alias("item_code"), "p_type")
    relative = F.substring("item_code", -1, 1).isin(*RELATIVE)
    sold = t["lineitem"].where(F.col("l_shipdate") < F.lit(cutoff).cast("timestamp_ntz")).join(orders.select("o_orderkey", "line", F.col("o_orderstatus").alias("output_type")), F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    consumption = sold.select(
        F.col("l_shipdate").alias("date"), "item_code", F.col("l_quantity").alias("qty_base"), (F.col("l_quantity") / 1000).alias("qty_ton"),
        F.col("l_extendedprice").alias("cost"), "output_type", "line", F.when(relative, F.col("l_tax")).alias("rate"), F.when(relative, F.lit("kg/t")).alias("rate_uom"),
    )
    driver = orders.select(
        F.col("o_orderdate").alias("date"), (F.col("o_totalprice") / 1000).alias("driver_qty"), F.lit("t").alias("driver_uom"), F.col("o_orderstatus").alias("output_type"), "line",
        F.when(F.col("o_orderdate") < F.lit(cutoff).cast("timestamp_ntz"), "actual").otherwise("plan").alias("driver_type"),
    )
    return RawTables(_items(part), consumption, driver, _standard(consumption), _calendar(spark), spark.createDataFrame([], "column_name string, n long"), "star")


def _items(part: DataFrame) -> DataFrame:
    own = part.groupBy("item_code").agg(F.min("p_type").alias("cat_l1"), F.max("p_type").alias("cat_l2"))
    return own.select("item_code", F.concat(F.lit("item "), "item_code").alias("description"), F.lit("kg").alias("uom"), F.lit(1.0).alias("unit_price"), F.lit(1.0).alias("unit_wt"), "cat_l1", "cat_l2", F.substring("item_code", 1, 7).alias("cat_l3"), F.lit(None).cast("string").alias("declared_mode"))


def _standard(consumption: DataFrame) -> DataFrame:
    rated = consumption.where("rate IS NOT NULL").groupBy("item_code", "line", "output_type")
    return rated.agg((F.sum("rate") / F.countDistinct(F.trunc(F.to_date("date"), "month"))).alias("std_rate")).select("item_code", "std_rate", F.lit("kg/t").alias("std_uom"), "output_type", "line")


def _calendar(spark: SparkSession) -> DataFrame:
    """A flag for the first month of each quarter, and a named season in summer."""
    months = spark.range(84).select(F.add_months(F.lit("1995-01-01").cast("date"), F.col("id").cast("int")).alias("m"))
    flag = months.select(F.date_format("m", "yyyy-MM").alias("period"), F.lit("promotion").alias("factor_name"), F.when(F.month("m") % 3 == 1, "1").otherwise("0").alias("factor_value"))
    named = months.where(F.month("m").between(6, 8)).select(F.date_format("m", "yyyy-MM").alias("period"), F.lit("season").alias("factor_name"), F.lit("summer").alias("factor_value"))
    return flag.unionByName(named).withColumn("unit", F.lit(None).cast("string")).withColumn("stream", F.lit(None).cast("string"))
