"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def stars(links: DataFrame) -> DataFrame:
    """``a, root`` for every node with a link: ``root`` is the least node of its component.

    ``links`` has ``a, b`` (bigint), in either order. Each round hangs every
    node's larger neighbours, then its smaller ones, on the least node it sees;
    rounds grow with the logarithm of the longest path. Minima are taken by
    partial aggregation, so the centre of a large star costs one row a task,
    and the joins back are ones whose large keys Spark can split. Rounds are
    written to the shared folder.
    """
    links = written(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    was = None
    while True:
        now = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b") % (1 << 31)).alias("s"), F.sum(F.xxhash64("b", "a") % (1 << 31)).alias("t")).first()
        if now["n"] == 0 or now == was:
            return links.select("a", F.col("b").alias("root"))
        was = now
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        links = written(small.select("x.a", "x.b").where("a != b").distinct(), "links")
