"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Rows and bytes of an Arrow batch: bounds a Python worker's memory by texts, not by table size.
BATCH_ROWS, BATCH_BYTES = 512, 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session names none and runs on one machine, as in tests, a
    folder below the warehouse is set; on a cluster that is an error, since
    executors would write to disks of their own.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/rateline-checkpoints"
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/rateline-{name}-{uuid.uuid4().hex}"


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Within, Spark deletes a query's shuffle files when the query ends."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, was)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, reread: cuts lineage, survives lost executors. What was shuffled to make it is not needed any more."""
    spark = df.sparkSession
    at = scratch(spark, name)
    with _shuffles_deleted(spark):
        df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def delete_written(spark: SparkSession) -> int:
    """Delete all tables between steps from the shared folder, of this and of earlier sessions; their number. Results that still read them break, so call it when these are stored elsewhere."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = at.getFileSystem(conf)
    own = [f.getPath() for f in fs.globStatus(jvm.org.apache.hadoop.fs.Path(at, "rateline-*")) or []]
    return sum(bool(fs.delete(p, True)) for p in own)


def small_batches(spark: SparkSession) -> None:
    """Get a session ready for Python stages: the package where workers are, and bounded Arrow batches. Texts may be long, so the default of 10 000 rows a batch is too many."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions_for(spark: SparkSession) -> int:
    """Tasks for an exchange that the operator places itself."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


#: Rows of one key that go to one range of it, as a share of what a range holds on average.
CROWDED = 2


class KeyRanges:
    """Ranges of ``(key, hash of the text)`` of about the same number of rows, in ascending order of ``key`` (bigint), null keys first.

    Bounds are quantiles of the key, of which only that column is read. A key
    of more rows than ``CROWDED`` ranges hold has a range of its own, which is
    cut further by the hash of the text, so that no key is one task's alone.
    """

    def __init__(self, df: DataFrame, key: str, text: str, parts: int):
        self.key, self.text = key, text
        n, some, cuts = df.agg(F.count(F.lit(1)), F.count(key), F.percentile_approx(key, [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()
        held = Counter(cuts if cuts and parts > 1 else [])
        crowded = {v for v, k in held.items() if k > CROWDED}
        self.bounds: list[int] = sorted({*held, *(v - 1 for v in crowded if v > -(1 << 63))})
        ways = {i + 1: held[v] for i, v in enumerate(self.bounds) if v in crowded}
        ways[0] = max(1, -(-(n - some) * parts // max(1, n)))
        #: How many ranges each range of keys is cut into by the hash; 0 is that of null keys.
        self.ways = [ways.get(i, 1) for i in range(len(self.bounds) + 2)]
        self.firsts = [sum(self.ways[:i]) for i in range(len(self.ways))]
        self.count = sum(self.ways)

    def part(self):
        """The range of a row."""
        of = range_part(self.key, self.bounds)
        if max(self.ways) == 1:
            return of
        pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), of + 1)
        turned = F.shiftright(F.xxhash64(self.text), 32) + F.lit(1 << 31)  # 0 to 2**32, in the order of the hash
        return (pick(self.firsts) + F.shiftright(turned * pick(self.ways), 32).cast("int")).cast("int")


def range_part(key: str, bounds: list[int]):
    """0 for null keys, else 1 + how many bounds lie below the key.

    A balanced tree of comparisons: log2 of the bounds a row, inside generated code.
    """

    def tree(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo + 1)
        mid = (lo + hi) // 2
        return F.when(F.col(key) <= F.lit(bounds[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return F.when(F.col(key).isNull(), F.lit(0)).otherwise(tree(0, len(bounds)))
