"""Work on whole series is spread over tasks, and none of it is done twice."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from rateline.operators import fitted as M
from rateline.operators import smoothing as S
from rateline.staging import spread


def test_series_that_lie_by_key_already_are_dealt_to_many_tasks(spark):
    rows = spark.range(1200).select((F.col("id") % 60).cast("string").alias("series_id"), (F.col("id") / 60).cast("int").alias("idx"), F.lit(1.0).alias("y"), F.lit(1).alias("valid"))
    by_key = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("series_id"))).where("n = 20")
    held = S.whole_series(by_key).groupBy(F.spark_partition_id().alias("p")).count().collect()
    tasks = min(60, spread(spark))
    assert tasks == 1 or len(held) > tasks // 2
    assert sum(r["count"] for r in held) == 60


def test_a_form_that_two_models_share_is_fitted_once(monkeypatch):
    y, asked, plain = 20 + 5 * np.sin(np.arange(60) / 2) + np.arange(60) / 9, [], M.smoothing_at
    monkeypatch.setattr(M, "smoothing_at", lambda y, stops, m, f: asked.extend((f, o) for o in stops) or plain(y, stops, m, f))
    made, origins = {}, [50, 54]
    M.fits_at("HoltWinters", y, origins, 12, True, made)
    got = M.fits_at("ETS", y, origins, 12, True, made)
    assert len(asked) == len(set(asked)) == 12
    alone = M.fits_at("ETS", y, origins, 12)
    assert all((got[o]["ahead"](3) == alone[o]["ahead"](3)).all() for o in origins)
