from concurrent.futures import ThreadPoolExecutor

from rateline.sources.exports import dictionary
from rateline.sources.files import DirectorySource
from rateline.sources.store import CACHED, Repository, cached, sample, settings_key


def test_runs_tables_and_overrides(spark, tmp_path):
    repo = Repository(spark, f"file://{tmp_path}/store")
    assert repo.runs() == [] and repo.read("series") is None
    a, b = repo.create_run({"x": 1}), repo.create_run({"x": 2})
    repo.finish_run(a)
    assert [r["number"] for r in repo.runs()] == [2, 1] and repo.latest_complete()["run_id"] == a
    df = spark.createDataFrame([("s", 1.0), ("t", 2.0)], "series_id string, v double")
    repo.append("forecast", a, df)
    repo.append("forecast", b, df)
    assert repo.read("forecast", a).count() == 2 and repo.read("forecast", a, ["s"]).count() == 1
    none = repo.create_run({})
    repo.append("warning", none, df.limit(0))
    assert repo.read("warning", none).count() == 0 and "run_id" in repo.read("warning").columns and repo.read("selection") is None
    repo.delete_run(none)
    repo.delete_run(b)
    assert repo.read("forecast").count() == 2 and len(repo.runs()) == 1
    repo.replace("series", df)
    repo.replace("series", repo.read("series").where("v > 1"))
    assert repo.read("series").count() == 1
    repo.set_override("model_override", "s", "Naive")
    repo.set_override("model_override", "t", "Mean")
    repo.set_override("model_override", "s", None)
    assert [tuple(r) for r in repo.read("model_override").collect()] == [("t", "Mean")]
    rows = spark.createDataFrame([("s", "2024-01", "r", 1.0, 2.0, "m")], "series_id string, period string, run_id string, forecast_value double, actual_value double, model string")
    repo.upsert_accuracy(rows)
    repo.upsert_accuracy(rows)
    assert repo.read("accuracy_history").count() == 1


def test_replaced_tables_stay_readable_once(spark, tmp_path):
    """A plan made before a replacement still reads what it was made for; pointers are whole at any time."""
    repo = Repository(spark, f"file://{tmp_path}/store")
    repo.replace("series", spark.range(3))
    before = repo.read("series")
    repo.replace("series", spark.range(5))
    assert before.count() == 3 and repo.read("series").count() == 5
    repo.replace("series", repo.read("series").union(before))
    assert repo.read("series").count() == 8
    assert len(list((tmp_path / "store" / "series").iterdir())) == 2 and not [f for f in (tmp_path / "store").iterdir() if f.name.startswith("series.current.")]
    assert repo.read("series", backfill={"extra": 7, "id": 0}).agg({"extra": "sum"}).first()[0] == 56


def test_cache(spark, tmp_path):
    repo, made = Repository(spark, f"file://{tmp_path}/store"), []

    def compute(k):
        return lambda: (made.append(k), spark.createDataFrame([(k,)], "k int"))[1]

    for k in [1, 1, *range(2, CACHED + 2), 2, 1]:
        assert cached(repo, f"key{k}", compute(k)).first()["k"] == k
    assert made == [1, *range(2, CACHED + 2), 1]


def test_export_helpers(spark):
    df = spark.range(20)
    assert sample({"a": df})["a"].count() == 10
    got = dictionary({"series": df.withColumnRenamed("id", "adi"), "x": df}, spark).collect()
    assert got[0]["formula"].startswith("n values") and got[1]["formula"] == ""
    assert settings_key("f", {"a": 1}) != settings_key("f", {"a": 2})


def test_tables_for_editing(spark, tmp_path):
    bom = spark.createDataFrame([("a", "A")], "item_code string, item_description string")
    bom.write.parquet(f"{tmp_path}/in/bom.parquet")
    got = DirectorySource(spark, f"file://{tmp_path}/in").for_editing()
    assert got["bom"].columns == bom.columns and got["bom"].count() == 1
    assert got["prod"].count() == 0 and "production_qty1" in got["prod"].columns and "unit" in got["context_calendar"].columns


def test_runs_that_begin_at_once(spark, tmp_path):
    """Each has a number of its own, and none is lost; a run that ends changes its own entry only."""
    repo = Repository(spark, f"file://{tmp_path}/store")
    with ThreadPoolExecutor(6) as pool:
        ids = list(pool.map(lambda i: repo.create_run({"i": i}), range(12)))
        list(pool.map(repo.finish_run, ids[::2]))
    got = repo.runs()
    assert sorted(r["number"] for r in got) == list(range(1, 13)) and {r["run_id"] for r in got} == set(ids)
    assert {r["run_id"] for r in got if r["status"] == "complete"} == set(ids[::2])
    assert not repo._put("runs/0000000001.json", "{}", over=False) and len(repo.runs()) == 12
    repo.delete_run(next(r["run_id"] for r in got if r["number"] == 1))
    assert len(repo.runs()) == 11 and repo.create_run({}) and max(r["number"] for r in repo.runs()) == 13


def test_tables_of_a_run(spark, tmp_path):
    """Working tables are the run's own and go when it ends; new columns join the schema; notes of one code are replaced."""
    repo = Repository(spark, f"file://{tmp_path}/store")
    a, b = repo.create_run({}), repo.create_run({})
    first = repo.append("winner", a, spark.createDataFrame([("s", "Mean")], "series_id string, model string"))
    repo.append("winner", b, spark.createDataFrame([("s", "Drift", 3)], "series_id string, model string, extra int"))
    assert first.first()["model"] == "Mean" and repo.read("winner", b).first()["extra"] == 3 and repo.read("winner", a).first()["extra"] is None
    repo.finish_run(a)
    assert repo.read("winner", a).count() == 0 and repo.read("winner", b).count() == 1
    note = lambda code, text: spark.createDataFrame([("s", code, text)], "series_id string, code string, message string")
    repo.append("warning", a, note("OTHER", "stays"))
    for text in ("first", "second"):
        repo.put_notes("warning", a, "ACCURACY_DRIFT", note("ACCURACY_DRIFT", text))
    assert {(r["code"], r["message"]) for r in repo.read("warning", a).collect()} == {("OTHER", "stays"), ("ACCURACY_DRIFT", "second")}
    repo.put_notes("warning", b, "ACCURACY_DRIFT", note("ACCURACY_DRIFT", "alone"))
    assert repo.read("warning", b).count() == 1 and repo.read("warning").count() == 3
    new = repo.replace("series", spark.range(4))
    repo.replace("series", spark.range(9))
    assert new.count() == 4
