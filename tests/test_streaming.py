import pytest
from pyspark.sql import functions as F

from fieldloom import streaming
from fieldloom.operators import scoring
from fieldloom.streaming import current_totals, score_stream, totals_stream


def test_each_file_is_scored_once(spark, tmp_path):
    records = spark.createDataFrame([(f"q{i}", "read", [1.0, 2.0], 0.2, "values", None, 8, 8) for i in range(3)], "qa_id string, task string, values array<double>, tolerance double, answer_kind string, runs array<struct<r:int,c0:int,c1:int>>, h int, w int")
    folder, out, mark = (f"file://{tmp_path}/{n}" for n in ("in", "out", "mark"))
    for i, text in enumerate(["[1, 2.1]", "[9, 2]"]):
        spark.createDataFrame([(f"q{i}", text, True)], "qa_id string, prediction string, terminated boolean").coalesce(1).write.mode("append").json(folder)
        score_stream(spark, records, folder, out, mark).awaitTermination()
    assert {r.qa_id: r.hits for r in spark.read.parquet(out).collect()} == {"q0": 2, "q1": 1}


RECORDS = "qa_id string, task string, values array<double>, tolerance double, answer_kind string, runs array<struct<r:int,c0:int,c1:int>>, h int, w int"


@pytest.fixture
def folders(spark, tmp_path):
    """Records of three tasks, and six files of predictions with repeats within and across files."""
    records = spark.createDataFrame([(f"q{i}", f"t{i % 3}", [float(i), 2.0], 0.2, "values", None, 8, 8) for i in range(30)], RECORDS)
    paths = {n: f"file://{tmp_path}/{n}" for n in ("in", "out", "mark")}
    for k in range(6):
        rows = [(f"q{(5 * k + j) % 30}", f"[{(5 * k + j) % 30}, {2 + (k + j) % 2}]", j != 4) for j in range(8)] + [("unknown", "[1]", True), (f"q{5 * k}", "[0, 0]" if k % 2 else f"[{5 * k}, {2 + k % 2}]", True)]
        spark.createDataFrame(rows[:8] + rows[8:9], "qa_id string, prediction string, terminated boolean").coalesce(1).write.mode("append").json(paths["in"])
    return records, paths


def first_of_each(spark, folder):
    """Predictions whose repeats are equal, so that the first of each is the same in any order of files."""
    return spark.read.schema(streaming.PREDICTIONS).json(folder).groupBy("qa_id").agg(F.min_by(F.struct("prediction", "terminated"), "prediction").alias("p")).select("qa_id", "p.*")


def stopped_at(monkeypatch, batch, before):
    """Makes the sink of one batch fail once, before or after it has written."""
    from pyspark.sql import DataFrameWriter

    real, calls = DataFrameWriter.parquet, []

    def parquet(self, path, *a, **k):
        if path.endswith(f"batch={batch}") and not calls:
            calls.append(1)
            if not before:
                real(self, path, *a, **k)
            raise RuntimeError("stopped")
        return real(self, path, *a, **k)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)


@pytest.mark.parametrize(("batch", "before"), [(0, True), (2, True), (3, False), (5, False)])
def test_totals_count_every_question_once_whatever_stops_a_batch(spark, folders, monkeypatch, batch, before):
    records, paths = folders
    with monkeypatch.context() as m:
        stopped_at(m, batch, before)
        with pytest.raises(Exception, match="stopped"):
            totals_stream(spark, records, paths["in"], paths["out"], paths["mark"], files=1).awaitTermination()
    totals_stream(spark, records, paths["in"], paths["out"], paths["mark"], files=1).awaitTermination()
    got = {r.task: (r.questions, r.units, r.valid) for r in current_totals(spark, paths["out"]).collect()}
    known = scoring.score(records, spark.read.schema(streaming.PREDICTIONS).json(paths["in"]).dropDuplicates(["qa_id"])).filter("error is null or error <> 'missing_prediction'")
    want = {r.task: (r.questions, r.units) for r in known.groupBy("task").agg(F.count("*").alias("questions"), F.sum("units").cast("long").alias("units")).collect()}
    assert {k: v[:2] for k, v in got.items()} == want and sum(v[0] for v in got.values()) == 30


def test_totals_equal_the_batch_after_restarts(spark, tmp_path):
    records = spark.createDataFrame([(f"q{i}", f"t{i % 3}", [float(i), 2.0], 0.2, "values", None, 8, 8) for i in range(30)], RECORDS)
    folder, out, mark = (f"file://{tmp_path}/{n}" for n in ("in", "out", "mark"))
    for k in range(3):
        rows = [(f"q{i}", f"[{i}, {2 + i % 2}]", i % 7 != 0) for i in range(10 * k, min(30, 10 * k + 14))]  # four of each file come again, equal
        spark.createDataFrame(rows, "qa_id string, prediction string, terminated boolean").coalesce(1).write.mode("append").json(folder)
        totals_stream(spark, records, folder, out, mark).awaitTermination()  # a new run each time: state comes from the checkpoint
    batch = scoring.score(records, spark.read.schema(streaming.PREDICTIONS).json(folder).dropDuplicates(["qa_id"]))
    want = {tuple(r) for r in batch.groupBy("task").agg(F.count("*"), F.sum("units"), F.sum("hits"), F.sum(F.col("valid").cast("long")), F.sum(F.col("all_correct").cast("long"))).collect()}
    assert {tuple(r) for r in current_totals(spark, out).select("task", "questions", "units", "hits", "valid", "all_correct").collect()} == want


def test_repeats_across_batches_are_no_rows_again(spark, folders):
    records, paths = folders
    score_stream(spark, records, paths["in"], paths["out"], paths["mark"], files=1).awaitTermination()
    rows = spark.read.parquet(paths["out"])
    assert rows.count() == rows.select("qa_id").distinct().count() == 30
