"""Streams give the batch result."""

from pyspark.sql import functions as F

from medloom.operators.longitudinal import upsert_daily
from medloom.streaming import ledger


def _run(spark, df, tmp_path, name):
    q = df.writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_daily_scores_keep_the_last_write(spark, tmp_path):
    rows = [("u1", "2024-01-02", 1, {"abhyanga": True}), ("u1", "2024-01-02", 2, {"abhyanga": True, "woke_before_6": True}), ("u2", "2024-01-03", 3, {"unknown": True})]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "user_id string, day string, id int, dinacharya map<string,boolean>").withColumn("written_at", F.expr("timestamp'2024-01-04 08:00:00' + make_interval(0, 0, 0, 0, 0, id, 0)")).withColumn("day", F.to_date("day")).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    got = {(r["user_id"], str(r["day"])): r["score"] for r in _run(spark, ledger.daily_scores(stream), tmp_path, "scores")}
    assert got == {("u1", "2024-01-02"): 25, ("u2", "2024-01-03"): 0}


def test_feedback_counts_add_up(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, {"cough": True, "fever": False}), (1, {"cough": False})], "condition_id int, answers map<string,boolean>").write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    got = {(r["condition_id"], r["symptom"]): (r["present"], r["asked"]) for r in _run(spark, ledger.feedback_cells(stream), tmp_path, "cells")}
    assert got == {(1, "cough"): (1, 2), (1, "fever"): (0, 1)}


def test_a_stream_in_any_order_equals_the_batch(spark, tmp_path):
    """Old history, refused writes and corrections, day by day in several orders of arrival."""
    yes = {"abhyanga": True}
    rows = [("u", "2024-01-01", "2024-01-01 09:00:00", 1, yes), ("u", "2024-01-01", "2024-01-03 09:00:00", 2, {}), ("u", "2023-06-01", "2023-06-02 09:00:00", 3, yes),
            ("u", "2024-03-01", "2024-03-01 09:00:00", 4, yes), ("u", "2023-12-01", "2024-03-01 09:00:00", 5, yes), ("u", "2024-03-05", "2024-03-01 09:00:00", 6, yes)]
    schema = "user_id string, day string, written_at string, id int, dinacharya map<string,boolean>"
    typed = lambda part: spark.createDataFrame(part, schema).withColumn("day", F.to_date("day")).withColumn("written_at", F.to_timestamp("written_at"))
    batch = upsert_daily(typed(rows))
    want = {(str(r["day"]), r["id"]) for r in batch.select("day", "id").collect()}
    assert want == {("2024-01-01", 2), ("2023-06-01", 3), ("2024-03-01", 4)}
    by_day = {d: 0 if i == 2 else 25 for d, i in want}
    points = {str(r["day"]): r["score"] for r in batch.select("day", ledger.routine_score(F.col("dinacharya")).alias("score")).collect()}
    for k, order in enumerate(([3, 4, 5, 1, 0, 2], [2, 1, 0, 5, 4, 3])):
        src = tmp_path / f"in{k}"
        for i in order:
            typed([rows[i]]).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(typed(rows).schema).option("maxFilesPerTrigger", 1).parquet(str(src))
        got = {}
        for r in _run(spark, ledger.daily_scores(stream), tmp_path, f"any{k}"):
            got[str(r["day"])] = r["score"]  # the last update of a day
        assert got == points and set(got) == set(by_day)
