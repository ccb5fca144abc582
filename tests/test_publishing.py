"""Snapshots are published whole; the package reaches the workers from any folder; evidence is voted on."""

import os
import subprocess
import sys

import fixtures
from conftest import ROOT
from pyspark.sql import functions as F

from medloom.operators import association
from medloom.sources import sinks


def test_snapshots_swap_by_one_manifest(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    a, b = spark.range(5).withColumn("x", F.lit("a")), spark.range(3).withColumn("x", F.lit("b"))
    first, same = sinks.publish({"t": a, "u": b}, root)
    at = sinks.published(spark, root)
    assert not same and at.endswith(first) and spark.read.parquet(f"{at}/t").count() == 5
    second, _ = sinks.publish({"t": b, "u": b}, root)
    assert second != first and spark.read.parquet(f"{sinks.published(spark, root)}/t").count() == 3
    assert spark.read.parquet(f"{root}/{first}/t").count() == 5  # a reader of the old snapshot goes on
    before = os.path.getmtime(tmp_path / "store" / first / "t")
    again, known = sinks.publish({"t": a.repartition(3), "u": b}, root, spark.createDataFrame([(first,)], "content_id string"))
    assert again == first and known and os.path.getmtime(tmp_path / "store" / first / "t") == before


def test_an_interrupted_snapshot_is_written_anew(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    t = spark.range(4)
    ident = sinks.content_id({"t": t})
    spark.range(1).write.parquet(f"{root}/{ident}/t")
    assert sinks.publish({"t": t}, root)[0] == ident and spark.read.parquet(f"{sinks.published(spark, root)}/t").count() == 4


def test_workers_find_the_package_from_a_foreign_folder(tmp_path):
    code = """
import sys
sys.path.insert(0, sys.argv[1])
from medloom.session import build_session
spark = build_session("foreign", "local[2]", **{"spark.ui.enabled": "false", "spark.driver.bindAddress": "127.0.0.1", "spark.driver.host": "127.0.0.1"})
def names(batches):
    import medloom.functions.text
    yield from batches
print("rows", spark.range(3).mapInArrow(names, "id long").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code, ROOT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "rows 3" in done.stdout, done.stderr[-2000:]


def test_discovery_confirms_the_planted_drivers(spark):
    df = spark.createDataFrame(fixtures.cohort_rows(), "id int, age int, family string, exercise string, routine string, sleep double, outcome int")
    found = association.discover(df, ["family", "exercise"], ["age", "sleep"], "outcome", "id", reps=40, folds=2, repeats=2)
    table = {r["variable"]: r for r in found.collect()}
    assert {v for v, r in table.items() if r["evidence_tier"] != "not supported"} == {"age", "family"}
    assert table["age"]["consensus_rank"] == 1
