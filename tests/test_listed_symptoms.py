"""The knowledge base's stand-in is made once, however often a query reads it."""

from conftest import SF_DIR

from medloom.plans import standins


def test_the_listed_symptoms_are_read_from_a_written_table(spark):
    plan = standins.bridge(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "lineitem" not in plan
