"""Histories of patients: odd rows, hot patients, and what the reviewer sees."""

import datetime as dt

from medloom.operators import histories, longitudinal

ENCOUNTERS = ("id long, patient_id string, created_at timestamp, ritu string, status string, triage_level string, top_condition string, "
              "stopped boolean, vata double, pitta double, kapha double, ama string, agni string, extra int")


def _encounters(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    rows = [
        (1, "p", day(1), "hemanta", "reviewed", "routine", "A", False, 0.2, 0.3, 0.5, "high", "sama", 0),
        (2, "p", day(2), "hemanta", "reviewed", "routine", "B", False, 0.4, 0.3, 0.3, None, None, 0),
        (3, "p", day(3), "shishira", "draft", "urgent", "A", True, 0.9, 0.9, 0.9, "low", "manda", 0),
        (4, "q", day(4), None, None, None, None, False, None, None, None, None, None, 0),
        (5, None, day(5), "hemanta", "draft", "routine", "C", False, 0.1, 0.1, 0.8, None, "sama", 0),
    ]
    return spark.createDataFrame(rows, ENCOUNTERS)


def _labelled(spark):
    day = dt.datetime(2024, 2, 1)
    reviews = spark.createDataFrame([(1, 2, "confirmed", "A", day), (2, 1, "ruled_out", "Z", day)], "id long, encounter_id long, decision string, condition_id string, created_at timestamp")
    return longitudinal.encounter_labels(_encounters(spark), reviews)


def test_timeline_keeps_each_encounter(spark):
    rows = {r["encounter_id"]: r for r in histories.timeline(_labelled(spark)).collect()}
    assert len(rows) == 5
    assert (rows[2]["label"], rows[2]["confirmed"], rows[1]["label"], rows[1]["confirmed"]) == ("A", True, "A", False)
    assert rows[3]["vata"] is None and rows[3]["label"] == "A" and rows[4]["label"] is None and rows[5]["patient_id"] is None


def test_seasons_of_recurring_labels(spark):
    got = {(r["patient_id"], r["label"], r["ritu"], r["n"], r["episodes"], r["seasonal"]) for r in histories.season_counts(_labelled(spark)).collect()}
    assert got == {("p", "A", "hemanta", 2, 3, True), ("p", "A", "shishira", 1, 3, True)}
    assert histories.season_counts(_labelled(spark).limit(0)).count() == 0


def test_all_series_of_trends(spark):
    date = dt.date(2024, 1, 1)
    daily = spark.createDataFrame([("p", date, 40, {"vata": -1.0}), ("q", None, None, None)], "user_id string, day date, score int, dosha_effect map<string,double>")
    vitality = spark.createDataFrame([("p", "2024-01-07", 12)], "user_id string, at string, score int")
    got = {(r["user_id"], r["series"], r["measure"], r["value"], r["level"]) for r in histories.trends(_encounters(spark), daily, vitality).collect()}
    assert got == {
        ("p", "checkup", "vata", 0.2, None), ("p", "checkup", "pitta", 0.3, None), ("p", "checkup", "kapha", 0.5, None), ("p", "checkup", "ama", None, "high"),
        ("p", "checkup", "agni", None, "sama"), ("p", "checkup", "vata", 0.4, None), ("p", "checkup", "kapha", 0.3, None),
        (None, "checkup", "vata", 0.1, None), (None, "checkup", "pitta", 0.1, None), (None, "checkup", "kapha", 0.8, None), (None, "checkup", "agni", None, "sama"),
        ("p", "dinacharya", "score", 40.0, None), ("p", "dinacharya", "effect_vata", -1.0, None), ("p", "ojas", "score", 12.0, None)}


def test_dossier_shows_references_once(spark):
    visible = _encounters(spark).where("patient_id = 'p'")
    differential = spark.createDataFrame([(e, r, f"c{r}") for e in (1, 2, 9) for r in (1, 2, 9)], "encounter_id long, rank int, condition_id string")
    conditions = spark.createDataFrame([(f"c{i}", f"k{i % 2}") for i in range(10)], "condition_id string, evidence_key string")
    symptoms = spark.createDataFrame([("c1", "pain"), ("c9", "none")], "condition_id string, symptom string")
    literature = spark.createDataFrame([("k1", 7)], "evidence_key string, hits int")
    papers = spark.createDataFrame([("k1", t) for t in range(9)], "evidence_key string, year int")
    parts = {k: v.collect() for k, v in histories.dossier(visible, differential, conditions, symptoms, literature, papers, _labelled(spark), ["year"]).items()}
    assert sorted((r["encounter_id"], r["condition_id"]) for r in parts["cases"]) == [(1, "c1"), (1, "c2"), (2, "c1"), (2, "c2")]
    assert len(parts["history"]) == 3 and {r["condition_id"] for r in parts["references"]} == {"c1", "c2"}
    assert [r["symptom"] for r in parts["symptoms"]] == ["pain"] and [r["hits"] for r in parts["literature"]] == [7]
    assert sorted((r["position"], r["year"]) for r in parts["papers"]) == [(1, 8), (2, 7), (3, 6)]
    assert {r["ritu"] for r in parts["recurring"]} == {"hemanta", "shishira"}
