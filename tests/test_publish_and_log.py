"""Atomic month publication and the log of drift checks."""

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from ebbline.plans import ingestion
from ebbline.sources import decision_log, keyed_table, month_publish, store

PANEL = "customerID string, month int, mrr double, event string"


@pytest.fixture
def root(spark):
    return store.scratch_path(spark, "publish-test")


def _panel(spark, rows):
    return spark.createDataFrame([(c, m, v, "active") for c, m, v in rows], PANEL)


def _rows(spark, root, **more):
    found = month_publish.published_months(spark, root, **more)
    return sorted((r["customerID"], r["month"], r["mrr"]) for r in found.collect())


def test_two_runs_leave_one_copy(spark, root):
    rows = [("a", 1, 5.0), ("b", 1, 6.0), ("a", 2, 7.0)]
    assert _rows(spark, root) == []
    for _ in range(2):
        month_publish.publish_months(spark, root, _panel(spark, rows), run="1")
    assert _rows(spark, root) == sorted(rows)
    log = store.ingestion_history(spark, root).collect()
    assert [(r["detail"], r["rows_ingested"]) for r in log] == [
        ("month 1: 2 billing events", 2), ("month 2: 1 billing events", 1)]


def test_a_month_with_a_fault_stays_as_it_was(spark, root):
    month_publish.publish_months(spark, root, _panel(spark, [("a", m, 1.0) for m in range(1, 7)]))
    faulty = [
        ("a", 1, 2.0), ("a", 1, 3.0), (None, 2, 2.0), ("a", 3, -2.0), ("a", 4, None),
        ("a", 5, float("nan")), ("a", 6, 2.0), ("a", None, 2.0)]
    report = {r["month"]: r for r in month_publish.publish_months(spark, root, _panel(spark, faulty)).collect()}
    assert [m for m, r in report.items() if r["fit"]] == [6]
    assert report[1]["repeated"] == report[2]["without_customer"] == 1
    assert [report[m]["unsound_amount"] for m in (3, 4, 5)] == [1, 1, 1]
    assert _rows(spark, root) == [("a", m, 2.0 if m == 6 else 1.0) for m in range(1, 7)]


def test_nothing_fit_commits_nothing(spark, root):
    assert month_publish.publish_months(spark, root, _panel(spark, [])).count() == 0
    month_publish.publish_months(spark, root, _panel(spark, [(None, 1, 1.0)]))
    assert keyed_table.versions(spark, f"{root}/{month_publish.TABLE}") == []
    assert _rows(spark, root) == [] and store.ingestion_history(spark, root).count() == 0


def test_publishers_at_once_lose_nothing(spark, root, monkeypatch):
    whole, calls = keyed_table.commit, []

    def raced(spark, path, new):
        if not calls:
            calls.append(new.version)
            month_publish.publish_months(spark, root, _panel(spark, [("b", 2, 2.0)]))
        return whole(spark, path, new)

    monkeypatch.setattr(keyed_table, "commit", raced)
    month_publish.publish_months(spark, root, _panel(spark, [("a", 1, 1.0)]))
    assert _rows(spark, root) == [("a", 1, 1.0), ("b", 2, 2.0)]
    assert _rows(spark, root, version=1) == [("b", 2, 2.0)]


def test_only_wanted_months_are_read_and_old_ones_go(spark, root):
    rows = [("a", m, 1.0) for m in range(1, 5)]
    month_publish.publish_months(spark, root, _panel(spark, rows))
    month_publish.publish_months(spark, root, _panel(spark, [("a", 2, 9.0), ("a", None, 1.0)]))
    wanted = month_publish.published_months(spark, root, months=[2])
    assert len({f.rsplit("/", 1)[0] for f in wanted.inputFiles()}) == 1 and wanted.first()["mrr"] == 9.0
    assert month_publish.published_months(spark, root, months=[7]).count() == 0
    # The replaced month and the rows without one.
    assert month_publish.remove_unreferenced(spark, root, keep=1, older_than_ms=-1) == 2
    assert _rows(spark, root) == [("a", m, 9.0 if m == 2 else 1.0) for m in range(1, 5)]


def test_a_repeated_check_replaces_its_rows(spark, root):
    def report(*rows):
        return spark.createDataFrame(list(rows), "feature string, psi double, flag string")

    assert decision_log.logged_checks(spark, root).count() == 0
    calm = decision_log.log_check(spark, root, "2024-02", report(("x", 0.01, "stable"))).first()
    assert not calm["should_retrain"]
    decision_log.log_check(spark, root, "2024-01", report(("x", 0.2, "watch"), ("y", None, "skipped")))
    again = decision_log.log_check(spark, root, "2024-02", report(("x", 0.4, "alert"))).first()
    assert again["should_retrain"] and again["n_alert_features"] == 1
    rows = decision_log.logged_checks(spark, root).orderBy("check_id", "feature").collect()
    assert [(r["check_id"], r["check"], r["feature"], r["should_retrain"]) for r in rows] == [
        (1, "2024-01", "x", False), (1, "2024-01", "y", False), (2, "2024-02", "x", True)]
    assert rows[2]["checked_at"] == again["checked_at"]
    for name in ("", "a/b", "../up"):
        with pytest.raises(ValueError):
            decision_log.log_check(spark, root, name, report())


def test_checks_of_all_years_are_logged_once(spark):
    log = ingestion.drift_check_log(spark, SMALL)
    years = spark.read.parquet(f"{SMALL}/orders.parquet").where("o_orderdate >= '1999-08-01'").select(
        F.year("o_orderdate")).distinct().count()
    assert log.groupBy("check", "feature").count().where("count > 1").count() == 0
    assert log.select("check_id").distinct().count() == years
