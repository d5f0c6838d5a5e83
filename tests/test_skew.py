"""The same queries when one customer and one user own a third of all rows."""

import shutil

import pytest
from compare import compare, connect
from conftest import SMALL

from ebbline.plans import catalog
from ebbline.sources.bridge import TABLES

CHECKED = [
    "overall_churn", "churn_by_payment_method", "mrr_snapshot", "mrr_series", "monthly_mrr",
    "customer_months", "revenue_concentration", "cohort_retention", "nrr_orders", "nrr_events",
    "nrr_by_contract", "panel_events", "survival_curves", "value_tiers", "value_kpis",
    "evaluate_score", "experiment_population", "split_by_order", "feature_drift_open",
    "store_upsert", "store_replay_months", "stream_billing",
]


@pytest.fixture(scope="module")
def skewed_dir(tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    for name in TABLES:
        if name not in ("orders", "events"):
            shutil.copy(f"{SMALL}/{name}.parquet", folder / f"{name}.parquet")
    con = connect(SMALL)
    con.execute(f"""COPY (SELECT * REPLACE (
        CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_custkey END AS o_custkey,
        CASE WHEN o_orderkey % 3 = 1 THEN 123456.78 ELSE o_totalprice END AS o_totalprice)
        FROM orders) TO '{folder}/orders.parquet'""")
    con.execute(f"""COPY (SELECT * REPLACE (
        CASE WHEN event_id % 3 = 0 THEN 1 ELSE user_id END AS user_id)
        FROM events) TO '{folder}/events.parquet'""")
    return str(folder)


@pytest.mark.parametrize("name", CHECKED)
def test_skewed(spark, skewed_dir, name):
    problem = compare(
        spark, connect(skewed_dir), name, catalog.QUERIES[name], catalog.ORACLES[name], skewed_dir
    )
    assert problem == ""
