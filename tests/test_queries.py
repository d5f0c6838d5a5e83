"""Every registered query against the SQL that states the same result."""

import pytest
from compare import compare, connect
from conftest import SMALL

from ebbline.operators import churn_model
from ebbline.plans import catalog

@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.fixture
def few_trees(monkeypatch):
    """Boosted fits of few trees: the queries themselves take 300."""
    whole = churn_model.train_boosted
    monkeypatch.setattr(churn_model, "train_boosted", lambda train: whole(train, trees=3))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name, few_trees):
    problem = compare(spark, con, name, catalog.QUERIES[name], catalog.ORACLES.get(name), SMALL)
    assert problem == ""


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
