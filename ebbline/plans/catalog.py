"""All registered queries."""

from ebbline.plans import (  # noqa: F401
    ingestion,
    judgement,
    lifetimes,
    metrics,
    models,
    preparation,
    retention,
)
from ebbline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
