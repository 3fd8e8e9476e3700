"""All named queries; importing the modules registers them."""

from aisleframe.plans import q_features, q_market, q_matching, q_models, q_tables  # noqa: F401
from aisleframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
