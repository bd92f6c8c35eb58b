"""All queries: importing this registers them."""

from plumbline.plans import calibrated, data_tier, decided, learned, naming, regimes, symbolic, system_tier, tasks  # noqa: F401
from plumbline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
