"""Imports every query module, so that the registry is full."""

from footreach.plans import access, feature_table, histories, models, quality, stars, tables  # noqa: F401
from footreach.plans.registry import COVERS, ORACLES, QUERIES  # noqa: F401
