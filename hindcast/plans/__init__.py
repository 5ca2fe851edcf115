"""The registered queries, by subject."""

from . import feature_queries, group_queries, late_queries, measure_queries, point_in_time, ruling, service_queries, whole_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
