"""Named queries over the given tables, one module per operator family."""

from trajstats.plans.registry import QUERIES
from trajstats.plans import diffusion_plans, fit_plans, lag_plans, rollup_plans, scan_plans, series_plans, space_plans, stream_plans

__all__ = ["QUERIES"]
