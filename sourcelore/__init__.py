"""Source-history analytics on Spark: DataFrames of files and commits in, DataFrames of answers out."""

from .plans.analysis import Analysis, analyze
from .plans.reports import architecture_map, onboarding, risk_report

__all__ = ["Analysis", "analyze", "architecture_map", "onboarding", "risk_report"]
