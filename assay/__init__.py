"""Data-quality analysis of tables of any size on Spark."""

from .plans.analyze import Report, analyze, analyze_tables, fleet
from .settings import DEFAULTS, Settings

__all__ = ["DEFAULTS", "Report", "Settings", "analyze", "analyze_tables", "fleet"]
