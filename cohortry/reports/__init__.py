"""Every operator as a query over the given tables, next to the SQL it must agree with."""

from cohortry.reports import (  # noqa: F401  (importing registers the reports)
    banding,
    changing,
    dates_and_text,
    joining,
    layouts,
    ranking,
    shares,
    streams,
    study,
    writing,
)
from cohortry.reports.registry import REPORTS, Report

__all__ = ["REPORTS", "Report"]
