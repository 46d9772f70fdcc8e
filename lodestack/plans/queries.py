"""All registered queries."""

from . import audits, cohorts, findings, records, releases, reports, sources, volumes  # noqa: F401
from .registry import QUERIES  # noqa: F401
