"""All registered queries."""

from ticketlens.catalog import evaluation, models, rows, tables, text  # noqa: F401  (importing registers)
from ticketlens.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
