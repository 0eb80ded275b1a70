"""Every operator run on the supplied tables, with SQL for the same answer."""

from rowloom.queries import analysis, columns, models, rows, storage  # noqa: F401
from rowloom.queries.book import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
