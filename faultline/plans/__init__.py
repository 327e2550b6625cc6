"""Query bindings to the driver tables: ``QUERIES`` and ``ORACLES``.

Importing this package registers every query module.
"""

from . import accuracy, ingest, reports, search, sessions, streams, text  # noqa: F401, I001
from . import catalog  # noqa: F401  reuses the SQL of the others
from .registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
