"""All catalogue queries.  Importing the parts registers them."""

from newsgrid.plans import (  # noqa: F401
    catalog_counts,
    catalog_incidents,
    catalog_ingest,
    catalog_pages,
    catalog_streams,
    catalog_text,
)
from newsgrid.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
