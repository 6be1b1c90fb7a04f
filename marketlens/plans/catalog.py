"""All registered queries."""

from marketlens.plans import (  # noqa: F401
    catalog_compare, catalog_lists, catalog_pages, catalog_prices, catalog_streams, catalog_text)
from marketlens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
