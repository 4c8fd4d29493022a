"""Every query of the library by name, and its SQL."""

from __future__ import annotations

from . import contracts, documents, labels, layout, library, ordered, packing, pages, progress, records, scalar, trees
from .registry import QUERIES, SQL

MODULES = (contracts, documents, labels, layout, library, ordered, packing, pages, progress, records, scalar, trees)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
