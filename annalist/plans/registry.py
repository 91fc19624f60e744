"""All registered queries."""

from __future__ import annotations

from . import chunks, ingest, measure, network, search, text
from .shared import Catalog

CATALOG = Catalog()
for module in (text, chunks, search, measure, network, ingest):
    CATALOG.queries.update(module.catalog.queries)
    CATALOG.sql.update(module.catalog.sql)
