"""Every query of the engine, by name."""

from dataclasses import dataclass
from typing import Callable, Optional

from glyphgrid.plans import canvases, clusters, filters, fits, images, numbers, symbols


@dataclass(frozen=True)
class Entry:
    build: Callable
    sql: Optional[str] = None


def all_queries() -> dict:
    found = {**images.QUERIES, **numbers.QUERIES, **clusters.QUERIES, **filters.QUERIES, **canvases.QUERIES, **fits.QUERIES}
    return {name: Entry(q.frame, q.sql) for name, q in found.items()} | {name: Entry(*q) for name, q in symbols.QUERIES.items()}
