"""The registered queries, one per operator, each over the given tables."""

from __future__ import annotations

from fieldgauge.plans.queries.registry import SQL, TABLE

from fieldgauge.plans.queries import (  # noqa: F401  (registration by import)
    basis,
    boot,
    codec,
    decide,
    gates,
    learn,
    metrics,
    pairing,
    replay,
    roles,
    select,
    sources,
    trace,
)

__all__ = ["SQL", "TABLE"]
