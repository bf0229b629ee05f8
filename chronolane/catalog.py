"""Named queries over the driver tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from .plans import constraints, contracts, identity, intake, joins, market, metrics, projections, quality, revisions, scalars, splits, stats, stores, text, timing, validation  # noqa: F401  they register their queries
from .plans.registry import ORACLES, QUERIES, Query

FLAGSHIP = "movement_series"


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
