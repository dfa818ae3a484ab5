"""Named queries over the star schema, each with a plain-SQL twin where SQL can say it."""

from tabulith.queries import briefing, bundles, constraints, figures, ingest, provenance, quality, scalars, scenarios, totals  # noqa: F401
from tabulith.queries.registry import COVERS, ORACLES, QUERIES

__all__ = ["COVERS", "ORACLES", "QUERIES"]
