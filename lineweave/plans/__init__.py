"""Named queries over the derived tables and their SQL counterparts."""

from lineweave.plans import columns, files, imagery, intake, junctions, lines, network, points, raster, scores, scoring, tracing, voting, windows  # noqa: F401
from lineweave.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
