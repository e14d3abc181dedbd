"""Every registered query of the motion engine, with its oracle SQL where SQL can express it."""

from __future__ import annotations

from motionframe.plans import bodies, clocks, folders, formulas, matching, motion, project, rays, series, surfaces  # noqa: F401  registers its queries

FLAGSHIP = "triangulate"
QUERIES = motion.QUERIES
ORACLE = motion.ORACLE
