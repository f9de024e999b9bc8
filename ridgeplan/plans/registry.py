"""All planning queries and their SQL."""

from __future__ import annotations

from ridgeplan.plans import design, files, graphs, planner, relational, visibility

QUERIES = {**relational.QUERIES, **visibility.QUERIES, **graphs.QUERIES, **design.QUERIES, **files.QUERIES, **planner.QUERIES}
ORACLE = {**relational.ORACLE, **visibility.ORACLE, **graphs.ORACLE, **design.ORACLE, **files.ORACLE, **planner.ORACLE}
