"""The query catalogue: each entry runs one operator, or a composition, over the driver's tables."""

from __future__ import annotations

from seqloom.plans import core, derived, files, positional, rest

QUERIES = core.QUERIES | positional.QUERIES | rest.QUERIES | files.QUERIES | derived.QUERIES
ORACLE = core.ORACLE | positional.ORACLE | rest.ORACLE | files.ORACLE | derived.ORACLE
