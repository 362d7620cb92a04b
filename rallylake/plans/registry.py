"""All queries on the driver's tables, with the DuckDB SQL that must return the same rows."""

from __future__ import annotations

from rallylake.plans import archive, jobs, metering, movement, relational, scalars, streams, texts  # noqa: F401  the modules register their queries
from rallylake.plans.base import ORACLES, QUERIES  # noqa: F401
