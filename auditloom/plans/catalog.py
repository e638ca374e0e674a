"""All named queries over the driver's tables and their SQL."""

from __future__ import annotations

from auditloom.plans import core, detection, graphs, logs, sources_memory  # noqa: F401
from auditloom.plans.registry import ORACLE, QUERIES  # noqa: F401
