"""Every operator and report by name, over the driver's tables."""

from slotwise.registry import alerts, columns, reports, streams, tables  # noqa: F401 - fill QUERIES
from slotwise.registry.base import AS_OF, DAYS, QUERIES

__all__ = ["AS_OF", "DAYS", "QUERIES"]
