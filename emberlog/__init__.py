"""Event-log analytics on Spark."""

from emberlog.analyzer import EventLogs

__all__ = ["EventLogs"]
