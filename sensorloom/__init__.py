"""Quality control of large sensor time-series collections on PySpark."""

from sensorloom.session import configure

__all__ = ["configure"]
