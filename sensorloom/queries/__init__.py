"""Queries over the driver tables, one per operator of the inventory."""

from sensorloom.queries.registry import REGISTRY, load_all

__all__ = ["REGISTRY", "load_all"]
