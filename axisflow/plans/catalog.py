"""All queries and their SQL; importing the modules registers them."""

from . import arrays, axes, data, registry, signals
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "arrays", "axes", "data", "registry", "signals"]
