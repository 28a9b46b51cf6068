"""Helpers the operators of this package share with the core."""

from quarryline.operators.materialize import cut
from quarryline.sources import spread

__all__ = ["cut", "spread"]
