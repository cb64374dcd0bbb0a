"""All queries of this library's own operators."""

from . import answers, models, pointwise, setwise, texts  # noqa: F401  they register themselves
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
