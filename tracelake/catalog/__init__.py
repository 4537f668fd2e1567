"""All registered queries and the SQL they are checked against."""

from . import data, explaining, policy, serving, streams  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
