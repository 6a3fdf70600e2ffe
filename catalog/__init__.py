"""Queries over the given tables, one or more per operator, with their SQL counterparts."""

from catalog import evaluation, preparation, sequences  # noqa: F401
from catalog.base import ORACLES, QUERIES  # noqa: F401
