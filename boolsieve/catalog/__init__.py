"""Registered queries on the test tables, each with its SQL where SQL can express it."""

from boolsieve.catalog import derived, formats, learning, search, tables, text  # noqa: F401
from boolsieve.catalog.registry import ORACLE_SQL, QUERIES  # noqa: F401
