"""Importing this module registers every query."""

from mastline_queries import serving, tables, warehouse  # noqa: F401
