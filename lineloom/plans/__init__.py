"""Registered queries: each module adds its own to the tables of catalog."""

from . import analysis, catalog, filled, more, projects, shops, stores, versions  # noqa: F401
