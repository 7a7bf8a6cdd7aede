"""Named queries over the test tables, with independent SQL for checking."""

from __future__ import annotations

import importlib

SECTIONS = ["occupancy", "sequences", "places", "detection", "records", "live"]


def load():
    """Import every section and return the registry."""
    for section in SECTIONS:
        importlib.import_module(f"bandwatch.catalog.{section}")
    return importlib.import_module("bandwatch.catalog.registry")
