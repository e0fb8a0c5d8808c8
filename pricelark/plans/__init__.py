"""Registered queries and the SQL that checks each of them."""

from __future__ import annotations

import importlib

from pricelark.plans.registry import ORACLES, QUERIES

MODULES = ["alerting", "catalogue", "delivery", "text", "extraction", "streams", "stored", "details"]


def all_queries() -> tuple[dict, dict]:
    """(queries, checking SQL) of every plan module."""
    for name in MODULES:
        importlib.import_module(f"pricelark.plans.{name}")
    return QUERIES, ORACLES
