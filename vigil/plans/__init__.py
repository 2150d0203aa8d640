"""Registered queries by area; each maps a name to (query, equivalent SQL or None)."""

from __future__ import annotations

import importlib

AREAS = ["detection", "slo", "features", "classify", "drift", "text", "stream", "models", "incident_model"]


def registry() -> dict:
    found: dict = {}
    for area in AREAS:
        found.update(importlib.import_module(f"vigil.plans.{area}").QUERIES)
    return found
