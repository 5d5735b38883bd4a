"""All registered queries, by area."""

from __future__ import annotations

import importlib

AREAS = ["retrieval", "text", "documents", "questions", "evidence", "reporting", "flows"]


def load():
    from folioground.registry import base
    for area in AREAS:
        importlib.import_module(f"folioground.registry.{area}")
    return base.QUERIES, base.ORACLES
