"""Registered queries and their DuckDB counterparts."""

from __future__ import annotations

import importlib

MODULES = ["source_queries", "text_queries", "retrieval_queries", "outline_queries", "plan_queries", "stream_queries"]


def collect(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        for key, value in getattr(importlib.import_module(f"coursemine.catalog.{module}"), name).items():
            if key in out:
                raise ValueError(f"query {key} registered twice")
            out[key] = value
    return out
