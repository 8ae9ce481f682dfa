"""Collects every registered query."""

from __future__ import annotations

import importlib

from . import registry

MODULES = ["situation_queries", "cell_queries", "scoring_queries", "source_queries", "quality_queries", "context_queries", "shift_queries", "report_queries", "audit_queries", "stream_queries"]


def load():
    for name in MODULES:
        importlib.import_module(f"{__package__}.{name}")
    return registry
