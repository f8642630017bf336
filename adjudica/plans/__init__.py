"""Registered queries, one module per family of operators."""

from __future__ import annotations

import importlib

MODULES = (
    "q_sources", "q_convert", "q_sampling", "q_augment", "q_rules", "q_teacher", "q_requests", "q_answers",
    "q_calibrate", "q_metrics", "q_compare", "q_rollouts", "q_scoring", "q_streaming",
)


def load():
    """Import every query module -> (queries, SQL equivalents)."""
    for m in MODULES:
        importlib.import_module(f"adjudica.plans.{m}")
    from adjudica.plans import registry

    return registry.QUERIES, registry.SQL
