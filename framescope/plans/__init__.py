"""Registered queries over the given tables, each with its SQL counterpart."""

from __future__ import annotations

from importlib import import_module

MODULES = [
    "text_queries",
    "engine_queries",
    "history_queries",
    "corpus_queries",
    "training_queries",
    "streaming_queries",
]


def load_all() -> None:
    """Import every query module, which registers its queries."""
    for name in MODULES:
        import_module(f"framescope.plans.{name}")
