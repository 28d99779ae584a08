"""Imports the modules that register queries."""

from __future__ import annotations

import importlib

MODULES: tuple[str, ...] = ("q_text", "q_retrieval", "q_judging", "q_corpus", "q_tasks", "q_validation", "q_sources")


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"heronlake.plans.{m}")
