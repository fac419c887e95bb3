"""Every registered query with the SQL it is checked against."""

from __future__ import annotations

import importlib

MODULES = ("sources_columns", "joins_aggregates", "sequence", "tests_models", "questions_quality")


def _collect(attribute: str) -> dict:
    merged: dict = {}
    for name in MODULES:
        try:
            module = importlib.import_module(f"eddyline.catalog.{name}")
        except ModuleNotFoundError:
            continue
        merged.update(getattr(module, attribute))
    return merged


def queries() -> dict:
    return _collect("QUERIES")


def oracles() -> dict[str, str]:
    return _collect("ORACLES")
