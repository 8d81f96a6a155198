"""All checked queries, by name."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from furrow.checks import registry

MODULES = ["catalogue", "samples", "pixels", "fields", "scores", "losses", "kernels", "shapes"]


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"furrow.checks.{name}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(registry.SQL)
