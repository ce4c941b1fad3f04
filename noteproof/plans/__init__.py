"""Registered queries, by subject."""

from __future__ import annotations

import importlib

MODULES = ("scores", "series", "evidence", "texts", "verdicts", "reading", "releases", "mutants")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
