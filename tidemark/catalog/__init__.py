"""Registered queries; ``load()`` imports every area once."""

from __future__ import annotations

import importlib
import pkgutil


def load():
    from tidemark.catalog import registry

    for module in pkgutil.iter_modules(__path__):
        if module.name.endswith("_queries"):
            importlib.import_module(f"{__name__}.{module.name}")
    return registry.QUERIES, registry.ORACLES
