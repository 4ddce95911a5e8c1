"""All registered queries; importing a module registers its entries."""

from __future__ import annotations

import importlib
import pkgutil

import fieldglass.catalog as package
from fieldglass.catalog.registry import oracle_sql, queries  # noqa: F401

for _module in pkgutil.iter_modules(package.__path__):
    if _module.name.startswith("queries_"):
        importlib.import_module(f"fieldglass.catalog.{_module.name}")
