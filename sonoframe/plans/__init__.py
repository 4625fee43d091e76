"""Queries over the driver tables."""

import importlib
import pkgutil

from sonoframe.plans.registry import ENTRIES

for _module in pkgutil.iter_modules(__path__):
    if _module.name.startswith("queries_"):
        importlib.import_module(f"{__name__}.{_module.name}")

__all__ = ["ENTRIES"]
