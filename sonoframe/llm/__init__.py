"""Operators for building training data, and their queries."""

import importlib
import pkgutil

from sonoframe.llm.common import ENTRIES

for _module in pkgutil.iter_modules(__path__):
    if _module.name.startswith("queries_"):
        importlib.import_module(f"{__name__}.{_module.name}")

__all__ = ["ENTRIES"]
