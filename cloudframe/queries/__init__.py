"""Registered queries: every operator on the given tables, with a SQL twin where SQL can express it.

Importing this package fills ``cloudframe.registry``.
"""

import importlib
import pkgutil

for _module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
    importlib.import_module(f"{__name__}.{_module}")
