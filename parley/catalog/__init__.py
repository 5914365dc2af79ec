"""All registered queries. Importing this package registers them."""

import importlib

from parley.catalog.registry import ORACLES, QUERIES

for _part in ("calls", "scores", "signals", "operations", "reports", "feeds", "sources", "streams", "hooks"):
    try:
        importlib.import_module(f"parley.catalog.{_part}")
    except ModuleNotFoundError as missing:
        if missing.name != f"parley.catalog.{_part}":
            raise

__all__ = ["ORACLES", "QUERIES"]
