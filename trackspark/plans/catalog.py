"""All registered queries: name -> (Spark callable, SQL twin or None)."""

from __future__ import annotations

import importlib

_MODULES = [
    "scan_queries",
    "dataset_queries",
    "track_queries",
    "mask_queries",
    "eval_queries",
    "report_queries",
    "io_queries",
]

QUERIES: dict = {}
for _name in _MODULES:
    QUERIES.update(importlib.import_module(f"trackspark.plans.{_name}").QUERIES)
