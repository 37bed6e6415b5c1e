"""The registered queries of this subpackage, and SQL for those that DuckDB can express."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

for _name in ("q_classify", "q_decontaminate", "q_neardup", "q_pages", "q_search", "q_tokens"):
    _module = importlib.import_module(f"{__package__}.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
