"""All oracle SQL, by query name."""

import importlib

MODULES = ("matching", "text", "charts", "ledger", "sheet", "grid", "layout", "intake", "stream")


def registry() -> dict:
    out: dict = {}
    for m in MODULES:
        out.update(importlib.import_module(f"oracle.{m}").SQL)
    return out
