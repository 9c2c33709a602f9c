"""The registry of queries: name -> function(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import importlib

MODULES = ("q_matching", "q_text", "q_charts", "q_ledger", "q_sheet", "q_grid", "q_layout", "q_intake", "q_extracted", "q_stream")


def registry() -> dict:
    out: dict = {}
    for m in MODULES:
        out.update(importlib.import_module(f"formloom.plans.{m}").QUERIES)
    return out
