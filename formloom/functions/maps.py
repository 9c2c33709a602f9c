"""Answer maps and small JSON state."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def merge_answers(old: str, new: str) -> Column:
    """Merge two answer maps with lower-case keys; the second one wins.

    Keys that differ only in case count as one; within a map the last one wins.
    """
    low = lambda m: f"transform(map_entries({m}), e -> struct(lower(e.key) as key, e.value as value))"
    every = f"concat({low(old)}, {low(new)})"
    return F.expr(f"""map_from_entries(transform(
      array_distinct(transform({every}, e -> e.key)),
      k -> struct(k as key, element_at(filter({every}, e -> e.key = k), -1).value as value)))""")


def answer(answers: str, *keys: str) -> Column:
    """First non-blank answer among alternative keys, else null."""
    from .text import sql_strip, sql_text

    parts = [f"nullif({sql_strip(f'try_element_at({answers}, {sql_text(k.strip())})')}, '')" for k in keys]
    return F.expr(f"coalesce({', '.join(parts)})")


def read_session_start(state: Column) -> Column:
    """Timestamp kept in a session-state JSON text; null on any defect."""
    return F.try_to_timestamp(F.get_json_object(state, "$.session_start"))
