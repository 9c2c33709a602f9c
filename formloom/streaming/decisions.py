"""Operator decisions with a time-out and a safe default, as a stream join."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import DECISION_TIMEOUTS

# What stands when nobody decides in time.
DEFAULTS = {
    "review": "keep extracted values",
    "incomplete": "flag incomplete",
    "confirm": "decline",
    "select": "none",
    "email": "none",
}


def resolve(requests: DataFrame, decisions: DataFrame, delay: str = "10 minutes",
            timeouts: Mapping[str, int] = DECISION_TIMEOUTS, defaults: Mapping[str, str] = DEFAULTS) -> DataFrame:
    """Each request with the decision made in time, or the default.

    `requests`: form_id, kind, requested_at. `decisions`: form_id, kind,
    decided_at, value. The longest time-out bounds the join state; each kind's
    own time-out is checked on top. Late decisions are ignored. Works on two
    streams (defaults appear once the watermark passes) and on two tables.
    """
    limit = " ".join(f"when '{k}' then {s}" for k, s in timeouts.items())
    longest = max(timeouts.values())
    r = requests.select("form_id", "kind", "requested_at")
    d = decisions.select(F.col("form_id").alias("d_form"), F.col("kind").alias("d_kind"), "decided_at", "value")
    if requests.isStreaming:
        r, d = r.withWatermark("requested_at", delay), d.withWatermark("decided_at", delay)
    cond = F.expr(f"""form_id = d_form and kind = d_kind and decided_at >= requested_at
      and decided_at <= requested_at + interval {longest} seconds
      and decided_at <= requested_at + make_dt_interval(0, 0, 0, case kind {limit} else 0 end)""")
    standing = " ".join(f"when '{k}' then '{v}'" for k, v in defaults.items())
    return r.join(d, cond, "left_outer").selectExpr(
        "form_id", "kind", "requested_at", "value is not null as in_time",
        f"coalesce(value, case kind {standing} end) as value")


def with_decisions(forms: DataFrame, decisions: DataFrame, kinds: tuple[str, ...] = ("select", "incomplete"), at: str = "received_at",
                   delay: str = "10 minutes", timeouts: Mapping[str, int] = DECISION_TIMEOUTS) -> DataFrame:
    """Forms with <kind>_value for each kind: what was decided in time, else null, on which the default stands.

    `forms` holds form_id and the time `at` which it asks; `decisions` as in
    `resolve`. Of several decisions on one form and kind the first counts: in a
    table by time, in a stream by arrival. On streams a form leaves when it is
    decided or its time-out has passed; the joins run one after the other in one
    query, each with the state of its kind alone.
    """
    streaming = forms.isStreaming
    out = forms.withWatermark(at, delay) if streaming else forms
    for kind in kinds:
        d = decisions.where(F.col("kind") == kind).select(
            F.col("form_id").alias("_form"), F.col("decided_at").alias("_decided"), F.col("value").alias(f"{kind}_value"))
        out = out.alias("f")
        if streaming:
            d = d.withWatermark("_decided", delay)
        cond = F.expr(f"form_id = _form and _decided >= {at} and _decided <= {at} + interval {timeouts[kind]} seconds")
        if streaming:
            d = d.dropDuplicatesWithinWatermark(["_form"])
        out = out.join(d, cond, "left_outer")
        if not streaming:
            names = [c for c in out.columns if c not in ("_form", "_decided", f"{kind}_value")]
            first = out.groupBy("form_id").agg(F.min_by(f"{kind}_value", "_decided").alias(f"{kind}_value"))
            out = out.select(names).dropDuplicates(["form_id"]).join(first, "form_id")
        out = out.drop("_form", "_decided")
    return out
