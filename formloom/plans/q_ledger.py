"""Queries over the ledger, the audit log and session state."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.maps import merge_answers, read_session_start
from ..functions.predicates import is_success, is_terminal, is_uploaded
from ..operators import ledger as L
from ..operators.skew import numbered
from ..sources import tables as T
from ..sources.batches import LedgerStore
from ..sources.workdir import work_dir

SESSION = datetime(2024, 1, 15)
KEEP = ("id", "demographic_no", "status", "document_id")


def latest_by_hash(spark: SparkSession, d: str) -> DataFrame:
    return L.latest_by_hash(T.ledger(spark, d)).select("file_hash", *KEEP)


def incoming(spark: SparkSession, d: str) -> DataFrame:
    """New files; two in three repeat a content the ledger already holds."""
    return T.read(spark, d, "orders").select(
        F.col("o_orderkey").alias("incoming_id"),
        F.expr("md5(cast(concat('{\"k\": ', o_orderkey % 150, '}') as binary))").alias("file_hash"))


def resubmit_action(spark: SparkSession, d: str) -> DataFrame:
    j = L.existing_uploads(incoming(spark, d), T.ledger(spark, d))
    action = L.resubmit_action()
    return j.withColumn("action", action).select(
        "incoming_id", "action",
        F.when(F.col("action") != "process", F.col("p_id")).alias("prior_id"),
        F.when(F.col("action") != "process", L.kept_status(F.col("p_status"))).alias("status"),
        F.when(F.col("action") != "process", F.col("p_document_id")).alias("document_id"),
        F.when(F.col("action") == "skip", F.col("p_sheet_row")).alias("sheet_row"))


def latest_uploaded_person(spark: SparkSession, d: str) -> DataFrame:
    led = T.ledger(spark, d)
    return L.latest_uploaded_person(led.select("id", "demographic_no"), led, SESSION).select(
        "id", "demographic_no", F.col("prior.id").alias("prior_id"), F.col("prior.document_id").alias("document_id"),
        L.kept_status(F.col("prior.status")).alias("status"))


def completed_list(spark: SparkSession, d: str) -> DataFrame:
    return L.completed(T.ledger(spark, d), SESSION).select(*KEEP)


def session_unique_people(spark: SparkSession, d: str) -> DataFrame:
    led = T.ledger(spark, d)
    every = L.unique_people(led, SESSION).select(*KEEP, F.lit("all").alias("view"))
    missing = L.unique_people(led, SESSION, True).select(*KEEP, F.lit("signature_missing").alias("view"))
    return every.unionByName(missing)


def resumable_count(spark: SparkSession, d: str) -> DataFrame:
    return L.resumable_count(T.ledger(spark, d), SESSION)


def progress(spark: SparkSession, d: str) -> DataFrame:
    """Per intake day; signups are still in work."""
    led = T.ledger(spark, d).select(
        F.date_format("created_at", "yyyy-MM-dd").alias("day"),
        F.when(F.col("event_type") == "signup", "uploading").otherwise(F.col("status")).alias("status"))
    return L.progress(led, "day")


def audit_trail(spark: SparkSession, d: str) -> DataFrame:
    return L.audit_trail(T.audit_log(spark, d)).select(
        "record_id", "id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "actor", "event", "detail")


def status_rollup(spark: SparkSession, d: str) -> DataFrame:
    led = T.ledger(spark, d)
    s = F.col("status")
    return led.groupBy("status").agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(is_uploaded(F.col("document_id"))).alias("uploaded"),
        F.bool_and(is_terminal(s)).alias("terminal"),
        F.bool_and(is_success(s)).alias("success"))


def outcome_lines(spark: SparkSession, d: str) -> DataFrame:
    led = T.ledger(spark, d)
    name = F.concat_ws(", ", "last_name", "first_name")
    return led.select("id", L.outcome_line(
        F.when(F.col("id") % 5 == 0, "").otherwise(name), F.col("demographic_no"), F.col("status"),
        F.col("source_filename"), F.lit("no answer"), F.col("id") % 9 == 0).alias("line"))


def topk(spark: SparkSession, d: str) -> DataFrame:
    return L.newest_rows(T.ledger(spark, d)).select(*KEEP, "source_filename")


def versions(spark: SparkSession, d: str) -> DataFrame:
    """Every row as inserted, plus an update of every second one."""
    led = T.ledger(spark, d).select(
        "id", F.lit(1).alias("version"), F.lit("pending").alias("status"), "file_hash",
        F.when(F.col("id") % 2 == 0, "m").alias("message"), F.col("used_ocr").cast("int").alias("used_ocr"),
        F.col("signature_present").cast("int").alias("signature_present"), "event_type",
        F.col("status").alias("final"))
    upd = led.where("id % 2 = 0").selectExpr(
        "id", "2 as version", "final as status", "file_hash", "message", "used_ocr", "signature_present",
        "event_type", "final")
    return led.unionByName(upd).drop("final")


def current_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Inserts and updates appended to a store as two batches, and its view with row numbers."""
    every = versions(spark, d)
    store = LedgerStore(spark, work_dir(spark, "ledger"), every.schema)
    for batch in (0, 1):
        store.append(every.where(F.col("version") == batch + 1), batch)
    now = L.with_defaults(store.current(2))
    return numbered(now, "id", "sheet_row").select(
        "id", "version", "status", "message", "used_ocr", "signature_present", "sheet_row")


def collision_names(spark: SparkSession, d: str) -> DataFrame:
    """Target names of files that arrive under few different names."""
    name = F.expr("concat('f', length(url) % 7, if(page_id % 3 = 0, '.tar.gz', ''))").alias("name")
    p = T.read(spark, d, "pages").select("page_id", name)
    n = numbered(p, "page_id", "n", ["name"])
    return n.select("page_id", "name", L.collision_suffix(F.col("n") - 1, F.col("name")).alias("target"))


def map_merge(spark: SparkSession, d: str) -> DataFrame:
    """Answers from JSON, lower-cased, merged with a second source both ways."""
    e = T.read(spark, d, "events").select("event_id", "props", F.expr("concat(event_type, 'K')").alias("x"))
    a = F.from_json("props", "map<string,string>")
    e = e.select("event_id", a.alias("a"), F.expr("map('K', 'later', x, 'new')").alias("b"))
    later, first = merge_answers("a", "b"), merge_answers("b", "a")
    show = "array_join(transform(array_sort(map_entries({})), e -> concat(e.key, '=', e.value)), ';')"
    e = e.select("event_id", "a", later.alias("m1"), first.alias("m2"))
    return e.select(
        "event_id", F.expr(show.format("m1")).alias("later_wins"), F.expr(show.format("m2")).alias("first_wins"),
        F.expr("coalesce(try_element_at(a, 'missing'), '')").alias("missing"),
        F.expr("array_join(array_sort(map_keys(m1)), ' | ')").alias("keys"))


def session_state(spark: SparkSession, d: str) -> DataFrame:
    e = T.read(spark, d, "events").select("event_id", F.expr("""case event_id % 4
        when 0 then concat('{"session_start": "', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), '"}')
        when 1 then '{"session_start": ' when 2 then '{"other": 1}' else '{"session_start": "soon"}' end""")
        .alias("state"))
    return e.select("event_id", F.date_format(read_session_start(F.col("state")), "yyyy-MM-dd HH:mm:ss")
                    .alias("session_start"))


def set_ops(spark: SparkSession, d: str) -> DataFrame:
    """Distinct non-blank labels seen by either side, and where."""
    led = T.ledger(spark, d).select(F.coalesce("document_id", F.lit("")).alias("k"), F.lit(1).alias("src"))
    idx = T.charts(spark, d).select(F.concat_ws(":", "demographic_no", F.lit("Form")).alias("k"), F.lit(2).alias("src"))
    return led.unionByName(idx).where("k <> ''").groupBy("k").agg(
        F.bool_or(F.col("src") == 1).alias("in_ledger"), F.bool_or(F.col("src") == 2).alias("in_index"))


QUERIES = {
    "q_latest_by_hash": latest_by_hash,
    "q_resubmit_action": resubmit_action,
    "q_latest_uploaded_person": latest_uploaded_person,
    "q_completed_list": completed_list,
    "q_session_unique_people": session_unique_people,
    "q_resumable_count": resumable_count,
    "q_progress": progress,
    "q_audit_trail": audit_trail,
    "q_status_rollup": status_rollup,
    "q_outcome_lines": outcome_lines,
    "q_topk": topk,
    "q_current_ledger": current_ledger,
    "q_collision_names": collision_names,
    "q_map_merge": map_merge,
    "q_session_state": session_state,
    "q_set_ops": set_ops,
}
