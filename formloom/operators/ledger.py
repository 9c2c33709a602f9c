"""Ledger queries: latest rows, duplicates, lists, sessions, counts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import LIST_LIMIT
from ..functions.predicates import is_listed, is_success, is_terminal, is_uploaded
from .skew import newest_per_key, resharded_join


def current_view(versions: DataFrame) -> DataFrame:
    """The ledger as it stands: the newest version of every row."""
    return newest_per_key(versions, ["id"], "version")


def latest_versions(kept: DataFrame, tail: DataFrame) -> DataFrame:
    """The ledger as it stands, from rows that stood and versions appended since; only the latter are ranked."""
    new = current_view(tail)
    return kept.join(new.select("id"), "id", "left_anti").select(*new.columns).unionByName(new)


def with_defaults(rows: DataFrame) -> DataFrame:
    """Null-tolerant reading of stored rows: blanks, unknowns, nullable flags."""
    blank = {"stored_path", "message", "file_hash"}
    out = []
    for c in rows.columns:
        if c in blank:
            out.append(F.coalesce(c, F.lit("")).alias(c))
        elif c in ("form_type", "doc_kind"):
            out.append(F.coalesce(c, F.lit("unknown")).alias(c))
        elif c == "used_ocr":
            out.append(F.coalesce(F.col(c).cast("boolean"), F.lit(False)).alias(c))
        elif c == "signature_present":
            out.append(F.col(c).cast("boolean").alias(c))
        else:
            out.append(F.col(c))
    return rows.select(*out)


def new_version(current: DataFrame, changes: DataFrame, now: datetime) -> DataFrame:
    """Rows to append for an update by id; updating an unknown id is an error."""
    fields = [c for c in changes.columns if c != "id"]
    new = changes.select("id", *[F.col(c).alias(f"_n_{c}") for c in fields])
    joined = new.join(current.withColumn("_known", F.lit(True)), "id", "left")
    known = F.when(F.col("_known"), F.col("id")).otherwise(
        F.raise_error(F.concat(F.lit("no ledger row "), F.coalesce(F.col("id").cast("string"), F.lit("null")))))
    out = []
    for c in current.columns:
        if c == "id":
            out.append(known.alias("id"))
        elif c == "version":
            out.append((F.col("version") + 1).alias("version"))
        elif c == "updated_at":
            out.append(F.date_trunc("second", F.lit(now)).alias("updated_at"))
        else:
            out.append(F.col(f"_n_{c}").alias(c) if c in fields else F.col(c))
    return joined.select(*out)


def latest_by_hash(ledger: DataFrame) -> DataFrame:
    return newest_per_key(ledger.where("file_hash is not null"), ["file_hash"], "id")


def existing_uploads(incoming: DataFrame, ledger: DataFrame) -> DataFrame:
    """Incoming files with the newest ledger row of the same content, if any.

    Prior columns get the prefix p_. Only a prior with a document id counts.
    """
    prior = latest_by_hash(ledger)
    prior = prior.select("file_hash", *[F.col(c).alias(f"p_{c}") for c in
                                        ("id", "status", "document_id", "sheet_row", "demographic_no",
                                         "signature_present", "email")])
    return resharded_join(incoming, prior, ["file_hash"], "left")


def resubmit_action() -> Column:
    """process a new file, add the missing sheet row, or skip a finished one."""
    return F.when(~is_uploaded(F.col("p_document_id")), "process").when(
        F.col("p_sheet_row").isNull(), "add_row").otherwise("skip")


def kept_status(prior: Column) -> Column:
    """A re-submission keeps an earlier success status, else it is completed."""
    return F.when(is_success(prior), prior).otherwise("completed")


def latest_uploaded_person(requests: DataFrame, ledger: DataFrame, since: datetime) -> DataFrame:
    """For each (id, demographic_no) the newest other uploaded row of the person.

    Only the two newest rows per person are kept before joining: one of them is
    never the asking row itself.
    """
    up = ledger.where(is_uploaded(F.col("document_id")) & (F.col("created_at") >= F.lit(since))).where(
        "coalesce(demographic_no, '') <> ''")
    w = Window.partitionBy("demographic_no").orderBy(F.col("id").desc())
    top = up.select("demographic_no", "id", "document_id", "sheet_row", "status",
                    F.row_number().over(w).alias("rn")).where("rn <= 2")
    pairs = top.groupBy("demographic_no").agg(
        F.expr("sort_array(collect_list(struct(id, document_id, sheet_row, status)), false)").alias("newest"))
    j = resharded_join(requests.where("coalesce(demographic_no, '') <> ''"), pairs, ["demographic_no"])
    return j.withColumn("prior", F.expr("get(filter(newest, n -> n.id <> id), 0)")).where(
        "prior is not null").drop("newest")


def newest_rows(ledger: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    """The newest rows; the number of rows is what is asked for."""
    return ledger.orderBy(F.col("id").desc()).limit(limit)


def completed(ledger: DataFrame, since: datetime | None = None) -> DataFrame:
    rows = ledger.where(is_listed(F.col("status")))
    return rows if since is None else rows.where(F.col("created_at") >= F.lit(since))


def unique_people(ledger: DataFrame, since: datetime, signature_missing_only: bool = False) -> DataFrame:
    """Completed rows of a session, each person once; unlinked rows all stay."""
    rows = completed(ledger, since)
    if signature_missing_only:
        rows = rows.where("status = 'completed_no_signature'")
    linked = F.coalesce("demographic_no", F.lit("")) != ""
    return newest_per_key(rows.where(linked), ["demographic_no"], "id").unionByName(rows.where(~linked))


def resumable_count(ledger: DataFrame, since: datetime) -> DataFrame:
    return completed(ledger, since).agg(F.count(F.lit(1)).alias("resumable"))


def progress(ledger: DataFrame, *by: str) -> DataFrame:
    done = F.count_if(is_terminal(F.col("status")))
    total = F.count(F.lit(1))
    return ledger.groupBy(*by).agg(total.alias("total"), done.alias("done")).withColumn(
        "label",
        F.when(F.col("done") >= F.col("total"), F.format_string("Done, processed %d file(s)", "total"))
        .otherwise(F.format_string("Processing %d of %d", F.least(F.col("done") + 1, F.col("total")), "total")))


def failed_again(ledger: DataFrame) -> DataFrame:
    """Rows to feed into the next run: those whose newest version failed."""
    rows = newest_per_key(ledger, ["id"], "version") if "version" in ledger.columns else ledger
    return rows.where("status = 'error'")


def audit_trail(audit: DataFrame, record_id: int | None = None) -> DataFrame:
    """Events in order, for one record or for all (a range sort, no window)."""
    rows = audit if record_id is None else audit.where(F.col("record_id") == record_id)
    return rows.orderBy("record_id", "id")


def outcome_line(name: Column, number: Column, status: Column, file: Column, message: Column,
                 skipped: Column) -> Column:
    """One plain sentence per record for the activity log."""
    label = F.coalesce(F.nullif(name, F.lit("")), file)
    who = F.when(F.coalesce(number, F.lit("")) != "", F.concat(label, F.lit(" (#"), number, F.lit(")"))).otherwise(label)
    say = lambda head, tail: F.concat(head, F.lit(tail))
    return (
        F.when(skipped, say(who, ": already handled in this session, skipped"))
        .when(status == "completed", say(who, ": filed and added to the sheet"))
        .when(status == "completed_no_signature", say(who, ": filed, signature missing, reminder ready"))
        .when(status == "incomplete_informed", say(who, ": filed as incomplete, reminder ready"))
        .when(status == "not_found", say(file, ": nobody found, nothing filed"))
        .when(status == "error", F.concat(file, F.lit(": could not finish: "), message))
        .otherwise(F.concat(who, F.lit(": "), status))
    )


def collision_suffix(position: Column, name: Column) -> Column:
    """`a.pdf`, `a__1.pdf`, `a__2.pdf` from the zero-based arrival position."""
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    return F.when(position == 0, name).otherwise(
        F.concat(stem, F.lit("__"), position.cast("string"), ext))
