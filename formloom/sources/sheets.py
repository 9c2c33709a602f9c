"""Configurable output sheets: column specs, leak guard, and the sinks.

A sheet is one projection. Column specs are checked while the plan is built, so
a typo fails before any data is read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import age_years
from ..functions.maps import answer
from ..functions.predicates import leaks_name
from ..functions.text import full_name, region_name, yes_no
from ..operators.skew import numbered
from .batches import Running, found, write_batch
from .workdir import staged

Resolver = Callable[[datetime], Column]


def _text(name: str) -> Resolver:
    return lambda now: F.coalesce(F.col(name).cast("string"), F.lit(""))


# Field key -> function of the run's time giving a text column.
FIELDS: dict[str, Resolver] = {
    "blank": lambda now: F.lit(""),
    "date": lambda now: F.lit(now.date().isoformat()),
    "datetime": lambda now: F.lit(now.isoformat(timespec="seconds")),
    "full_name": lambda now: full_name(F.col("first_name"), F.col("last_name")),
    "age": lambda now: age_years(F.col("dob"), now.date()),
    "province": lambda now: region_name(F.col("province")),
    "signature": lambda now: yes_no(F.col("signature_present")),
    "referral_source": lambda now: F.expr("coalesce(try_element_at(answers, 'referral_source'), '')"),
    **{k: _text(k) for k in (
        "demographic_no", "email", "first_name", "last_name", "dob", "phone", "health_card", "pronoun",
        "program_status", "form_type", "status", "document_id", "source_filename")},
}

# Fixed default schema: (header, field key).
DEFAULT_COLUMNS: tuple[tuple[str, str], ...] = (
    ("Date Processed", "datetime"),
    ("Demographic No", "demographic_no"),
    ("Last Name", "last_name"),
    ("First Name", "first_name"),
    ("Email", "email"),
    ("DOB", "dob"),
    ("Form Type", "form_type"),
    ("Signature", "signature"),
    ("Status", "status"),
    ("Document ID", "document_id"),
    ("Source File", "source_filename"),
)

# Fixed name-free log schema.
LOG_COLUMNS: tuple[tuple[str, str], ...] = (
    ("Timestamp", "datetime"),
    ("Demographic No", "demographic_no"),
    ("Email", "email"),
    ("Form Type", "form_type"),
    ("Document Kind", "doc_kind"),
    ("Used OCR", "used_ocr"),
    ("Signature Present", "signature"),
    ("Status", "status"),
    ("Document ID", "document_id"),
    ("Source Filename", "source_filename"),
)


def register_field(key: str, resolver: Resolver) -> None:
    """Make a further field available to column specs."""
    FIELDS[key] = resolver


def parse_columns(raw) -> tuple[tuple[str, str], ...]:
    """(header, field) pairs from strings, {header, field} or one-key mappings."""
    out = []
    for entry in raw or ():
        if isinstance(entry, str):
            out.append((entry, entry))
        elif isinstance(entry, dict) and {"header", "field"} <= entry.keys():
            out.append((str(entry["header"]), str(entry["field"])))
        elif isinstance(entry, dict) and len(entry) == 1:
            out.extend((str(h), str(f)) for h, f in entry.items())
        elif isinstance(entry, tuple) and len(entry) == 2:
            out.append((str(entry[0]), str(entry[1])))
        else:
            raise ValueError(f"invalid column entry: {entry!r}")
    return tuple(out)


def placeholder_for(key: str, placeholder: str) -> str:
    """Spacers and referral answers stay blank; all else gets the placeholder."""
    return "" if key == "blank" or key.startswith("form:referral") else placeholder


def as_text(c: Column) -> Column:
    """`="value"`, which spreadsheets keep as text; blanks stay blank."""
    return F.when(c == "", c).otherwise(F.concat(F.lit('="'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')))


def sheet(records: DataFrame, now: datetime, columns: Sequence = DEFAULT_COLUMNS, placeholder: str = "",
          force_text: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """Project records onto a column spec. `keep` passes columns through."""
    spec = parse_columns(columns) or DEFAULT_COLUMNS
    unknown = [f for _, f in spec if not f.startswith("form:") and f not in FIELDS]
    if unknown:
        raise ValueError(f"unknown sheet field {unknown[0]!r}; use one of {', '.join(sorted(FIELDS))} or form:<key>")
    out = []
    for header, key in spec:
        if key.startswith("form:"):
            value = F.coalesce(answer("answers", *key[5:].split("|")), F.lit(""))
        else:
            value = FIELDS[key](now)
        ph = placeholder_for(key, placeholder)
        if ph:
            value = F.when(value == "", ph).otherwise(value)
        out.append((as_text(value) if force_text else value).alias(header))
    return records.select(*keep, *out)


def safe_log(records: DataFrame, now: datetime, keep: Sequence[str] = ()) -> DataFrame:
    """The name-free log row of each record, with a `leaks` flag.

    The flag is a substring test of both names over every cell; rows that carry
    it must go to quarantine, not to the log.
    """
    cells = [
        F.when(F.col("used_ocr"), "Yes").otherwise("No").alias(h) if k == "used_ocr"
        else (F.coalesce("doc_kind", F.lit("")) if k == "doc_kind" else FIELDS[k](now)).alias(h)
        for h, k in LOG_COLUMNS
    ]
    rows = records.select(*keep, F.col("first_name").alias("_f"), F.col("last_name").alias("_l"), *cells)
    flag = leaks_name([F.col(f"`{h}`") for h, _ in LOG_COLUMNS], F.col("_f"), F.col("_l"))
    return rows.withColumn("leaks", flag).drop("_f", "_l")


def refuse_leaks(log: DataFrame) -> DataFrame:
    """Strict mode: fail the write if any row carries a name."""
    return log.withColumn("leaks", F.when(F.col("leaks"), F.raise_error(F.lit("a name would leave the ledger")))
                          .otherwise(False)).where("not leaks").drop("leaks")


def with_row_numbers(rows: DataFrame, order: str, existing: int = 0) -> DataFrame:
    """1-based sheet rows in ledger order, after the rows already there."""
    n = numbered(rows, order, "sheet_row")
    return n.withColumn("sheet_row", F.col("sheet_row") + existing)


# --- sinks -----------------------------------------------------------------

#: Beside a locked sheet lies one of its name with this ending.
LOCKED = "_LOCKED_ROWS"


def write_csv(rows: DataFrame, path: str, mode: str = "append") -> str:
    (rows.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
     .option("emptyValue", "").csv(path))
    return path


def check_header(spark: SparkSession, path: str, expected: Sequence[str]) -> bool:
    """False when nothing is there yet; an existing other header is an error."""
    try:
        found = spark.read.option("header", True).option("escape", '"').csv(path).columns
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return False
    if found and list(found) != list(expected):
        raise ValueError(f"sheet {path} has header {found}, expected {list(expected)}")
    return bool(found)


class SheetLocked(Exception):
    """A writer's way to say that its target takes no rows now; nothing was written."""


def write_or_fall_back(rows: DataFrame, path: str, writer: Callable[[DataFrame, str], str] = write_csv) -> str:
    """Write to the sheet, or to a sibling where it is locked; returns the target.

    Only a refusal of the target leads to the sibling; wrong columns or failed
    tasks are errors of the rows and stay errors.
    """
    try:
        return writer(rows, path)
    except (SheetLocked, PermissionError):
        return write_csv(rows, path.rstrip("/") + LOCKED)


def write_all(rows: DataFrame, writers: Sequence[Callable[[DataFrame], object]]) -> list:
    """One write per enabled target from the same rows."""
    return [w(rows) for w in writers]


def enabled_targets(mode: str) -> tuple[bool, bool]:
    """(local, remote) for the modes local, remote and both."""
    if mode not in ("local", "remote", "both"):
        raise ValueError(f"unknown sheet mode {mode!r}")
    return mode in ("local", "both"), mode in ("remote", "both")


def preferred_row(local_row: Column, remote_row: Column) -> Column:
    """The local row number counts, else the remote one."""
    return F.when(local_row >= 0, local_row).otherwise(remote_row)


def replace_csv(rows: DataFrame, path: str) -> str:
    return write_csv(rows, path, "overwrite")


class SheetRouter:
    """A sink of `run_intake`: a batch's new sheet rows, written to every target that `mode` enables.

    `project` makes a target's rows of the records, whose sheet_row is their number
    in that target: each target (local, its sibling for rows that came while it
    was locked, remote) counts its own rows, going on where earlier batches
    stopped. Writers get the rows and the batch's own path below `root`; what a
    batch's first attempt chose is kept, so a retry writes the same rows to the
    same places. `rows` below `root` holds form_id, target, local_row, remote_row
    (-1 where a target is not enabled) and the sheet_row that counts.
    """

    def __init__(self, root: str, mode: str, project: Callable[[DataFrame], DataFrame] = lambda rows: rows,
                 local: Callable[[DataFrame, str], str] = replace_csv, remote: Callable[[DataFrame, str], str] = replace_csv):
        self.root, self.project, self.local, self.remote = root, project, local, remote
        self.use_local, self.use_remote = enabled_targets(mode)

    def __call__(self, done: DataFrame, batch_id: int) -> None:
        spark, new = done.sparkSession, done.where("row_form = form_id")
        numbers = staged(with_row_numbers(new.select("form_id"), "form_id").withColumnRenamed("sheet_row", "_n"), "sheet-rows")
        added, totals = numbers.count(), {t: Running(spark, f"{self.root}/totals/{t}") for t in ("local", "local" + LOCKED, "remote")}

        def rows(target: str) -> DataFrame:
            place = numbers.withColumn("sheet_row", F.col("_n") + totals[target].before(batch_id)).drop("_n")
            return self.project(new.drop("sheet_row").join(place, "form_id"))

        used = []
        if self.use_local:
            used.append(self.write_local(rows, batch_id, spark))
        if self.use_remote:
            self.remote(rows("remote"), f"{self.root}/remote/batch={batch_id}")
            used.append("remote")
        number = {t: F.col("_n") + totals[t].before(batch_id) for t in used}
        local, remote = next((number[t] for t in used if t != "remote"), F.lit(-1)), number.get("remote", F.lit(-1))
        placed = numbers.select("form_id", F.lit(used[0]).alias("target"), local.cast("long").alias("local_row"), remote.cast("long").alias("remote_row"))
        write_batch(placed.withColumn("sheet_row", preferred_row(F.col("local_row"), F.col("remote_row"))), f"{self.root}/rows", batch_id)
        for t, total in totals.items():
            total.after(batch_id, added if t in used else 0)

    def write_local(self, rows: Callable[[str], DataFrame], batch_id: int, spark: SparkSession) -> str:
        """Writes the batch to the local sheet, or to its sibling; returns which, as its first attempt chose."""
        note = f"{self.root}/chosen/batch={batch_id}"
        kept = found(spark, note, "target string")
        target = kept.first().target if kept is not None else "local"
        try:
            (self.local if target == "local" else replace_csv)(rows(target), f"{self.root}/{target}/batch={batch_id}")
        except (SheetLocked, PermissionError):
            if kept is not None:
                raise
            target += LOCKED
            replace_csv(rows(target), f"{self.root}/{target}/batch={batch_id}")
        if kept is None:
            spark.createDataFrame([(target,)], "target string").coalesce(1).write.mode("overwrite").parquet(note)
        return target


def begin_session(rows: DataFrame, path: str, resume: bool) -> str:
    """First write of a session: keep the sheet on resume, else start it anew."""
    return write_csv(rows, path, "append" if resume else "overwrite")
