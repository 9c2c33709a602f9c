"""Form, registry, ledger and layout tables derived from the checking tables.

The checking tables hold no forms, so these views derive them with narrow
projections (no join, no shuffle, whole tables). Each has the same meaning as
the SQL of the same name in the `oracle` package.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A table. `spread` deals its rows over all cores, for small tables of one row group, which one
    task reads; only the columns that are used travel. Large tables come in many splits by themselves."""
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return table.repartition(spark.sparkContext.defaultParallelism) if spread else table


def _name(prefix: str, k: str, n: int) -> str:
    """A six-letter name; every 50th person is a namesake of the one before."""
    base = f"({k} - if({k} % 50 = 1, 1, 0))"
    return f"translate(substr(md5(cast(concat('{prefix}', {base} % {n}) as binary)), 1, 6), '0123456789', 'ghijklmnop')"


def _last(k: str) -> str:
    return _name("L", k, 400)


def _first(k: str) -> str:
    return _name("F", k, 97)


def _dob(k: str, plus: int = 0) -> str:
    base = f"({k} - if({k} % 50 = 1, 1, 0))"
    return f"date_add(date'1950-01-01', cast(({base} * 7919) % 20000 + {plus} as int))"


def _email(k: str) -> str:
    return f"concat('u', {k}, '@example.com')"


def person_last(k: str) -> Column:
    return F.expr(_last(k))


def person_first(k: str) -> Column:
    return F.expr(_first(k))


def person_email(k: str) -> Column:
    return F.expr(_email(k))


_CODE = """element_at(array('AB', 'BC', 'MB', 'NB', 'NL', 'NS', 'NT', 'NU', 'ON', 'PE', 'QC', 'SK', 'YT'),
  c_nationkey % 13 + 1)"""


def charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = "c_custkey"
    return read(spark, sf_dir, "customer").selectExpr(
        f"string({k}) as demographic_no",
        f"{_last(k)} as last_name",
        f"{_first(k)} as first_name",
        f"case {k} % 3 when 0 then {_first(k)} when 1 then 'Sunny' end as pref_name",
        f"string({_dob(k)}) as dob",
        f"if({k} % 11 = 0, '', {_email(k)}) as email",
        f"if({k} % 2 = 0, 'F', 'M') as sex",
        f"concat({k}, ' Main St') as address",
        f"""case {k} % 4 when 0 then {_CODE}
              when 1 then concat(substr({_CODE}, 1, 1), '.', substr({_CODE}, 2, 1), '.')
              when 2 then concat(' ', lower({_CODE})) else 'Elsewhere' end as province""",
        f"case {k} % 3 when 0 then 'he/him' when 1 then 'she/her' else 'They/Them' end as pronoun",
        "concat('segment ', c_mktsegment) as booking_alert",
        "if(c_acctbal >= 0, 'active', 'inactive') as status",
    )


def chart_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry page fields as ordered (name, value) pairs plus date parts."""
    k, d, seg = "c_custkey", _dob("c_custkey"), "c_mktsegment"
    pair = lambda n, v: f"struct('{n}' as name, {v} as value)"
    return read(spark, sf_dir, "customer").selectExpr(
        f"string({k}) as demographic_no",
        f"{_last(k)} as last_name",
        f"if({k} % 9 = 0, '', {_first(k)}) as first_name",
        f"if({k} % 5 = 0, '', string(year({d}))) as year_of_birth",
        f"string(month({d})) as month_of_birth",
        f"string(day({d})) as date_of_birth",
        f"if({k} % 10 = 0, '', string({d})) as full_birth_date",
        f"""array({pair('note', "'n'")}, {pair('alert', f"if({k} % 4 = 0, {seg}, '')")},
              {pair('patientAlert', f"if({k} % 4 = 1, {seg}, '')")},
              {pair('extraAlert1', f"if({k} % 4 = 2, concat('x ', {seg}), '')")},
              {pair('preferredPronoun', f"if({k} % 3 = 0, 'he/him', '')")},
              {pair('userPronoun', f"if({k} % 3 = 1, 'she/her', '')")}) as fields""",
        "if(c_acctbal >= 0, 'active', 'inactive') as status",
    )


def _written_date(d: str) -> str:
    return f"""case floor(o_orderkey / 10) % 4 when 0 then date_format({d}, 'yyyy-MM-dd')
      when 1 then date_format({d}, 'dd/MM/yyyy') when 2 then date_format({d}, 'MM/dd/yyyy')
      else date_format({d}, 'yyyyMMdd') end"""


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms copied from charts and spoilt by `o_orderkey % 10`."""
    return forms_of(read(spark, sf_dir, "orders"))


def forms_of(orders: DataFrame) -> DataFrame:
    """The same of a table or a stream of orders."""
    o, k = "o_orderkey", "o_custkey"
    return orders.selectExpr(
        f"{o} as form_id",
        f"if({o} % 10 in (6, 8, 9), null, {_first(k)}) as first_name",
        f"""case when {o} % 10 in (8, 9) then null when {o} % 10 = 4 then concat(substr({_last(k)}, 1, 3), 'zz')
              when {o} % 13 = 0 then concat(upper({_last(k)}), ' ') else {_last(k)} end as last_name""",
        f"case {o} % 7 when 0 then upper({_first(k)}) when 1 then 'Zed' end as pref_name",
        f"""case when {o} % 10 = 8 then {_email(k)} when {o} % 10 = 9 then null
              when {o} % 10 = 7 then if({o} % 20 = 7, {_email(k)}, null)
              when {o} % 3 = 0 then {_email(k)} end as email""",
        f"""case when {o} % 10 in (5, 8, 9) then null when {o} % 10 = 7 then {_written_date(_dob(k, 1))}
              else {_written_date(_dob(k))} end as dob_raw""",
        f"""case {o} % 5 when 0 then 'He/His' when 1 then 'She/Hers' when 2 then 'They/Them'
              when 3 then ' she/her ' end as pronoun""",
        f"""case {o} % 6 when 0 then concat({o}, ' Elm Ave') when 1 then '12 Office Park Way, Suite 3' end as address""",
        "o_orderpriority = '1-URGENT' as used_ocr",
        "case o_orderstatus when 'F' then true when 'O' then false end as signature_present",
        f"concat('form_', {o} % 1000, if({o} % 4 = 0, '.DOCX', '.pdf')) as source_filename",
        "timestamp(o_orderdate) as received_at",
        "date_format(o_orderdate, 'yyyy-MM-dd') as received_day",
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = "event_id", "user_id"
    return read(spark, sf_dir, "events").selectExpr(
        f"{e} + 1 as id",
        f"concat('form_', {e} % 500, '.pdf') as source_filename",
        "md5(cast(props as binary)) as file_hash",
        """case event_type when 'click' then 'completed' when 'view' then 'completed_no_signature'
             when 'signup' then 'incomplete_informed' when 'purchase' then 'not_found'
             when 'error' then 'error' end as status""",
        f"{e} % 5 = 0 as used_ocr",
        f"{_first(u)} as first_name",
        f"{_last(u)} as last_name",
        f"if({e} % 4 = 0, concat({_first(u)}, '@example.com'), {_email(u)}) as email",
        f"string({_dob(u)}) as dob",
        f"case {e} % 17 when 0 then null when 1 then '' else string({u}) end as demographic_no",
        f"case {e} % 3 when 0 then true when 1 then false end as signature_present",
        f"case when value < 50 then null when value < 60 then '' else concat({u}, ':Form') end as document_id",
        f"if({e} % 3 <> 0, {e}, null) as sheet_row",
        "date_trunc('second', timestamp(ts)) as created_at",
        "timestamp(ts) as ts",
        "event_type",
        "value",
        "props",
    )


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return read(spark, sf_dir, "events").select(
        (e + 1).alias("id"),
        F.floor(e / 8).alias("record_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.lit("system").alias("actor"),
        F.col("event_type").alias("event"),
        F.col("props").alias("detail"),
    )


def ink_cells(spark: SparkSession, sf_dir: str, doc: str = "l_suppkey") -> DataFrame:
    """Answer cells: dark and total pixels of every (page, row, cell). By l_partkey they belong to the documents."""
    dark = F.round(F.col("l_discount") * 100).cast("int")
    return read(spark, sf_dir, "lineitem").select(
        F.col(doc).alias("doc_id"),
        (6 + F.col("l_linenumber") % 7).cast("int").alias("page_no"),
        (F.col("l_orderkey") % 30).cast("int").alias("row_no"),
        dark.alias("dark"),
        F.lit(500).alias("total"),
        (dark / F.lit(500.0)).alias("ink"),
    )


def widgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form widgets, also used as word boxes and as text lines."""
    x0 = (10 * F.col("l_quantity")).cast("double")
    y0 = (5 * (F.col("l_partkey") % 97)).cast("double")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("doc_id"),
        (6 + F.col("l_linenumber") % 7).cast("int").alias("page_no"),
        x0.alias("x0"), y0.alias("y0"), (x0 + 14).alias("x1"), (y0 + 12).alias("y1"),
        F.concat(F.lit("field"), (F.col("l_partkey") % 50).cast("string")).alias("field_name"),
        F.when(F.col("l_linestatus") == "F", "checkbox").otherwise("text").alias("field_type"),
        F.when(F.col("l_returnflag") == "N", F.when(F.col("l_linestatus") == "F", "Off").otherwise("  "))
        .when(F.col("l_returnflag") == "A", "Yes").otherwise("x").alias("field_value"),
        F.col("l_orderkey").alias("src_order"),
        F.col("l_partkey").alias("src_part"),
        F.concat(F.lit("w"), (F.col("l_partkey") % 211).cast("string")).alias("word"),
    )


def ink_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches of a page's image, one left of each word box: position, dark and total pixels."""
    return read(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey as doc_id", "cast(6 + l_linenumber % 7 as int) as page_no",
        "cast(10 * l_quantity - 10 as double) as x", "double(5 * (l_partkey % 97) + 3) as y",
        "cast(round(l_discount * 100) as int) as dark", "50 as total")


def form_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole document text under a header block in one of four layouts."""
    k = "doc_id"
    f, l, d, e = _first(k), _last(k), _dob(k), _email(k)
    return read(spark, sf_dir, "documents").selectExpr(
        k, "source", "text as body",
        f"""concat(
          case {k} % 5 when 0 then 'General Intake Form\\n' when 1 then 'The extended questionnaire\\n' else '' end,
          case {k} % 4
            when 0 then concat('First name: ', {f}, '\\nLast name:', {l}, '   x\\nDate of birth: ', {d},
                               '\\nEmail- ', {e}, '\\n')
            when 1 then concat('First name\\n', {f}, '\\nLast name (legal):\\n \\n', {l}, '\\nDate of birth\\n', {d},
                               '\\nEmail\\n', {e}, '\\n')
            when 2 then 'First name\\nLast name\\nDate of birth\\nEmail\\n' else '' end,
          text) as text""",
    )
