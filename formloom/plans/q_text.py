"""Queries over document text, form fields and values."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DEMOGRAPHIC_LABELS
from ..functions import predicates as P
from ..functions import text as X
from ..functions.dates import age_years, with_readings
from ..operators import documents as D
from ..operators import extraction as E
from ..sources import tables as T

AS_OF = date(2024, 6, 30)
OWN_EMAIL = "u7@Example.com"
OWN_ADDRESS = ("office park way", "suite 3")


def content_hash_dups(spark: SparkSession, d: str) -> DataFrame:
    return D.content_copies(T.read(spark, d, "documents"), "doc_id", "text")


def email_extract(spark: SparkSession, d: str) -> DataFrame:
    return T.read(spark, d, "documents").select("doc_id", X.extract_email(F.col("text")).alias("email"))


def doc_kind(spark: SparkSession, d: str) -> DataFrame:
    docs = T.read(spark, d, "documents")
    return D.classify(docs, "text", "if(doc_id % 9 = 0, 2, 0)").select(
        "doc_id", "text_chars", "kind", "needs_ocr", "confidence", "detail")


def form_type(spark: SparkSession, d: str) -> DataFrame:
    t = T.form_text(spark, d).select("doc_id", X.identify_form_type(F.col("text")).alias("form_type"))
    return t.withColumn("description", X.form_description(F.col("form_type")))


def inline_label(spark: SparkSession, d: str) -> DataFrame:
    return T.form_text(spark, d).select(
        "doc_id",
        X.inline_value("text", "first name").alias("first_name"),
        X.inline_value("text", "last name").alias("last_name"),
        X.inline_value("text", "date of birth").alias("dob"),
        X.inline_value("text", "email").alias("email"),
    )


def next_line_label(spark: SparkSession, d: str) -> DataFrame:
    t = E.with_label_lines(T.form_text(spark, d).select("doc_id", "text"))
    picks = {"first_name": "first name", "last_name": "last name", "dob": "date of birth", "email": "email"}
    t = t.select("doc_id", *[X.next_line_value("label_lines", x).alias(f) for f, x in picks.items()])
    return t.select("doc_id", *[F.when(P.is_plausible(f, f, AS_OF), F.col(f)).alias(f) for f in picks])


def sources(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    first, email = T.person_first("doc_id"), T.person_email("doc_id")
    nv = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    kv = lambda n, v: F.struct(F.lit(n).alias("key"), v.alias("value"))
    no_fields = F.array(nv("none", F.lit("")))
    fields = F.when(k % 6 == 0, F.array(
        nv("txtFirst Name", first), nv("Alt first name", F.lit("Alt")), nv("Patient E-mail", email),
        nv("Patient email 2", F.lit(" second@example.com ")))).otherwise(no_fields)
    pairs = F.when(k % 6 == 1, F.array(
        kv("First name", F.lit("patient")), kv("Last Name: legal", F.lit("Okafor")),
        kv("Surname", F.lit("Later")), kv("date of birth", F.lit("31/12/1999")))).otherwise(
        F.array(kv("none", F.lit(""))))
    return T.form_text(spark, d).select("doc_id", "text", fields.alias("fields"), pairs.alias("pairs"))


def field_precedence(spark: SparkSession, d: str) -> DataFrame:
    e = E.extract_demographics(sources(spark, d), AS_OF)
    return e.select("doc_id", "first_name", "last_name", "email", "dob_raw", "dob",
                    F.array_join("dob_readings", ",").alias("readings"))


def age(spark: SparkSession, d: str) -> DataFrame:
    f = with_readings(T.forms(spark, d).select("form_id", "dob_raw"), "dob_raw", AS_OF)
    return f.select("form_id", "dob", age_years(F.col("dob"), AS_OF).alias("age"))


def region_name(spark: SparkSession, d: str) -> DataFrame:
    return T.charts(spark, d).select("demographic_no", X.region_name(F.col("province")).alias("province"))


KEYWORDS, LABEL = ("machinery", "BUILD"), "Private"


def keyword_label(spark: SparkSession, d: str) -> DataFrame:
    return T.charts(spark, d).select(
        "demographic_no", X.keyword_label(F.col("booking_alert"), KEYWORDS, LABEL).alias("program_status"))


def _with_dob(spark: SparkSession, d: str) -> DataFrame:
    return with_readings(T.forms(spark, d), "dob_raw", AS_OF)


def min_identifiers(spark: SparkSession, d: str) -> DataFrame:
    f = _with_dob(spark, d)
    return f.select("form_id", P.has_minimum_identifiers(
        f.first_name, f.last_name, f.email, f.dob).alias("has_minimum"))


def review_queue(spark: SparkSession, d: str) -> DataFrame:
    f = _with_dob(spark, d)
    wanted = P.needs_review(f.used_ocr, f.first_name, f.last_name, f.email, f.dob)
    return f.where(wanted).select("form_id", "used_ocr", "first_name", "last_name", "email", "dob")


def own_contact_filter(spark: SparkSession, d: str) -> DataFrame:
    f = T.forms(spark, d)
    return f.select("form_id", P.drop_own_email(f.email, OWN_EMAIL).alias("email"),
                    P.drop_own_address(f.address, OWN_ADDRESS).alias("address"))


def plausible(spark: SparkSession, d: str) -> DataFrame:
    """Every field's rule, strict and word-document, over varied values."""
    v = F.expr("""case form_id % 8 when 0 then last_name when 1 then concat(last_name, ' Patient')
      when 2 then dob_raw when 3 then email when 4 then address when 5 then concat(last_name, '/she')
      when 6 then concat(address, ' ', repeat('z', 60)) else concat('\\t', pref_name, '9') end""")
    f = T.forms(spark, d).select("form_id", v.alias("v"))
    cols = []
    for field in ("first_name", "email", "dob", "phone"):
        cols.append(F.coalesce(P.is_plausible(field, "v", AS_OF), F.lit(False)).alias(f"{field}_ok"))
        cols.append(F.coalesce(P.is_plausible_word_document(field, "v", AS_OF), F.lit(False))
                    .alias(f"{field}_word_ok"))
    return f.select("form_id", *cols)


def widget_filled(spark: SparkSession, d: str) -> DataFrame:
    w = T.widgets(spark, d)
    return (
        w.groupBy("doc_id", "page_no", "field_type")
        .agg(F.count(F.lit(1)).alias("widgets"),
             F.count_if(P.is_widget_filled(w.field_type, w.field_value)).alias("filled"),
             F.count_if(P.is_marked(w.field_value)).alias("marked"))
    )


def _word_documents(spark: SparkSession, d: str) -> DataFrame:
    """Document lines as paragraphs, plus a row of table cells per document."""
    t = T.form_text(spark, d)
    cells = F.expr("array('Referral', concat('src ', source), '', 'Phone', cast(doc_id as string), 'Last name')")
    return t.select("doc_id", "text", X.text_lines("text").alias("lines"), cells.alias("cells"))


def docx_pairs(spark: SparkSession, d: str) -> DataFrame:
    w = _word_documents(spark, d).select(
        "doc_id", "text", E.paragraph_pairs("lines").alias("para"), E.cell_pairs("cells").alias("cell"))
    w = w.select("doc_id", "text", E.with_cell_pairs("para", "cell").alias("pairs"))
    loose = {"exact": True, "max_chars": 80, "stopwords": ()}
    return w.select(
        "doc_id",
        F.expr("cast(size(array_distinct(transform(pairs, p -> p.key))) as bigint)").alias("n_keys"),
        *[E.pair_value("pairs", f, DEMOGRAPHIC_LABELS[f], AS_OF, **loose).alias(f)
          for f in ("first_name", "last_name", "dob", "phone")],
        E.keyed_value("pairs").alias("referral_source"),
        E.option_in_text(F.col("text")).alias("pronoun"),
    )


def docx_completeness(spark: SparkSession, d: str) -> DataFrame:
    docs = T.form_text(spark, d).select("doc_id", F.expr("""concat(text,
        case doc_id % 3 when 0 then '\\n1. Never or rarely 3\\n2) How often do you lose things?' when 1
          then '\\nsometimes\\n1. aaaaaaaaaaaaaaaa\\n2. bbbbbbbbbbbbbbbb\\n3. cccccccccccccc\\n4) dddddddddddddd'
          else '' end) as text"""))
    return E.word_document_completeness(docs).select(
        "doc_id", "has_scale", F.col("answered").cast("bigint").alias("answered"),
        F.col("unanswered").cast("bigint").alias("unanswered"), "complete", "detail")


def option_priority(spark: SparkSession, d: str) -> DataFrame:
    e = T.read(spark, d, "events").select("event_id", F.expr("""array(
        struct('She/Her' as name, case event_id % 3 when 0 then 'x' when 1 then 'Off' else ' NO ' end as value),
        struct(' He His' as name, if(event_id % 4 = 0, 'On', '') as value),
        struct('TheyThem' as name, if(event_id % 5 = 0, '1', '0') as value),
        struct('SheHer HeHis TheyThemBirthdate' as name, '19900101' as value)) as fields"""))
    return e.select("event_id", E.marked_option("fields").alias("pronoun"))


def label_cleanup(spark: SparkSession, d: str) -> DataFrame:
    p = T.read(spark, d, "part").select("p_partkey", F.expr("""case p_partkey % 6
        when 0 then concat('Check Box', p_partkey) when 1 then concat(p_name, ' Name')
        when 2 then concat(p_name, ' (e.g. x)') when 3 then concat('(', p_name, ')')
        when 4 then concat('  ', p_name, ': ') else 'Online search eg any' end as name"""))
    return p.select(
        "p_partkey",
        X.is_generic_field(F.col("name")).alias("generic"),
        X.clean_option_label(F.col("name"), {"Online search eg any": "Online search"}).alias("cleaned"),
        X.cut_printed_label(F.col("name")).alias("printed"),
    )


def text_ids(spark: SparkSession, d: str) -> DataFrame:
    p = T.read(spark, d, "pages")
    link = F.expr("concat('open(\"Demographic', if(page_id % 2 = 0, '_', ''), 'No=', page_id, '&x=1\")')")
    rng = F.expr("case page_id % 3 when 0 then concat('Log!A', page_id, ':J', page_id) when 1 then 'A' "
                 "else concat('B', page_id) end")
    return p.select(
        "page_id",
        X.url_origin(F.col("url")).alias("origin"),
        X.registry_id_in_text(link).alias("registry_id"),
        X.appended_row(rng).alias("appended_row"),
    )


def record_text(spark: SparkSession, d: str) -> DataFrame:
    return D.document_text(T.read(spark, d, "conversations"), "conv_id", "turn", "text")


def field_map(spark: SparkSession, d: str) -> DataFrame:
    c = T.read(spark, d, "conversations").select(
        "conv_id", "turn", F.expr("concat(' ', role, ' ')").alias("role"),
        F.expr("if(turn % 3 = 2, ' \\t ', text)").alias("text"))
    return D.field_values(c, "conv_id", "turn", "role", "text")


def routed_union(spark: SparkSession, d: str) -> DataFrame:
    """Both document branches, each classified its own way, as one shape."""
    f = T.forms(spark, d).withColumn("ext", F.lower(F.regexp_extract("source_filename", r"\.[^.]*$", 0)))
    word = f.where("ext = '.docx'").selectExpr("form_id", "'fillable' as kind", "0.8D as confidence")
    pdf = f.where("ext = '.pdf'").selectExpr(
        "form_id", "if(used_ocr, 'scanned', 'fillable') as kind", "if(used_ocr, 0.6D, 0.9D) as confidence",
        "used_ocr")
    return word.unionByName(pdf, allowMissingColumns=True).selectExpr(
        "form_id", "kind", "confidence", "coalesce(used_ocr, false) as used_ocr")


def document_warnings(spark: SparkSession, d: str) -> DataFrame:
    """A third of the documents are image-only; OCR is absent, empty or whole."""
    t = T.form_text(spark, d).selectExpr(
        "doc_id", "if(doc_id % 3 = 0, '', text) as text",
        "case doc_id % 4 when 0 then null when 1 then ' \\n ' else text end as ocr_text")
    t = D.classify(t)
    m = D.merge_ocr(t).withColumn("form_type", X.identify_form_type(F.col("text")))
    w = D.warnings_of(F.col("ocr_missing"), F.col("ocr_empty"), F.col("form_type") == "unknown",
                      F.expr("not contains(text, '@')"))
    return m.select("doc_id", "used_ocr", "confidence", "form_type", F.array_join(w, "; ").alias("warnings"))


QUERIES = {
    "q_content_hash_dups": content_hash_dups,
    "q_email_extract": email_extract,
    "q_doc_kind": doc_kind,
    "q_form_type": form_type,
    "q_inline_label": inline_label,
    "q_next_line_label": next_line_label,
    "q_field_precedence": field_precedence,
    "q_age": age,
    "q_region_name": region_name,
    "q_keyword_label": keyword_label,
    "q_min_identifiers": min_identifiers,
    "q_review_queue": review_queue,
    "q_own_contact_filter": own_contact_filter,
    "q_plausible": plausible,
    "q_widget_filled": widget_filled,
    "q_docx_pairs": docx_pairs,
    "q_docx_completeness": docx_completeness,
    "q_option_priority": option_priority,
    "q_label_cleanup": label_cleanup,
    "q_text_ids": text_ids,
    "q_record_text": record_text,
    "q_field_map": field_map,
    "q_routed_union": routed_union,
    "q_document_warnings": document_warnings,
}
