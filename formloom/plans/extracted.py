"""Forms as a batch takes them, from texts, answer grids and signature pages.

Every source shrinks to one narrow row per form before rows meet; a text stays
in the row it came in.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import DEFAULT_TEMPLATES, DEMOGRAPHIC_LABELS, FormTemplate
from ..functions.text import answer_pages, identify_form_type
from ..operators.documents import classify, merge_ocr
from ..operators.extraction import extract_demographics
from ..operators.grid import document_completeness, flag_unanswered
from ..operators.signature import signature_verdict
from ..sources.workdir import staged

FIELDS = ("first_name", "last_name", "email", "dob")


def read_texts(texts: DataFrame, as_of: date, templates: tuple[FormTemplate, ...] = DEFAULT_TEMPLATES) -> DataFrame:
    """One narrow row per form: its type, content hash, fields, used_ocr and stage_error.

    `texts`: form_id, source_filename, text, ocr_text (null without an engine),
    fields (name, value), pairs (key, value). Each form is read with the labels of
    its own template, forms of unknown type with the default ones. A form with
    neither text nor OCR text has a stage_error.
    """
    t = texts.withColumns({"had_text": F.col("text").isNotNull(), "file_hash": F.sha2(F.col("text").cast("binary"), 256),
                           "text": F.coalesce("text", F.lit(""))})
    t = merge_ocr(classify(t, "text", "size(filter(fields, f -> coalesce(f.value, '') <> ''))"))
    t = t.withColumn("form_type", identify_form_type(F.col("text"), templates)).withColumn(
        "stage_error", F.expr("if(had_text or used_ocr, null, 'no text could be read')"))
    by_labels: dict[tuple, tuple[dict, list[str]]] = {}
    for x in templates:
        by_labels.setdefault(tuple(sorted(x.labels.items())), (x.labels, []))[1].append(x.form_type)
    default = by_labels.setdefault(tuple(sorted(DEMOGRAPHIC_LABELS.items())), (DEMOGRAPHIC_LABELS, []))[1]
    named = {x.form_type for x in templates}
    out = None
    for labels, types in by_labels.values():
        own = t.where(F.col("form_type").isin(types) | (F.lit(types is default) & ~F.col("form_type").isin(*named)))
        # one set of labels needs no condition: every form is read by it
        rows = extract_demographics(own if len(by_labels) > 1 else t, as_of, FIELDS, labels).select(
            "form_id", "form_type", "source_filename", "file_hash", "first_name", "last_name", "email", "dob_raw", "used_ocr", "stage_error")
        out = rows if out is None else out.unionByName(rows)
    return out


def extracted_forms(texts: DataFrame, rows: DataFrame, headings: DataFrame, signature_pages: DataFrame, as_of: date,
                    approvals: DataFrame | None = None, templates: tuple[FormTemplate, ...] = DEFAULT_TEMPLATES) -> DataFrame:
    """The `forms` of `process_forms`, and form_type and full_questions beside them.

    `texts` as in `read_texts`; `rows` are question rows (doc_id, page_no, row_no,
    y0, label, answered) and `headings` the section headings of their pages;
    `signature_pages` as `signature_verdict` takes them; `approvals` the form_ids
    that an operator files as complete. A form without a signature page has an
    unknown signature, which is not a missing one; one without answer pages in its
    template, or without a grid, is not checked.
    """
    read = staged(read_texts(texts, as_of, templates), "form-texts")
    docs = read.select(F.col("form_id").alias("doc_id"), "form_type")
    answers = document_completeness(docs, flag_unanswered(rows, headings), answer_pages(templates))
    answers = answers.select(F.col("doc_id").alias("form_id"), "checked", "questions", "full_questions")
    signed = signature_verdict(signature_pages).select(F.col("doc_id").alias("form_id"), F.col("signed").alias("signature_present"))
    out = read.join(answers, "form_id", "left").join(signed, "form_id", "left")
    if approvals is None:
        out = out.withColumn("approved", F.lit(False))
    else:
        out = out.join(approvals.select("form_id").distinct().withColumn("approved", F.lit(True)), "form_id", "left")
    return out.withColumns({"approved": F.coalesce("approved", F.lit(False)), "sheet_failed": F.lit(False)})
