"""From texts, answer grids and signature pages to outcomes, in one plan."""

from datetime import date, datetime

import pytest

from formloom.constants import DEFAULT_TEMPLATES, FormTemplate
from formloom.plans import intake as I
from formloom.plans.extracted import extracted_forms, read_texts

AS_OF, SESSION = date(2024, 6, 30), datetime(2024, 1, 1)
TEXTS = """form_id long, source_filename string, text string, ocr_text string, fields array<struct<name:string,value:string>>,
  pairs array<struct<key:string,value:string>>"""
ROWS = "doc_id long, page_no int, row_no int, y0 double, label string, answered boolean"
HEADS = "doc_id long, page_no int, y double, text string"
PAGES = """doc_id long, text string, fields array<struct<name:string,type:string,value:string,is_signed:boolean>>,
  region_ink double, label_ink double"""
CHARTS = "demographic_no string, last_name string, first_name string, dob string, email string, status string"
LEDGER = """id long, file_hash string, status string, document_id string, sheet_row long, demographic_no string,
  signature_present boolean, email string, created_at timestamp"""


def body(kind, first, last, born):
    return f"{kind}\nFirst name: {first}\nLast name: {last}\nDate of birth: {born}\n" + "filler words of a page. " * 5


@pytest.fixture()
def given(spark):
    people = [("Ada", "Vale", "1990-05-01"), ("Bo", "Quist", "1985-02-03"), ("Cy", "Lund", "1979-12-30"), ("Di", "Marsh", "2001-07-09")]
    texts = [(i, f"{i}.pdf", body("General intake form", *p), None, [], []) for i, p in enumerate(people)]
    texts += [(4, "4.pdf", None, None, [], []),
              (5, "5.pdf", "", "An unknown sheet\nFirst name: Ed\nLast name: Noor\nDate of birth: 1960-01-31", [], []),
              (6, "6.pdf", body("General intake form", *people[0]), None, [], [])]
    label = "Is this label longer than the short one that a list shows? " * 4
    rows = [(i, 8, r, 26.0 * r, label if r else "q0", not (r and i in (1, 2, 5))) for i in range(7) for r in range(3)]
    pages = [(i, "Patient signature: A Person" if i != 3 else "nothing", [], 0.001 if i == 3 else None, None) for i in range(6)]
    charts = [(str(100 + i), last, first, born, "", "active") for i, (first, last, born) in enumerate([*people, ("Ed", "Noor", "1960-01-31")])]
    return (spark.createDataFrame(texts, TEXTS), spark.createDataFrame(rows, ROWS), spark.createDataFrame([], HEADS), spark.createDataFrame(pages, PAGES),
            spark.createDataFrame(charts, CHARTS), spark.createDataFrame([], LEDGER), label)


def test_every_stage_decides_the_outcome(spark, given):
    texts, rows, heads, pages, charts, ledger, label = given
    forms = extracted_forms(texts, rows, heads, pages, AS_OF, spark.createDataFrame([(2,), (2,)], "form_id long"))
    got = {r.form_id: r for r in I.process_forms(forms, charts, ledger, AS_OF, SESSION).collect()}
    assert len(got) == 7
    assert (got[0].outcome, got[0].status, got[0].person) == ("filed", "completed", "100")
    assert (got[1].status, got[1].document_id) == ("incomplete_informed", "101:Intake form (incomplete)")
    assert got[1].full_questions == [f"Page 8: {label.strip()}"] * 2 and got[1].questions == [f"Page 8: {label[:120]}"] * 2
    assert (got[2].status, got[2].approved, len(got[2].questions)) == ("completed", True, 2)
    assert (got[3].status, got[3].signature_present) == ("completed_no_signature", False)
    assert (got[4].outcome, got[4].message) == ("error", "no text could be read")
    # read by OCR, of unknown type: its grid has no answer pages, so it is not checked
    assert (got[5].used_ocr, got[5].form_type, got[5].checked, got[5].status, got[5].person) == (True, "unknown", False, "completed", "104")
    # the same file again; it has no signature page of its own
    assert (got[6].outcome, got[6].document_id, got[6].signature_present) == ("skip", "100:Intake form", None)


def test_templates_bring_their_own_labels_and_pages(spark, given):
    texts, rows, heads, pages, *_ = given
    sheet = FormTemplate("sheet", "A sheet", ("unknown sheet",), (8, 8), {"first_name": ("last name",), "last_name": ("first name",), "email": ()})
    names = {r.form_id: (r.first_name, r.last_name) for r in read_texts(texts, AS_OF, (*DEFAULT_TEMPLATES, sheet)).collect()}
    assert names[0] == ("Ada", "Vale") and names[5] == ("Noor", "Ed") and len(names) == 7
    forms = {r.form_id: r for r in extracted_forms(texts, rows, heads, pages, AS_OF, templates=(*DEFAULT_TEMPLATES, sheet)).collect()}
    assert (forms[5].form_type, forms[5].checked, len(forms[5].questions)) == ("sheet", True, 2) and not forms[2].approved
    only = extracted_forms(texts, rows, heads, pages, AS_OF, templates=(sheet,))
    assert {r.form_id for r in only.where("checked").collect()} == {5}


def test_empty_tables(spark, given):
    tables = [x.where("false") for x in given[:4]]
    assert extracted_forms(*tables, AS_OF).count() == 0
    alone = extracted_forms(given[0], *tables[1:], AS_OF)
    assert alone.count() == 7 and alone.where("checked or signature_present").count() == 0
