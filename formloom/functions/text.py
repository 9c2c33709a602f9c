"""Text expressions: trimming, e-mail sweep, labels, ids found in text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (
    DEFAULT_TEMPLATES,
    EMAIL_PATTERN,
    REGION_NAMES,
    UNKNOWN_TYPE,
    WHITESPACE,
    FormTemplate,
)


def strip(c: Column) -> Column:
    """Trim every kind of white space; Spark's own trim removes spaces only."""
    return F.btrim(c, F.lit(WHITESPACE))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def norm(c: Column) -> Column:
    """Trimmed lower case; null becomes the empty string."""
    return F.lower(strip(F.coalesce(c, F.lit(""))))


def first_match(c: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def extract_email(text: Column) -> Column:
    return first_match(text, EMAIL_PATTERN)


def contains_any(text: Column, needles) -> Column:
    """True when any non-empty needle occurs in `text`, ignoring case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hit = F.lit(False)
    for n in needles:
        if n:
            hit = hit | F.contains(low, F.lit(n.lower()))
    return hit


def identify_form_type(text: Column, templates: tuple[FormTemplate, ...] = DEFAULT_TEMPLATES) -> Column:
    out = None
    for t in templates:
        cond = contains_any(text, t.identifiers)
        out = F.when(cond, t.form_type) if out is None else out.when(cond, t.form_type)
    return F.lit(UNKNOWN_TYPE) if out is None else out.otherwise(UNKNOWN_TYPE)


def answer_pages(templates: tuple[FormTemplate, ...] = DEFAULT_TEMPLATES) -> dict[str, tuple[int, int]]:
    """First and last page of the answer grid of each form type that has one."""
    return {t.form_type: t.validation_pages for t in templates if t.validation_pages}


def form_description(form_type: Column, templates: tuple[FormTemplate, ...] = DEFAULT_TEMPLATES,
                     default: str = "Intake questionnaire") -> Column:
    out = F.lit(default)
    for t in reversed(templates):
        out = F.when(form_type == t.form_type, t.description).otherwise(out)
    return out


def keyword_label(text: Column, keywords, label: str, default: str = "") -> Column:
    return F.when(contains_any(text, keywords), label).otherwise(default)


def region_name(code: Column) -> Column:
    """Full region name for a code; dots and case are ignored, unknown passes."""
    trimmed = strip(F.coalesce(code, F.lit("")))
    key = F.replace(F.upper(trimmed), F.lit("."), F.lit(""))
    names = F.create_map(*[F.lit(x) for kv in REGION_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, key), trimmed)


def yes_no(flag: Column) -> Column:
    return F.when(flag.isNull(), "").when(flag, "Yes").otherwise("No")


def full_name(first: Column, last: Column) -> Column:
    return strip(F.concat_ws(" ", F.nullif(first, F.lit("")), F.nullif(last, F.lit(""))))


def display_name(first: Column, last: Column) -> Column:
    return F.concat_ws(", ", F.nullif(last, F.lit("")), F.nullif(first, F.lit("")))


def pages_label(pages: str) -> Column:
    """`Page 8`, `Pages 8, 10 and 11`; empty for no pages. `pages` is SQL text."""
    return F.expr(f"""case size({pages}) when 0 then '' else aggregate(
      sort_array(array_distinct({pages})), cast(array() as array<string>), (a, x) -> array_append(a, string(x)),
      a -> case when size(a) = 1 then concat('Page ', a[0])
        else concat('Pages ', array_join(slice(a, 1, size(a) - 1), ', '), ' and ', a[size(a) - 1]) end) end""")


def registry_id_in_text(text: Column) -> Column:
    return first_match(text, r"(?i)demographic_?no=([0-9]+)", 1)


def appended_row(updated_range: Column) -> Column:
    """Row number in a range such as `Sheet!A5:J5`; -1 when there is none."""
    cell = F.split_part(F.element_at(F.split(updated_range, "!"), -1), F.lit(":"), F.lit(1))
    digits = F.regexp_replace(cell, "[^0-9]", "")
    return F.coalesce(digits.try_cast("bigint"), F.lit(-1).cast("bigint"))


def url_origin(url: Column) -> Column:
    scheme = F.try_parse_url(url, F.lit("PROTOCOL"))
    host = F.try_parse_url(url, F.lit("AUTHORITY"))
    return F.concat(scheme, F.lit("://"), host)


# Fixed value: names that form editors give to fields by themselves.
GENERIC_FIELD_PATTERN = r"(?iU)^(check\s*box|checkbox|undefined|field|text)\s*[0-9]*$"


def is_generic_field(name: Column) -> Column:
    return strip(F.coalesce(name, F.lit(""))).rlike(GENERIC_FIELD_PATTERN)


def clean_option_label(name: Column, aliases: dict[str, str] | None = None) -> Column:
    """Alias a field name, then drop a trailing ` name`."""
    lbl = name
    for old, new in (aliases or {}).items():
        lbl = F.when(name == old, new).otherwise(lbl)
    return strip(F.regexp_replace(lbl, r"(?i) name\z", ""))


def cut_printed_label(text: Column, max_chars: int = 40) -> Column:
    """Printed label up to a bracket (unless it starts with one), no end colon."""
    t = strip(text)
    pos = F.locate("(", t)
    cut = F.when(pos > 1, F.substring(t, F.lit(1), pos - 1)).otherwise(t)
    return F.substring(strip(F.rtrim(strip(cut), F.lit(":"))), 1, max_chars)


def sql_text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


_WS = sql_text(WHITESPACE)


def sql_list(items) -> str:
    return "(" + ", ".join(sql_text(x) for x in items) + ")"


def sql_strip(x: str) -> str:
    return f"btrim({x}, {_WS})"


def label_pattern(label: str) -> str:
    return re.sub(r"([.^$*+?()\[\]{}|\\-])", r"\\\1", label)


def label_regex(label: str) -> str:
    """`label: value` / `label - value`, ignoring case; the value is group 1."""
    return "(?i)" + label_pattern(label) + r"[:\-]\s*([^\n\r]+)"


def cut_value_sql(value: str) -> str:
    """A value cut at two or more spaces; null if nothing is left."""
    cut = rf"split({sql_strip(value)}, r'\s{{2,}}', 2)[0]"
    return f"nullif({sql_strip(cut)}, '')"


def inline_value_sql(text: str, label: str) -> str:
    """First inline value of a label."""
    return cut_value_sql(f"regexp_extract({text}, r'{label_regex(label)}', 1)")


def inline_value(text: str, label: str) -> Column:
    return F.expr(inline_value_sql(text, label))


def inline_layers(labels) -> list[list[str]]:
    """Labels in layers, none of which holds a label that ends in another of the same layer."""
    layers: list[list[str]] = []
    for x in sorted({x.lower() for x in labels}, key=lambda x: (-len(x), x)):
        free = next((y for y in layers if not any(z.endswith(x) for z in y)), None)
        if free is None:
            layers.append(free := [])
        free.append(x)
    return layers


def inline_pairs(text: str, labels) -> Column:
    """Every inline (label, value) of a text, in order inside a layer; labels in lower case.

    Colons and dashes are looked up and the text before each is compared with
    all labels of a layer at once, so a text is passed over twice a layer, not
    once a label. Values are as `inline_value` gives them; null texts have none.
    """
    def layer(names: list[str]) -> str:
        before = "|".join(label_pattern(x) for x in names)
        pattern = rf"r'(?i)[:\-](?<=({before})[:\-])(?=\s*([^\n\r]+))'"
        found = lambda group: f"regexp_extract_all({text}, {pattern}, {group})"
        return f"zip_with({found(1)}, {found(2)}, (l, v) -> struct(lower(l) as label, {cut_value_sql('v')} as value))"

    return F.expr(f"coalesce(concat({', '.join(layer(x) for x in inline_layers(labels))}), array())")


def inline_pair_value_sql(pairs: str, label: str) -> str:
    """The value of a label's first pair, or null."""
    return f"get(filter({pairs}, p -> p.label = {sql_text(label.lower())}), 0).value"


# Every line boundary, not line feeds alone.
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def text_lines(text: str) -> Column:
    """Trimmed lines of a text column, in order."""
    return F.expr(f"transform(split(coalesce({text}, ''), r'{LINE_BREAK}'), x -> {sql_strip('x')})")


def label_lines(lines: str, all_labels) -> Column:
    """Label lines with the first non-blank of the two lines that follow.

    One pass over the zipped, shifted line arrays. A line counts as a label when
    it equals one apart from bracketed remarks and colons. A label followed by
    two blank lines is dropped; a value that is a label itself, or longer than
    60 characters, becomes null and still decides. `lines` is a column name.
    """
    labels = "array(" + ", ".join(sql_text(x) for x in sorted(all_labels)) + ")"
    base = lambda x: sql_strip(rf"regexp_replace(lower({x}), r'\([^\n]*?\)|:', '')")
    return F.expr(f"""transform(
      filter(
        transform(
          arrays_zip({lines}, slice({lines}, 2, size({lines})), slice({lines}, 3, size({lines}))),
          r -> struct({base('r.' + lines)} as base, coalesce(nullif(r.`1`, ''), nullif(r.`2`, '')) as following)),
        r -> r.following is not null and array_contains({labels}, r.base)),
      r -> struct(r.base as base,
        if(array_contains({labels}, {base('r.following')}) or length(r.following) > 60, null, r.following) as value))""")


def next_line_value_sql(found_label_lines: str, label: str) -> str:
    """The first decisive occurrence of a label gives the value, or null."""
    return f"get(filter({found_label_lines}, r -> r.base = {sql_text(label)}), 0).value"


def next_line_value(found_label_lines: str, label: str) -> Column:
    return F.expr(next_line_value_sql(found_label_lines, label))


def followup_message(first_name: Column, pages: Column, questions: str,
                     template: str = "Hello {name}, some answers are missing{pages}.{questions}") -> Column:
    """Follow-up body; `{name}`, `{pages}`, `{questions}` are filled in."""
    name = F.coalesce(blank_to_null(first_name), F.lit("there"))
    page_part = F.when(pages == "", "").otherwise(F.concat(F.lit(" ("), pages, F.lit(")")))
    q_part = F.expr(f"""if(coalesce(size({questions}), 0) <= 0, '',
      concat('\\nStill open:\\n', array_join(transform({questions}, q -> concat('  - ', q)), '\\n')))""")
    out = F.lit(template)
    for key, val in (("{pages}", page_part), ("{questions}", q_part), ("{name}", name)):
        out = F.replace(out, F.lit(key), val)
    return out
