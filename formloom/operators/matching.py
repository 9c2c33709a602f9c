"""Tiered linking of forms to registry charts.

The registry becomes an index of keys: one row per name, prefix, date or e-mail
with the number of charts that have it and the first of them. Charts are counted
inside the tasks before the shuffle, so a name shared by a third of all charts is
one row a task, and a form asks for the few keys its tiers need. Whether exactly
one chart is sure is decided by counts over all charts; no chart is out of sight.
Only review lists hold charts themselves, the first ones of each key.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import REVIEW_LIST_SIZE
from ..functions.dates import dob_candidates, match_readings, preferred_reading
from ..functions.predicates import has_minimum_identifiers
from ..functions.text import norm
from .skew import resharded_join

# Fixed labels of the tiers and reasons.
BY_DATE = "DOB + last-name match"
BY_NAME = "name match (first-3 + last-3)"
CHOSEN = "operator selected"
# SQL conditions on one chart h of a page and the form's fl, ff, readings.
_LAST3 = "(fl <> '' and h.l <> '' and substr(fl, 1, 3) = substr(h.l, 1, 3))"
_FIRST3 = "(ff <> '' and h.f <> '' and substr(ff, 1, 3) = substr(h.f, 1, 3))"
_DATE_OK = "coalesce(array_contains(readings, h.d), false)"
CONFIDENT = f"""case when size(readings) > 0 then if({_DATE_OK} and {_LAST3}, '{BY_DATE}', null)
  when {_LAST3} and {_FIRST3} then '{BY_NAME}' end"""
REJECTED = f"""case when size(readings) = 0 then 'name prefix did not match'
  when {_DATE_OK} then 'DOB matched but last name differs' else 'DOB did not match chart' end"""

# Keys by kind, from a chart's or a form's normalised names, e-mail and one date.
KEYS = {
    "n": ("l", "f"), "nd": ("l", "f", "d"), "p": ("l3", "f3"), "pd": ("l3", "f3", "d"), "ld": ("l3", "d"),
    "d": ("d",), "s": ("l3",), "e": ("e",), "eld": ("e", "l3", "d"), "elf": ("e", "l3", "f3"),
}


def _key(kind: str, fields: dict[str, str]) -> str:
    """SQL of one key, null where a part of it is blank or null."""
    parts = [fields[p] for p in KEYS[kind]]
    filled = " and ".join(f"coalesce({p}, '') <> ''" for p in parts)
    return f"if({filled}, concat_ws('\u0001', '{kind}', {', '.join(parts)}), null)"


def _charts(charts: DataFrame, as_of: date) -> DataFrame:
    """Active charts with normalised names, e-mail, date and registry order."""
    c = charts.where("status = 'active'").withColumn("_c", dob_candidates("dob", as_of))
    return c.select(
        "demographic_no", "dob",
        norm(F.col("last_name")).alias("l"),
        norm(F.col("first_name")).alias("f"),
        norm(F.col("email")).alias("e"),
        preferred_reading("dob", "_c").alias("d"),
        F.expr("try_cast(demographic_no as bigint)").alias("seq"),
    ).selectExpr("*", "substr(l, 1, 3) as l3", "substr(f, 1, 3) as f3")


def key_index(charts: DataFrame, as_of: date, kinds: tuple[str, ...] = tuple(KEYS)) -> DataFrame:
    """(key, charts, first): all active charts counted by key; one row a key."""
    fields = {p: p for k in kinds for p in KEYS[k]}
    keys = ", ".join(_key(k, fields) for k in kinds)
    each = _charts(charts, as_of).select("demographic_no", F.explode(F.expr(f"array_compact(array({keys}))")).alias("key"))
    return each.groupBy("key").agg(F.count(F.lit(1)).alias("charts"), F.min("demographic_no").alias("first"))


def search_index(charts: DataFrame, as_of: date, page: int = REVIEW_LIST_SIZE, kinds: tuple[str, ...] = ("n", "p", "d"),
                 shown: str = "demographic_no, dob, l, f, d") -> DataFrame:
    """(key, hits): the first `page` active charts of each key, for lists that show no more, each with its `shown` columns.

    Order is ascending registry number; the ranking is cut before the shuffle.
    """
    fields = {p: p for k in kinds for p in KEYS[k]}
    keys = ", ".join(_key(k, fields) for k in kinds)
    each = _charts(charts, as_of).select("*", F.explode(F.expr(f"array_compact(array({keys}))")).alias("key"))
    w = Window.partitionBy("key").orderBy(F.col("seq").asc_nulls_last(), "demographic_no")
    first = each.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= page)
    return first.groupBy("key").agg(F.expr(f"sort_array(collect_list(struct(pos, {shown})))").alias("hits"))


def form_fields(forms: DataFrame, as_of: date, keep: tuple[str, ...] = ()) -> DataFrame:
    """form_id, ok (has identifiers), fl, ff, fe, cands (readings of the written date), readings, and the columns to `keep`."""
    cols = forms.columns
    written = "coalesce(nullif(dob_raw, ''), dob)" if "dob" in cols else "dob_raw"
    supplied = "supplied_email" if "supplied_email" in cols else "cast(null as string)"
    f = forms.select(
        "form_id", "first_name", "last_name", "email",
        norm(F.col("last_name")).alias("fl"),
        norm(F.col("first_name")).alias("ff"),
        F.coalesce(F.nullif(norm(F.col("email")), F.lit("")), norm(F.expr(supplied))).alias("fe"),
        F.expr(written).alias("written"),
        *(["dob"] if "dob" in cols else []), *[F.col(c).alias(f"_keep_{c}") for c in keep],
    ).withColumn("cands", dob_candidates("written", as_of))
    if "dob" not in cols:
        f = f.withColumn("dob", preferred_reading("written", "cands"))
    # The gate is a flag until the keys are made: a pushed-down filter would read the dates again.
    f = f.withColumn(
        "ok", has_minimum_identifiers(F.col("first_name"), F.col("last_name"), F.col("email"), F.col("dob"))
    ).withColumn("preferred", preferred_reading("dob", "cands") if "dob" in cols else F.col("dob"))
    return f.select("form_id", "ok", F.coalesce("fl", F.lit("")).alias("fl"), F.coalesce("ff", F.lit("")).alias("ff"),
                    F.coalesce("fe", F.lit("")).alias("fe"), "cands", match_readings("cands", "preferred").alias("readings"),
                    *[F.col(f"_keep_{c}").alias(c) for c in keep])


def packed(fields: DataFrame) -> DataFrame:
    """`form_fields` as they travel: readings as dates of four bytes, and as text only where no reading is a real date."""
    rest = [c for c in fields.columns if c not in ("cands", "readings")]
    return fields.selectExpr(*rest, "transform(cands, x -> cast(x as date)) as days", "if(size(cands) > 0, null, readings) as text_only")


def unpacked(fields: DataFrame) -> DataFrame:
    """The `form_fields` that were `packed`."""
    rest = [c for c in fields.columns if c not in ("days", "text_only")]
    return fields.selectExpr(*rest, "text_only", "transform(days, x -> cast(x as string)) as cands").selectExpr(
        *rest, "cands", "coalesce(text_only, cands) as readings")


_FORM = {"l": "fl", "f": "ff", "e": "fe", "l3": "substr(fl, 1, 3)", "f3": "substr(ff, 1, 3)", "d": "x"}


# What a form asks for; a role travels as its place in this list.
ROLES = ("name", "prefix", "mail", "mail_sure", "near", "dated", "both")


def _asks(role: str | int, kind: str, dates: str | None = None) -> str:
    """SQL array of the keys a form asks in one role, one per reading where the key has a date."""
    ask = f"struct({f"'{role}'" if isinstance(role, str) else f'{role}Y'} as role, {_key(kind, _FORM)} as key)"
    return f"array({ask})" if dates is None else f"transform({dates}, x -> {ask})"


def form_counts(forms: DataFrame, charts: DataFrame, as_of: date, modes: tuple[str, ...] = ("name", "prefix", "email", "list")) -> DataFrame:
    """For each form and role, the number of charts in the whole registry, and which it is where one key has one alone.

    name, prefix: charts that would be sure in that tier; mail: charts of the
    e-mail, mail_sure: sure ones of them; near, dated, both: charts with the
    name's prefixes, with a reading of the date, with both.
    """
    return _counts(form_fields(forms, as_of), charts, as_of, modes)


def _counts(fields: DataFrame, charts: DataFrame, as_of: date, modes: tuple[str, ...]) -> DataFrame:
    """`form_counts` of form_fields. Only what was found travels back to its form."""
    name, prefix, mail, mail_sure, near, dated, both = range(len(ROLES))
    asks = {
        "name": [f"if(size(readings) > 0, {_asks(name, 'nd', 'readings')}, {_asks(name, 'n')})"],
        "prefix": [f"""case when ff <> '' and size(readings) > 0 then {_asks(prefix, 'pd', 'readings')}
            when ff <> '' then {_asks(prefix, 'p')} when size(readings) > 0 then {_asks(prefix, 'ld', 'readings')}
            else array() end"""],
        "email": [_asks(mail, "e"), f"if(size(readings) > 0, {_asks(mail_sure, 'eld', 'readings')}, {_asks(mail_sure, 'elf')})"],
        "list": [_asks(near, "p"), _asks(dated, "d", "cands"), _asks(both, "pd", "cands")],
    }
    wanted = ", ".join(x for m in modes for x in asks[m])
    kinds = tuple(k for k in KEYS if any(f"'{k}'," in x for m in modes for x in asks[m]))
    asked = fields.selectExpr("form_id", "size(readings) > 0 as dated_form", f"inline(if(ok, concat({wanted}), array()))").where("key is not null")
    found = resharded_join(asked, key_index(charts, as_of, kinds), ["key"])
    # grouped without partial rows, which would hold a column for each role of a form
    found = found.selectExpr("form_id", "dated_form", "role", "charts", "if(charts = 1, first, null) as first").repartition("form_id")
    return found.groupBy("form_id").agg(
        F.first("dated_form").alias("dated_form"),
        *[F.coalesce(F.sum(F.when(F.col("role") == i, F.col("charts"))), F.lit(0)).alias(r) for i, r in enumerate(ROLES)],
        *[F.min(F.when(F.col("role") == i, F.col("first"))).alias(f"{r}_no") for i, r in enumerate(ROLES[:4])],
    )


_REASON = f"if(dated_form, '{BY_DATE}', '{BY_NAME}')"
# The match of one tier, from the counts of a form; null where not exactly one chart is sure.
TIERS = {
    "name": f"if(name = 1, struct(name_no as demographic_no, concat('exact name: ', {_REASON}) as matched_by), null)",
    "prefix": f"if(prefix = 1, struct(prefix_no as demographic_no, concat('partial name (3+3): ', {_REASON}) as matched_by), null)",
    "email": f"""case when mail = 1 then struct(mail_no as demographic_no, 'email' as matched_by)
        when mail_sure = 1 then struct(mail_sure_no as demographic_no, concat('email: ', {_REASON}) as matched_by) end""",
    "email_dated": f"""if(dated_form and mail_sure = 1,
        struct(mail_sure_no as demographic_no, concat('email: ', {_REASON}) as matched_by), null)""",
}


def tier_matches(forms: DataFrame, charts: DataFrame, as_of: date, mode: str) -> DataFrame:
    """Forms one tier alone would link: form_id, demographic_no, matched_by."""
    found = form_counts(forms, charts, as_of, (mode,)).selectExpr("form_id", f"{TIERS[mode]} as m")
    return found.where("m is not null").selectExpr("form_id", "m.demographic_no", "m.matched_by")


def match_forms(forms: DataFrame, charts: DataFrame, as_of: date, decisions: DataFrame | None = None,
                require_dob: bool = False) -> DataFrame:
    """Every form with its match (or null), how it was found, and review_total.

    Tiers: exact name, partial name, an operator's choice, e-mail. The first tier
    that resolves wins, and forms that a name links ask for nothing else. review_total counts the charts a reviewer could choose
    from (same prefixes of both names, or a date equal to a reading) where no
    name tier resolved; a choice of any of them is valid, listed or not. With
    `require_dob` an e-mail links only to a chart that the form's date confirms.
    """
    return match_fields(packed(form_fields(forms, as_of)), charts, as_of, decisions, require_dob)


def match_fields(fields: DataFrame, charts: DataFrame, as_of: date, decisions: DataFrame | None = None, require_dob: bool = False) -> DataFrame:
    """`match_forms` of forms whose `form_fields` are at hand, `packed`."""
    email = TIERS["email_dated" if require_dob else "email"]
    fields = fields.select("form_id", "ok", "fl", "ff", "fe", "days", "text_only")
    named = _counts(unpacked(fields), charts, as_of, ("name", "prefix")).selectExpr("form_id", f"coalesce({TIERS['name']}, {TIERS['prefix']}) as by_name")
    whole, fields = fields, fields.join(named, "form_id", "left")
    rest = _counts(unpacked(fields.where("by_name is null")), charts, as_of, ("email", "list")).selectExpr(
        "form_id", f"{email} as by_email", "near + dated - both as others")
    base = fields.select("form_id", "by_name").join(rest, "form_id", "left")
    if decisions is None:
        base = base.withColumn("chosen", F.lit(None).cast("string"))
    else:
        base = base.join(_valid_choices(unpacked(whole), charts, as_of, decisions), "form_id", "left")
    return base.selectExpr(
        "form_id",
        f"""case when by_name is not null then by_name
            when chosen is not null then struct(chosen as demographic_no, '{CHOSEN}' as matched_by)
            else by_email end as m""",
        "if(by_name is null, coalesce(others, 0), 0) as review_total",
    ).selectExpr("form_id", "m.demographic_no", "m.matched_by", "review_total")


def valid_choices(forms: DataFrame, charts: DataFrame, as_of: date, decisions: DataFrame) -> DataFrame:
    """form_id and chosen: the latest choice of each form, if that chart could be on its review list."""
    return _valid_choices(form_fields(forms, as_of), charts, as_of, decisions)


def _valid_choices(fields: DataFrame, charts: DataFrame, as_of: date, decisions: DataFrame) -> DataFrame:
    latest = decisions.groupBy("form_id").agg(F.max_by("demographic_no", "decided_at").alias("demographic_no"))
    asked = latest.join(fields.where("ok"), "form_id")
    seen = resharded_join(asked, _charts(charts, as_of).drop("dob", "e", "seq"), ["demographic_no"])
    return seen.where(f"({_LAST3.replace('h.', '')} and {_FIRST3.replace('h.', '')}) or coalesce(array_contains(cands, d), false)").selectExpr(
        "form_id", "demographic_no as chosen").dropDuplicates(["form_id"])


def search_pages(forms: DataFrame, charts: DataFrame, as_of: date, modes: tuple[str, ...], page: int = REVIEW_LIST_SIZE,
                 beside: DataFrame | None = None, how: str = "left", shown: str = "demographic_no, dob, l, f, d") -> DataFrame:
    """Each search of each form (mode, reading, ord) with the first charts of its key.

    `beside` (form_id and what callers need beside the hits) is joined to the
    forms by `how` before they search, so that hits need not travel again.
    """
    asks = {
        "name": _asks("name", "n"), "prefix": f"if(ff <> '', {_asks('prefix', 'p')}, {_asks('prefix', 's')})", "dob": _asks("dob", "d", "cands"),
    }
    kinds = tuple(k for k, m in (("n", "name"), ("p", "prefix"), ("s", "prefix"), ("d", "dob")) if m in modes)
    wanted = ", ".join(asks[m] for m in modes)
    f, more = form_fields(forms, as_of), []
    if beside is not None:
        f = f.join(beside, "form_id", how)
        more = [c for c in f.columns if c in beside.columns and c != "form_id"]
    f = f.selectExpr("form_id", "fl", "ff", "cands", "readings", *more, f"inline(if(ok, concat({wanted}), array()))").where("key is not null")
    f = f.selectExpr("form_id", "fl", "ff", "readings", *more, "role as mode", "key",
                     "if(role = 'dob', substr(key, 3), null) as reading", "array_position(cands, substr(key, 3)) as ord")
    return resharded_join(f, search_index(charts, as_of, page, kinds, shown), ["key"])


def review_rows(matches: DataFrame, forms: DataFrame, charts: DataFrame, as_of: date, size: int = REVIEW_LIST_SIZE) -> DataFrame:
    """The first `size` charts of each review list, in search order, with review_total.

    Exact names come first, then prefixes, then each reading of the date; a chart
    is listed once, with a note where only the name agrees. Since each key's
    first `size` charts are at hand, duplicates never shorten a list. Only forms
    that have a list search, and rows of lists are not shuffled.
    """
    open_forms = matches.where("review_total > 0").select("form_id", "review_total")
    pages = search_pages(forms, charts, as_of, ("name", "prefix", "dob"), size, open_forms.select("form_id").distinct(), "left_semi",
                         "demographic_no, dob").where("not startswith(key, 's\\u0001')")
    rank = "case mode when 'name' then 0 when 'prefix' then 1 else 2 end"
    # a list whose first charts all differ needs no comparison of all with all
    first, repeats = f"slice(listed, 1, {size})", f"array_size(array_distinct(array_compact(slice(ids, 1, {size})))) < least({size}, array_size(ids))"
    lists = pages.selectExpr("form_id", f"{rank} as tier", "ord", "hits").repartition("form_id").groupBy("form_id").agg(
        F.expr("sort_array(collect_list(struct(tier, ord, hits))) as s")).selectExpr(
        "form_id", """flatten(transform(s, x -> transform(x.hits, h -> struct(h.demographic_no, h.dob, x.tier < 2 as named)))) as listed"""
    ).selectExpr("form_id", "listed", "listed.demographic_no as ids").selectExpr(
        "form_id", f"if({repeats}, slice(filter(listed, (x, i) -> array_position(ids, x.demographic_no) = i + 1), 1, {size}), {first}) as review")
    written = "dob" if "dob" in forms.columns else "dob_raw"
    side = forms.select("form_id", F.col(written).alias("w")).withColumn("c", dob_candidates("w", as_of)).select(
        "form_id", F.coalesce(preferred_reading("w", "c"), F.nullif("w", F.lit("")), F.lit("?")).alias("form_dob"))
    shown = lists.join(open_forms.join(side, "form_id"), "form_id").selectExpr("form_id", "review_total", "form_dob", "posexplode(review) as (pos, r)")
    return shown.selectExpr(
        "form_id", "review_total", "cast(pos + 1 as bigint) as position", "r.demographic_no",
        """if(r.named, concat('Name matches; form DOB ', form_dob, ', chart DOB ',
             coalesce(nullif(r.dob, ''), '?')), null) as note""",
    )


def not_found(forms: DataFrame, matches: DataFrame) -> DataFrame:
    """Forms without a match; nothing may be written for them."""
    return forms.join(matches.where("demographic_no is not null"), "form_id", "left_anti")
