"""Quality rules by cross-document line frequency, with DataFrame functions only (operator 9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.llm.common import SPACES, aside, table
from formloom.operators.skew import resharded_join

GAP = r"[\x20\x09-\x0D]+"
TEXT = ["_host", "_id", "_id2"]
MARKS = r"[#*$%&|<>]"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, GAP), "")


def lines(text: Column) -> Column:
    """The \\n-separated lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x, F.lit(SPACES))) > 0)


def normal(line: Column) -> Column:
    """Lower case, digits as 0, white space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.translate(F.lower(line), "123456789", "000000000"), GAP, " "))


def measured(docs: DataFrame) -> DataFrame:
    """The columns of `docs` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

    A null text has no words. Everything is computed inside the row: 3-word
    windows are hashed, sorted with their places, and those with an equal
    neighbour mark their three words. No window is compared with all others.
    """
    step = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    step = step.withColumns({"_words": words(F.col("_text")), "_lines": lines(F.col("_text"))})
    at = F.transform("_words", lambda w, i: F.struct(F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"), i.alias("p")))
    step = step.withColumn("_windows", F.sort_array(F.slice(at, 1, F.greatest(F.size("_words") - 2, F.lit(0)))))
    again = F.filter("_windows", lambda x, i: (x.h == F.get("_windows", i - 1).h) | (x.h == F.get("_windows", i + 1).h))
    step = step.withColumn("_again", F.sort_array(F.transform(again, lambda x: x.p)))
    covered = F.aggregate(
        "_again", F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a.n + F.least(F.lit(3), p - a.last)).alias("n")), lambda a: a.n)
    return step.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.regexp_count("_text", F.lit(MARKS)).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": covered,
    }).drop("_text", "_words", "_lines", "_windows", "_again")


def _keys(docs: DataFrame, host: str) -> list[Column]:
    """A host key that no null equals by chance, and 96 bits of two hashes of the text."""
    return [F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit("")).alias("_host"),
            F.xxhash64("text").alias("_id"), F.hash("text").alias("_id2")]


def removed_lines(docs: DataFrame, host: str = "source", least: int = 20) -> DataFrame:
    """_host, _id, _id2, _removed_words, _removed: the lines above the limit in each distinct text that has one.

    A normalised line counts each distinct text of a host once; whole copies are
    left to deduplication. It is above the limit in more than `least` texts,
    however many the host has. Copies are summed before each shuffle, so a hot
    line, text or host is one row a task.
    """
    texts = docs.where(F.col("text").isNotNull()).select(*_keys(docs, host), F.col("text").alias("_text"))
    every = F.transform(lines(F.col("_text")), lambda x: F.struct(F.xxhash64(normal(x)).alias("line"), F.size(words(x)).alias("n")))
    found = texts.select(*TEXT, F.inline(every)).groupBy(*TEXT, "line").agg(F.sum("n").alias("n"))
    copies = texts.groupBy(*TEXT).agg(F.count("*").alias("_copies"))
    # every line has a word; with its sum in both branches, the exchange of `found` is made once
    often = found.groupBy("_host", "line").agg(F.count_if(F.col("n") > 0).alias("_in")).where(F.col("_in") > least).select("_host", "line")
    gone = resharded_join(found, often, ["_host", "line"]).groupBy(*TEXT)
    gone = gone.agg(F.sum("n").alias("_n"), F.collect_set("line").alias("_removed"))
    return gone.join(copies, TEXT).select(*TEXT, F.expr("_n div _copies").alias("_removed_words"), "_removed")


def judge(docs: DataFrame, host: str = "source", least: int = 20, min_words: int = 50,
          min_left_percent: int = 30) -> DataFrame:
    """The columns of `docs` with the measures, removed_words, base_failed, kept and clean_text.

    `docs` needs text and the `host` column. base_failed: fewer than `min_words`
    words, or more than half of them in repeated windows. kept: not base_failed,
    and at least `min_left_percent` of the words left when the lines above the
    limit are removed (clean_text; null for a null text). A null text has no
    words and fails; null hosts form a host of their own; repeated rows each give
    a row. Columns of `docs` with the names of the new ones are replaced, all
    others stay, whatever their names.
    """
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", "base_failed", "kept", "clean_text"]
    docs, columns = aside(docs.drop(*new), [*TEXT, "_text", "_words", "_lines", "_windows", "_again", "_removed_words", "_removed"])
    rows = measured(docs).withColumns(dict(zip(TEXT, _keys(docs, host), strict=True)))
    gone = removed_lines(docs, host, least)
    rows = resharded_join(rows, gone, TEXT, "left").withColumn("removed_words", F.coalesce("_removed_words", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = 100 * (F.col("n_words") - F.col("removed_words")) >= min_left_percent * F.col("n_words")
    stay = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("_removed", F.xxhash64(normal(x))))
    clean = F.when(F.col("_removed").isNull(), F.col("text")).otherwise(F.array_join(stay, "\n"))
    return rows.withColumns({"base_failed": failed, "kept": ~failed & left, "clean_text": clean}).select(*columns, *new)


def op9_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


QUERIES = {"op9_line_rules": op9_line_rules}
ORACLES = {"op9_line_rules": r"""
with d as (select row_number() over () as r, doc_id, text, coalesce('=' || source, '') as host from documents),
w as (select r, unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) as w,
             generate_subscripts(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''), 1) as p from d),
g as (select r, p, w, lead(w) over o as w2, lead(w, 2) over o as w3 from w window o as (partition by r order by p)),
a as (select r, p, count(*) over (partition by r, w, w2, w3) as n from g where w3 is not null),
cov as (select r, count(distinct p + i) as n_repeat_words from a, range(3) t(i) where n > 1 group by r),
tot as (select r, count(*) as n_words, sum(length(w)) as word_chars from w group by r),
l as (select r, unnest(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) as line from d),
dup as (select r, count(*) - count(distinct line) as n_dup_lines from l group by r),
norm as (select r, trim(regexp_replace(translate(lower(line), '123456789', '000000000'), '[\x20\x09-\x0D]+', ' ', 'g')) as nl,
                len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) as n from l),
seen as (select d.host, nl, count(distinct d.text) as k from norm join d using (r) group by all),
often as (select host, nl from seen where k > 20),
gone as (select r, sum(n) as removed_words from norm join d using (r) join often using (host, nl) group by r),
m as (select doc_id, coalesce(n_words, 0) as n_words, coalesce(word_chars, 0) as word_chars,
        length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
        coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(removed_words, 0) as removed_words
      from d left join tot using (r) left join dup using (r) left join cov using (r) left join gone using (r))
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
  n_repeat_words::bigint as n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 100 * (n_words - removed_words) >= 30 * n_words as kept,
  removed_words::bigint as removed_words from m
"""}
