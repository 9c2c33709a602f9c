"""Input columns named like the operators' own helpers, odd id types, repeated and null ids; line rules of a large host."""

import duckdb
import pytest
from pyspark.sql import functions as F

from formloom.llm import byte_bpe, importance, line_rules, near_text, packing, pairwise, pii, toxicity

P = pytest.importorskip("public_tokenizers")
RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
HELPERS = ["_key", "_first", "_host", "_id", "_id2", "_text", "_words", "_lines", "_windows", "_again", "_removed", "_removed_words", "_h", "_order", "_reshard_hash2", "key", "cid",
           "root", "n", "sig", "h", "k", "good", "pos", "part", "ids", "line", "weight", "rank", "text_hash", "n_features"]
TEXTS = ["one two three four five six seven eight", "one two three four five six seven eight", None, "", "Mail a.b@example.org or 10.1.2.3 now\nsame line", "x y z " * 40]


def docs_of(spark, kind):
    rows = [(i, t, "en", "s") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "en", "s"), (None, TEXTS[0], None, None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string, source string").withColumn("doc_id", F.col("doc_id").cast(kind))
    return df.withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in HELPERS})


def untouched(df):
    bad = [F.col(f"`{c}`") != F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in HELPERS if c in df.columns]
    assert len(bad) >= len(HELPERS)
    any_bad = bad[0]
    for b in bad[1:]:
        any_bad = any_bad | b
    return df.where(any_bad).count() == 0


@pytest.mark.parametrize("kind", ["long", "smallint", "string", "decimal(12,0)"])
def test_helper_names_stay_the_users(spark, kind):
    docs = docs_of(spark, kind)
    kept = near_text.deduplicate(docs)
    assert kept.columns == docs.columns and untouched(kept) and kept.count() == 6
    judged = line_rules.judge(docs)
    assert judged.columns[: len(docs.columns)] == docs.columns and untouched(judged) and judged.count() == docs.count()
    scored = toxicity.score(docs, toxicity.Model(), keep=True)
    assert untouched(scored) and scored.count() == docs.count()
    assert pairwise.score(docs, pairwise.Model(), keep=True).count() == docs.count()
    packed = packing.pack(docs, WORDS, size=16, open_windows=2, keep_ids=False)
    assert packed.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    assert packed.agg(F.sum("length")).first()[0] == packed.where("start = 0").agg(F.sum("doc_tokens")).first()[0]
    assert near_text.join(docs).count() == byte_bpe.encode(docs, RANKS, P.PATTERN).count() == pii.extract(docs).count() == docs.count()
    drawn = importance.resample(docs, docs.select("text"), percent=100, least_words=1, buckets=50)
    assert drawn.columns == docs.columns and untouched(drawn) and drawn.count() == 6
    none = docs.where("false")
    assert near_text.deduplicate(none).count() == line_rules.judge(none).count() == packing.pack(none, WORDS).count() == 0


def test_line_rules_of_a_large_host_equal_the_sql(spark, tmp_path):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{words} {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}\n" + ("shared footer line of the site\n" * (i % 50 == 0)) + ("rare line\n" if i < 15 else ""), "big" if i < 1400 else "small") for i in range(1500)]
    rows += [(2000 + i, "shared footer line of the site " * 12 + f"\nunique {i} " + words[:30], "big") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(line_rules.ORACLES["op9_line_rules"])
    names = [d[0] for d in want.description]
    got = line_rules.op9_line_rules(spark, str(tmp_path)).select(*names).collect()
    assert sorted(tuple(r) for r in got) == sorted(want.fetchall())
    removed = {r.doc_id: r.removed_words for r in got}
    assert removed[50] == 6 and removed[1450] == 0 and removed[1] == 0  # 28 texts of the large host hold the line, 2 of the small one
