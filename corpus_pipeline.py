"""Documents to packed training sequences: language, toxicity, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.llm import language, near_text, packing, pii, toxicity
from formloom.llm.common import aside, prepared, remainder, table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay; null texts and those without a letter go."""
    rows, columns = aside(docs, ["lang_pred", "score"])
    samples = language.fit(docs, remainder("doc_id", 5) != 0)
    return language.identify(rows, samples, keep=True).where("lang_pred <> 'und'").select(columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.5 stay."""
    rows, columns = aside(docs, ["score", "predicted"])
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    return toxicity.score(rows, model, keep=True).where("predicted = 0").select(columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return near_text.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each span found is replaced by its kind in brackets; n_chars follows the text."""
    rows, columns = aside(docs, pii.COLUMNS)
    out = pii.mask(pii.extract(rows, keep=True)).select(columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences with their ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", language_id),
    ("toxicity", toxic),
    ("near-duplicates", near_duplicates),
    ("personal data", personal_data),
    ("packing", packed),
]
#: The stages learn models, follow links and tokenize: SQL cannot state their rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepared(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
