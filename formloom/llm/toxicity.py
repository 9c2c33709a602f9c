"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios (operator 5)."""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.llm.common import map_batches, release, remainder, table, written

#: Character n-grams of these lengths, inside a word and its two blanks.
ORDERS = (3, 4, 5)
BUCKETS = 1 << 18
STORE_WORDS = 200_000


@dataclass(frozen=True)
class Model:
    """buckets: chosen features, ascending; weights: slope x log-count ratio of each; empty without both labels."""

    buckets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -40.0


def grams(word: str) -> set[int]:
    w = f" {word} "
    return {zlib.crc32(w[i : i + n].encode()) & (BUCKETS - 1) for n in ORDERS for i in range(len(w) - n + 1)}


class Features:
    """The chosen features of texts; words are met again and again, so each worker keeps theirs."""

    def __init__(self, buckets: np.ndarray | None = None):
        self.at = None if buckets is None else {int(b): i for i, b in enumerate(buckets)}
        self.store: dict[str, tuple[int, ...]] = {}

    def of_word(self, word: str) -> tuple[int, ...]:
        found = grams(word)
        out = tuple(found) if self.at is None else tuple(self.at[g] for g in found if g in self.at)
        if len(word) <= 64:
            if len(self.store) >= STORE_WORDS:
                self.store.clear()
            self.store[word] = out
        return out

    def of_text(self, text: str | None) -> np.ndarray:
        get, found = self.store.get, set()
        for w in set((text or "").lower().split()):
            x = get(w)
            if x is None:
                x = self.of_word(w)
            if x:
                found.update(x)
        return np.fromiter(found, np.int64, len(found))


def labelled(docs: DataFrame, labels: DataFrame, learn: Column, fit_rows: int) -> DataFrame:
    """toxic and text of at most `fit_rows` labelled documents, those with the smallest hashes of their ids.

    A document labelled twice counts as toxic if any label says so. The chosen
    ids are at most `fit_rows`, so they may be broadcast.
    """
    one = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = one.where(learn).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text")


def counts(rows: DataFrame) -> DataFrame:
    """bucket, positive, negative: documents of each label that hold the bucket's n-grams; one row a task and bucket, summed."""

    def run(batches):
        import pyarrow as pa

        f, n = Features(), np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for toxic, text in zip(batch.column(0), batch.column(1), strict=True):
                n[int(toxic.as_py() == 1), f.of_text(text.as_py())] += 1
        at = np.flatnonzero(n.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[1, at]), pa.array(n[0, at])], names=["bucket", "positive", "negative"])

    each = rows.select("toxic", "text").mapInArrow(run, "bucket long, positive long, negative long")
    return each.groupBy("bucket").agg(F.sum("positive").alias("positive"), F.sum("negative").alias("negative"))


def logistic(x: np.ndarray, y: np.ndarray, l2: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Slopes and bias of least l2-penalised logistic loss, by accelerated gradient steps."""
    w, v, b, vb = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32), 0.0, 0.0
    z, g = np.ones(x.shape[1], np.float32), 1.0
    for _ in range(12):  # the largest singular value of the rows, for the step length
        z = x.T @ (x @ z)
        g = float(np.linalg.norm(z))
        z /= max(g, 1e-12)
    step = 1.0 / (0.25 * g / len(x) + l2 + 0.25)
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ v + vb, -30, 30)))
        d = (p - y).astype(np.float32)
        nw, nb = v - step * (x.T @ d / len(x) + l2 * v), vb - step * float(d.mean())
        m = k / (k + 3)
        v, vb, w, b = nw + m * (nw - w), nb + m * (nb - b), nw, nb
    return w, b


def fit(docs: DataFrame, labels: DataFrame, learn: Column, fit_rows: int = 8192, features: int = 1536,
        least_documents: int = 5, least_z: float = 3.0, l2: float = 1e-3) -> Model:
    """The model of a bounded sample of `fit_rows` labelled documents, whole texts.

    Log-count ratios come from the documents of either label that hold an n-gram;
    the `features` with the most significant ratios enter the classifier, each
    scaled by its ratio. The driver gets at most fit_rows x features bits.
    """
    rows = written(labelled(docs, labels, learn, fit_rows), "toxicity-sample")
    sizes = {r.toxic: r.n for r in rows.groupBy((F.col("toxic") == 1).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model(bias=40.0 if 1 in sizes else -40.0)
    p, q = F.col("positive") + 0.5, F.col("negative") + 0.5
    ratio = F.log(p / (sizes[1] + 1.0)) - F.log(q / (sizes[0] + 1.0))
    z = ratio / F.sqrt(1 / p - 1 / F.lit(sizes[1] + 1.0) + 1 / q - 1 / F.lit(sizes[0] + 1.0) + 1e-9)
    scored = counts(rows).where(F.col("positive") + F.col("negative") >= least_documents).select("bucket", ratio.alias("r"), F.abs(z).alias("z"))
    best = scored.where(F.col("z") >= least_z).orderBy(F.desc("z"), "bucket").limit(features).toPandas().sort_values("bucket")
    buckets, ratios = best["bucket"].to_numpy(), best["r"].to_numpy()
    if not len(buckets):
        return Model(bias=float(np.log(sizes[1] / sizes[0])))

    def make():
        f = Features(buckets)

        def run(batch):
            bits = np.zeros((batch.num_rows, len(buckets)), bool)
            for i, text in enumerate(batch.column(1)):
                bits[i, f.of_text(text.as_py())] = True
            yield {"toxic": batch.column(0), "bits": [x.tobytes() for x in np.packbits(bits, axis=1)]}

        return run

    sample = map_batches(rows.select(F.col("toxic").cast("int").alias("toxic"), "text"), make, "toxic int, bits binary").toPandas()
    bits = np.unpackbits(np.frombuffer(b"".join(sample["bits"]), np.uint8).reshape(len(sample), -1), axis=1, count=len(buckets))
    w, b = logistic(bits.astype(np.float32) * ratios.astype(np.float32), (sample["toxic"].to_numpy() == 1).astype(np.float32), l2)
    return Model(buckets, w * ratios, b)


def score(docs: DataFrame, model: Model, keep: bool = False) -> DataFrame:
    """score (0 to 1) and predicted (score >= 0.5) for each document, beside doc_id or (keep) all its columns.

    `docs` needs doc_id and text; nothing else is read. Null and empty texts hold
    no n-gram and get the score of the bias. Repeated rows each give a row.
    """

    def make():
        f = Features(model.buckets)

        release()

        def run(batch):
            texts = batch.column(batch.schema.get_field_index("text"))
            raw = np.array([model.bias + model.weights[f.of_text(x.as_py())].sum() for x in texts])
            s = 1 / (1 + np.exp(-np.clip(raw, -40, 40)))
            out = dict(zip(batch.schema.names, batch.columns, strict=True)) if keep else {"doc_id": batch.column(0)}
            yield out | {"score": s, "predicted": (s >= 0.5).astype(np.int32)}

        return run

    columns = docs.drop("score", "predicted") if keep else docs.select("doc_id", "text")
    kept = columns.schema if keep else docs.select("doc_id").schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return map_batches(columns, make, f"{schema}, score double, predicted int")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLES: dict[str, str] = {}
