"""Importance resampling against a plain version, on odd texts, ids and tables."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from formloom.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [None, "", " ", "a", "Straße ÉTÉ İstanbul 你好，世界 123", "x" * 20_000, "ab " * 5_000, "A-b_c{d}e`f@g", "nbsp\xa0em x", "é" * 300 + " É"]


def brute(docs, target, least, orders, buckets, percent):
    def features(text):
        w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(orders[0], orders[1] + 1) for i in range(len(w) - k + 1)]

    s, t, out = np.zeros(buckets), np.zeros(buckets), []
    for n, table in ((s, [x for _, x in docs]), (t, target)):
        for x in table:
            for b in features(x)[1]:
                n[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets)))) for b in range(buckets)]
    for doc_id, text in docs:
        n, f = features(text)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_crcs_equal_the_library_whatever_the_lengths(monkeypatch):
    rng = random.Random(1)
    texts = [rng.randbytes(rng.choice([0, 1, 2, 3, 7, 8, 50, 301])) for _ in range(500)]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    for size in (1 << 22, 100):
        monkeypatch.setattr(importance, "MATRIX_BYTES", size)
        assert importance.crcs(data, ends).tolist() == [zlib.crc32(x) for x in texts]
    assert len(importance.crcs(data, np.zeros(1, np.int64))) == 0


@pytest.mark.parametrize("orders,slice_bytes,kind", [((1, 1), 4 << 20, "long"), ((1, 3), 64, "long"), ((2, 2), 4 << 20, "string"), ((1, 1), 64, "smallint")])
def test_ranked_against_brute_force(spark, monkeypatch, orders, slice_bytes, kind):
    monkeypatch.setattr(importance, "SLICE_BYTES", slice_bytes)
    rng = random.Random(2)
    pool = [f"w{i}" for i in range(40)] + ["Zoë", "THE", "the"]
    texts = ODD + [" ".join(rng.choices(pool, k=rng.randint(0, 60))) for _ in range(120)]
    docs = [*enumerate(texts), *list(enumerate(texts))[:15], (None, texts[20]), (None, texts[20]), (None, None)]
    target = ["the zoë w1 w2 w3 w4 " * 9, None, ""]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, rank int, text_hash string").withColumn("doc_id", F.col("doc_id").cast(kind))
    want = brute([(i if i is None or kind != "string" else str(i), t) for i, t in docs], target, 5, orders, 97, 30)
    options = {"least_words": 5, "orders": orders, "buckets": 97, "percent": 30}
    targets = spark.createDataFrame([(t,) for t in target], "text string")
    if kind != "string":  # strings tie in another order
        got = importance.ranked(df.repartition(4), targets, **options).select("doc_id", "n_features", "weight", "score", "rank").collect()
        assert sorted((tuple(r) for r in got), key=str) == want
    drawn = importance.resample(df, targets, **options)
    ids = {r[0] for r in want if r[4]}
    assert drawn.columns == df.columns and {r.doc_id for r in drawn.collect()} == ids


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    none = docs.where("false")
    assert importance.ranked(none, docs).count() == importance.resample(none, docs).count() == 0
    got = importance.ranked(docs, none, least_words=0, percent=100).orderBy("doc_id").collect()
    assert [r.n_features for r in got] == [3, 0] and {r["rank"] for r in got} == {1, 2}
