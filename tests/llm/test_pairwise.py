"""The pairwise quality classifier against plain versions, held-out labels and odd tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from formloom.llm import pairwise
from formloom.llm.common import remainder

SF = "/root/testdata/sf0.01"
ODD = [None, "", " ", "\n\n", "a", "ÉTÉ!! NON!!", "x" * 50_000, "the the the cat\nthe cat\n\nthe cat", "a | b | c", "12 34%%% 5.", "퟿ emoji 👩"]


def plain_measures(text):
    text = text or ""
    data, words, lines = text.encode(), text.split(), [x for x in text.split("\n") if x.strip()]
    n = max(len(words), 1)
    out = [math.sqrt(sum(chr(b) in g for b in data) / max(len(data), 1)) for g in pairwise.GROUPS]
    out.append(math.sqrt(sum(b > 127 for b in data) / max(len(data), 1)))
    share = lambda found: math.sqrt(sum(found) / n)
    return out + [
        math.log(1 + len(words)), math.log(1 + sum(len(w) for w in words) / n), math.sqrt(len({*words}) / n),
        math.sqrt(len({(words[i], words[i + 1]) for i in range(len(words) - 1)}) / max(n - 1, 1)),
        share(words[i] == words[i + 1] for i in range(len(words) - 1)), share(w == w.upper() != w.lower() for w in words), share(w[0].isupper() for w in words),
        share(not w[-1].isalnum() for w in words), share(len(w) == 1 and not w.isalnum() for w in words), math.log(1 + len(lines)),
        math.log(1 + n / max(len(lines), 1)), math.sqrt(len({*lines}) / max(len(lines), 1)), share(len(w) > 24 for w in words)]


def test_measures_against_a_plain_version():
    for text in ODD:
        assert np.allclose(pairwise.measures(text), plain_measures(text)), text
    assert len(pairwise.measures("x")) == len(pairwise.MEASURES)


def test_pairs_meet_all_documents():
    good, bad = pairwise.pairs(10, 4, 3)
    assert len(good) == len(bad) == 30 and (np.bincount(good) == 3).all()
    assert set(np.bincount(bad)) <= {6, 7, 8, 9} and len(set(bad)) == 4


def test_weights_are_the_least_loss_of_the_pairs():
    rng = np.random.default_rng(4)
    good, bad = rng.normal(0.4, 1, (300, 5)), rng.normal(0, 1, (300, 5))
    w, v = pairwise.bradley_terry(good, bad, 0.01, 50), np.zeros(5)
    for _ in range(4000):  # plain gradient steps on the same loss
        slope = 0.01 * v
        for x in good - bad:
            slope -= x / (1 + math.exp(x @ v)) / 300
        v -= 0.5 * slope
        if abs(slope).max() < 1e-7:
            break
    assert np.allclose(w, v, atol=1e-4)


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = pairwise.op12_pairwise(spark, SF).join(labels, "doc_id").where("held_out").collect()
    right = [r.predicted == r.quality for r in got]
    assert len(got) > 50 and np.mean(right) > 0.95
    order = np.argsort([r.score for r in got])
    good = np.array([r.quality == 1 for r in got])[order]
    ranks = np.flatnonzero(good)
    assert (ranks.sum() - good.sum() * (good.sum() - 1) / 2) / (good.sum() * (~good).sum()) > 0.98
    assert pairwise.op12_pairwise(spark, SF).count() == docs.count()


@pytest.mark.parametrize("kind", ["long", "smallint", "string"])
def test_odd_tables(spark, kind):
    rows = [(i, t, "s", 5, "x") for i, t in enumerate([*ODD, *["Good plain words go here, and on."] * 5])]
    docs = spark.createDataFrame(rows, "doc_id int, text string, score string, predicted int, h string").withColumn("doc_id", F.col("doc_id").cast(kind))
    docs = docs.union(docs.where("doc_id < 4")).union(docs.limit(2).withColumn("doc_id", F.lit(None).cast(kind)))
    labels = spark.createDataFrame([(i, int(i > 10)) for i in range(16)] + [(3, 1), (99, 0), (None, 1), (5, None)], "doc_id int, quality int").withColumn("doc_id", F.col("doc_id").cast(kind))
    learn = remainder("doc_id", 3) != 1
    model = pairwise.fit(docs, labels, learn, fit_rows=10)
    got = pairwise.score(docs, model, keep=True)
    assert got.count() == docs.count() and got.columns == ["doc_id", "text", "h", "score", "predicted"]
    assert {r.doc_id: r.predicted for r in got.collect()}[str(12) if kind == "string" else 12] == 1
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.collect())
    assert pairwise.score(docs.where("false"), model).count() == 0
    none = pairwise.score(docs, pairwise.fit(docs, labels.where("false"), learn)).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.5, 1)}
    one = pairwise.score(docs, pairwise.fit(docs, labels.where("quality = 0"), learn)).collect()
    assert {r.predicted for r in one} == {0}
    assert pairwise.fit(docs.where("false"), labels, learn).threshold == 0


def test_every_labelled_document_counts(spark):
    rng = np.random.default_rng(1)
    words = [["plain", "good", "prose"], ["XX", "!!", "%%%"]]
    rows = [(i, " ".join(rng.choice(words[i % 3 == 0 if rng.random() < 0.9 else i % 2], 40)), int(i % 3 > 0)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    found = pairwise.labelled(docs, docs, F.lit(True))
    assert found.count() == 400
    here, apart = (pairwise.fit(docs, docs, F.lit(True), fit_rows=n) for n in (400, 100))
    x = np.array([pairwise.measures(r[1]) for r in rows])
    assert np.allclose(apart.mean, x.mean(0)) and np.allclose(here.mean, x.mean(0))
    raw = np.sort(apart.features(x) @ apart.weights)
    bad = sum(r[2] == 0 for r in rows)
    assert apart.threshold == pytest.approx(float(np.quantile(raw, bad / 400, method="midpoint")))
    assert np.corrcoef(here.scores(x), apart.scores(x))[0, 1] > 0.99
    sizes = {True: 400 - bad, False: bad}
    met = pairwise.met(found, sizes, 4).collect()
    assert len(met) == 4 * (400 - bad) and len({tuple(r.good) for r in met}) == len({tuple(v) for v, r in zip(x.tolist(), rows, strict=True) if r[2]})


def test_pairs_apart_give_the_weights_of_least_loss(spark):
    rows = [(i, "a " * (i % 7 + 1) + "B! " * (i % 5) + "x" * (i % 11), int(i % 4 == 0)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = pairwise.fit(docs, docs, F.lit(True), fit_rows=10, l2=0.01)
    met = pairwise.met(pairwise.labelled(docs, docs, F.lit(True)), {True: 30, False: 90}, 4).collect()
    good, bad = (model.features(np.array([r[c] for r in met])) for c in ("good", "bad"))
    assert len(met) == 360 and np.allclose(model.weights, pairwise.bradley_terry(good, bad, 0.01, 30), atol=1e-6)
