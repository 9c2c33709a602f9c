"""Quality classifier by Bradley-Terry ranking of preference pairs (operator 12)."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.llm.common import map_batches, remainder, table, written
from formloom.operators.skew import numbered

#: Groups of ASCII characters whose shares are measured; fixed sets, as far as this module is concerned.
GROUPS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", "\n", ".?", "!", ",;:", "'\"-()", "|<>[]{}=/\\_", "#*$%&@^~+`")
MEASURES = [f"share of {g!r}" for g in GROUPS] + [
    "share of bytes beyond ASCII", "words", "letters a word", "distinct words", "distinct word pairs", "words equal to the one before",
    "words in capitals", "words that begin with a capital", "words that end in a mark", "bare marks", "lines", "words a line", "distinct lines", "long words"]
#: Values beyond so many deviations count as that many.
CLIP = 4.0


def group_matrix() -> np.ndarray:
    out = np.zeros((256, len(GROUPS) + 1))
    for k, group in enumerate(GROUPS):
        out[[ord(c) for c in group], k] = 1
    out[128:, -1] = 1
    return out


MATRIX = group_matrix()


def measures(text: str | None) -> list[float]:
    """MEASURES of a whole text: square roots of shares, logarithms of counts; all 0 for a null or empty text."""
    text = text or ""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    out = np.sqrt(np.bincount(data, minlength=256) @ MATRIX / max(len(data), 1)).tolist()
    words = text.split()
    n = max(len(words), 1)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    letters = sum(map(len, words))
    caps = sum(map(str.isupper, words))
    same = sum(map(str.__eq__, words, words[1:]))
    ends = sum(not w[-1].isalnum() for w in words)
    bare = sum(not w[0].isalnum() and len(w) == 1 for w in words)
    starts = sum(w[0].isupper() for w in words)
    return out + [
        math.log1p(len(words)), math.log1p(letters / n), math.sqrt(len(set(words)) / n),
        math.sqrt(len(set(zip(words, words[1:], strict=False))) / max(n - 1, 1)), math.sqrt(same / n), math.sqrt(caps / n), math.sqrt(starts / n),
        math.sqrt(ends / n), math.sqrt(bare / n), math.log1p(len(lines)), math.log1p(n / max(len(lines), 1)),
        math.sqrt(len(set(lines)) / max(len(lines), 1)), math.sqrt(sum(len(w) > 24 for w in words) / n)]


@dataclass(frozen=True)
class Model:
    """score = sigmoid(scale x (features . weights - threshold)); features are standardised measures and their squares."""

    mean: np.ndarray = field(default_factory=lambda: np.zeros(len(MEASURES)))
    spread: np.ndarray = field(default_factory=lambda: np.ones(len(MEASURES)))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(2 * len(MEASURES)))
    threshold: float = 0.0
    scale: float = 1.0

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -CLIP, CLIP)
        return np.concatenate([z, z * z], axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        raw = self.scale * (self.features(x) @ self.weights - self.threshold)
        return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))


def pairs(n_good: int, n_bad: int, rivals: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(preferred, other): each document of the larger label against `rivals` of the other, each of which is met about equally often."""
    rng, size = np.random.default_rng(seed), max(n_good, n_bad)
    good, bad = [], []
    for _ in range(rivals):
        good.append(np.resize(rng.permutation(n_good), size))
        bad.append(np.resize(rng.permutation(n_bad), size)[rng.permutation(size)])
    return np.concatenate(good), np.concatenate(bad)


def pair_sums(d: np.ndarray, w: np.ndarray) -> tuple[int, float, np.ndarray, np.ndarray]:
    """Of feature differences d, preferred less other: their number, and the sums of loss, gradient and Hessian at w."""
    p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))
    return len(d), float(np.logaddexp(0, -(d @ w)).sum()), -(d.T @ p), (d * (p * (1 - p))[:, None]).T @ d


def least_loss(sums: Callable[[np.ndarray], tuple], size: int, l2: float, rounds: int) -> np.ndarray:
    """Weights of least mean loss + l2 / 2 |w|^2 by damped Newton steps, from the `pair_sums` of all pairs at given weights.

    The loss is convex, so a few steps reach its only minimum.
    """

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        n, loss, gradient, hessian = sums(w)
        return loss / n + l2 / 2 * float(w @ w), l2 * w + gradient / n, hessian / n + l2 * np.eye(size)

    w = np.zeros(size)
    now, gradient, hessian = at(w)
    for _ in range(rounds):
        step, part = np.linalg.solve(hessian, gradient), 1.0
        if gradient @ step < 1e-10:
            break
        then = at(w - step)
        while then[0] > now and part > 1e-6:
            part /= 2
            then = at(w - part * step)
        if now - then[0] < 1e-10:
            break
        w = w - part * step
        now, gradient, hessian = then
    return w


def bradley_terry(good: np.ndarray, bad: np.ndarray, l2: float, rounds: int) -> np.ndarray:
    """Weights of least logistic loss on the feature differences of pairs.

    good and bad are the features of preferred and other documents, row by row a
    pair. The loss is mean log(1 + exp(-w . (good - bad))) + l2 / 2 |w|^2.
    """
    d = good - bad
    return least_loss(lambda w: pair_sums(d, w), d.shape[1], l2, rounds)


#: Candidates for a model's scale.
SCALES = 2.0 ** np.arange(-6, 7)


def learned(x: np.ndarray, good: np.ndarray, rivals: int, l2: float, rounds: int) -> Model:
    """The model of measures x and labels: weights from pairs, the threshold at the quantile of the scores that
    the share of bad documents sets, and a scale that makes the scores fit the labels best."""
    spread = x.std(0)
    model = Model(x.mean(0), np.where(spread > 1e-9, spread, 1.0))
    f = model.features(x)
    a, b = pairs(int(good.sum()), int((~good).sum()), rivals)
    w = bradley_terry(f[good][a], f[~good][b], l2, rounds)
    raw = f @ w
    threshold = float(np.quantile(raw, float((~good).mean()), method="midpoint"))
    sign = np.where(good, 1.0, -1.0)
    scale = min(SCALES, key=lambda s: float(np.logaddexp(0, -sign * s * (raw - threshold)).mean()))
    return Model(model.mean, model.spread, w, threshold, float(scale))


def matrix(column) -> np.ndarray:
    """The rows of an Arrow column of measures."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(MEASURES))


def met(rows: DataFrame, sizes: dict[bool, int], rivals: int) -> DataFrame:
    """(good, bad): measures of preference pairs, as `pairs` makes them, for tables of any size.

    Both labels are numbered in the order of their ids' hashes. A document of the
    larger label meets `rivals` of the smaller, evenly spread over its numbers.
    """
    more = sizes[True] >= sizes[False]
    m = min(sizes.values())
    placed = numbered(rows.select("good", "x", F.struct(F.xxhash64("doc_id"), "doc_id").alias("k")), "k", "n", ["good"])
    big = placed.where(F.col("good") == more).select(F.pmod(F.col("n") - 1, F.lit(m)).alias("at"), F.col("x").alias("good" if more else "bad"))
    few = placed.where(F.col("good") != more).select(F.col("n"), F.col("x").alias("bad" if more else "good"))
    few = few.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(rivals - 1))))
    few = few.withColumn("at", F.pmod(F.col("n") - 1 - F.col("r") * max(1, m // rivals), F.lit(m))).drop("n", "r")
    return big.join(few, "at").select("good", "bad")


def learned_apart(rows: DataFrame, sizes: dict[bool, int], rivals: int, l2: float, rounds: int) -> Model:
    """What `learned` does, over rows (doc_id, good, x) that stay where they are: tasks send sums, one row each."""
    of = lambda f: [f(F.col("x")[i]) for i in range(len(MEASURES))]
    stats = rows.agg(F.array(*of(F.avg)).alias("mean"), F.array(*of(F.stddev_pop)).alias("spread")).first()
    spread = np.array(stats.spread)
    model = Model(np.array(stats.mean), np.where(spread > 1e-9, spread, 1.0))
    against, size = written(met(rows, sizes, rivals), "quality-pairs"), len(model.weights)

    def sums(w: np.ndarray) -> tuple:
        def run(batches):
            import pyarrow as pa

            total = [0, 0.0, np.zeros(size), np.zeros((size, size))]
            for batch in batches:
                for i, x in enumerate(pair_sums(model.features(matrix(batch.column(0))) - model.features(matrix(batch.column(1))), w)):
                    total[i] = total[i] + x
            n, loss, gradient, hessian = total
            yield pa.RecordBatch.from_pydict({"n": [n], "loss": [loss], "g": [gradient.tolist()], "h": [hessian.ravel().tolist()]})

        each = against.select("good", "bad").mapInArrow(run, "n long, loss double, g array<double>, h array<double>").collect()
        return (sum(r.n for r in each), math.fsum(r.loss for r in each), np.sum([r.g for r in each], axis=0),
                np.sum([r.h for r in each], axis=0).reshape(size, size))

    w = least_loss(sums, size, l2, rounds)

    def make():
        def run(batch):
            yield {"doc_id": batch.column(0), "good": batch.column(1), "raw": model.features(matrix(batch.column(2))) @ w}

        return run

    kind = rows.schema["doc_id"].dataType.simpleString()
    raws = written(map_batches(rows.select("doc_id", "good", "x"), make, f"doc_id {kind}, good boolean, raw double"), "quality-scores")
    # the two scores beside the quantile, as numbered over all
    n = sizes[True] + sizes[False]
    at = sizes[False] / n * (n - 1)
    ranked = numbered(raws.select("raw", F.struct("raw", "doc_id").alias("k")), "k", "n")
    beside = ranked.where(F.col("n").isin(math.floor(at) + 1, math.ceil(at) + 1)).agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).first()
    threshold = (beside.lo + beside.hi) / 2
    against_label = F.when(F.col("good"), -1.0).otherwise(1.0) * (F.col("raw") - threshold)
    loss = lambda s: F.avg(F.greatest(against_label * s, F.lit(0.0)) + F.log1p(F.exp(-F.abs(against_label * s))))
    losses = raws.agg(*[loss(float(s)) for s in SCALES]).first()
    return Model(model.mean, model.spread, w, threshold, float(SCALES[int(np.argmin(losses))]))


def labelled(docs: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """doc_id, good and measures x of every labelled document that `learn` picks.

    A document labelled twice counts as good if all labels say so; of rows that
    share a doc_id one counts. Texts are measured where they lie, and only
    measures meet the labels.
    """

    def make():
        def run(batch):
            yield {"doc_id": batch.column(0), "h": batch.column(1), "x": [measures(t.as_py()) for t in batch.column(2)]}

        return run

    kind = docs.schema["doc_id"].dataType.simpleString()
    one = labels.where("quality is not null and doc_id is not null").where(learn).groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    texts = docs.where("doc_id is not null").where(learn).select("doc_id", F.xxhash64("text").alias("h"), "text")
    each = map_batches(texts, make, f"doc_id {kind}, h long, x array<double>").join(one, "doc_id")
    return each.groupBy("doc_id").agg(F.first("good").alias("good"), F.min(F.struct("h", "x")).alias("m")).select("doc_id", "good", "m.x")


def fit(docs: DataFrame, labels: DataFrame, learn: Column, fit_rows: int = 16_384, rivals: int = 4, l2: float = 1e-4, rounds: int = 30) -> Model:
    """The model of all labelled documents that `learn` picks, whole texts.

    `docs` needs doc_id and text, `labels` doc_id and quality (1: good). Each
    document of the label with more meets `rivals` of the other as a preference
    pair. The driver fits up to `fit_rows` documents by itself; of more it gets
    sums alone, and measures and pairs stay in the tasks. With one label all
    scores are that label's, with none all are 0.5.
    """
    rows = written(labelled(docs, labels, learn), "quality-measures")
    sizes = {False: 0, True: 0} | {r.good: r["count"] for r in rows.groupBy("good").count().collect()}
    if not any(sizes.values()):
        return Model()
    if not all(sizes.values()):
        return Model(threshold=-40.0 if sizes[True] else 40.0)
    if sum(sizes.values()) > fit_rows:
        return learned_apart(rows, sizes, rivals, l2, rounds)
    few = sorted(rows.collect(), key=lambda r: str(r.doc_id))
    return learned(np.array([r.x for r in few]), np.array([r.good for r in few], bool), rivals, l2, rounds)


def score(docs: DataFrame, model: Model, keep: bool = False) -> DataFrame:
    """score (0 to 1) and predicted (1 if score >= 0.5) for each document, beside doc_id or (keep) all its columns.

    `docs` needs doc_id and text; nothing else is read. A document above the
    model's quantile of scores is predicted good. Null and empty texts have all
    measures 0 and are scored like others; repeated rows each give a row, an
    empty table an empty result. Columns named score or predicted are replaced.
    """

    def make():
        def run(batch):
            texts = batch.column(batch.schema.get_field_index("text"))
            x = np.array([measures(t.as_py()) for t in texts]).reshape(len(texts), len(MEASURES))
            s = model.scores(x)
            out = dict(zip(batch.schema.names, batch.columns, strict=True)) if keep else {"doc_id": batch.column(0)}
            yield out | {"score": s, "predicted": (s >= 0.5).astype(np.int32)}

        return run

    columns = docs.drop("score", "predicted") if keep else docs.select("doc_id", "text")
    kept = columns.schema if keep else docs.select("doc_id").schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return map_batches(columns, make, f"{schema}, score double, predicted int")


def op12_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 3) != 1)
    held = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


QUERIES = {"op12_pairwise": op12_pairwise}
ORACLES: dict[str, str] = {}
