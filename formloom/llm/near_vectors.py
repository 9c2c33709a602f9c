"""Near-duplicate embeddings by an inverted multi-index (operator 2)."""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.llm.common import map_batches, map_groups, roots, table, written
from formloom.llm.graph import components
from formloom.operators.skew import resharded_join

#: Rows of a cell are compared in blocks of these many residents and visitors.
BLOCK = 512


def usable(vectors: DataFrame) -> DataFrame:
    """Distinct (label, vector) of the rows that can link: _key (a hash), label, v (unit doubles), ids, first."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.where("label is not null and embedding is not null").select("vec_id", "label", v.alias("v"))
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    # -0.0 and 0.0 are one value
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    return rows.withColumn("_key", F.unhex(F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.col("v").cast("array<string>")), 256)))


def codebook(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k centres of the sample by Lloyd's rounds from a fixed start."""
    rng = np.random.default_rng(7)
    centres = points[rng.permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        near = distances(points, centres).argmin(1)
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = points[near == c].mean(0)
    return np.unique(centres, axis=0)


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * x @ centres.T, 0)


def bounds(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The centre of each point, and for all centres the least squared distance to any point of theirs.

    A point of centre j lies beyond the plane midway between j and the own centre.
    """
    d = distances(x, centres)
    own = d.argmin(1)
    gap = np.sqrt(distances(centres[own], centres))
    least = (d - d[np.arange(len(x)), own][:, None]) / (2 * np.maximum(gap, 1e-12))
    least[np.arange(len(x)), own] = 0
    return own, np.maximum(least - 1e-6, 0) ** 2


def traverse(a: np.ndarray, b: np.ndarray, most: float) -> list[tuple[int, int]]:
    """Cells of the product grid by the multi-sequence walk, nearest first.

    A queue holds the next cell of every row that was entered; a row is entered
    when the walk takes the first cell of the row before. The walk ends with the
    first cell whose bound is above `most`: no later one can hold a neighbour.
    """
    ia, ib = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    rows, columns = a[ia].tolist(), b[ib].tolist()
    ia, ib = ia.tolist(), ib.tolist()
    queue, out = [(rows[0] + columns[0], 0, 0)], []
    while queue and queue[0][0] <= most:
        _, i, j = heapq.heappop(queue)
        out.append((ia[i], ib[j]))
        if j + 1 < len(columns):
            heapq.heappush(queue, (rows[i] + columns[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(rows):
            heapq.heappush(queue, (rows[i + 1] + columns[0], i + 1, 0))
    return out


def links(vectors: DataFrame, threshold: float = 0.98, sample: int = 8192, codes: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of `vectors` (vec_id, embedding, label).

    Vectors of one label link at a cosine of at least `threshold`. Codebooks of
    the vectors' halves are fitted on a sample of at most `sample` distinct
    vectors; every vector is indexed in one cell of the grid and visits all
    cells that can hold a vector near enough: the bound is exact, so the target
    recall is 1, and each meeting is verified in double precision. Equal vectors
    are compared once. A cell's rows are cut into blocks, of which any two meet
    in one task; only counts and one link a vector leave it.

    Null labels, null, zero or empty vectors, and vectors with a null or
    non-finite component have no links. vec_id may be null or repeated; each row
    counts as a vector, and a row without vec_id has component_id null unless a
    linked row has one. Vectors of different length never link.
    """
    rows = usable(vectors)
    classes = rows.groupBy("_key", "label").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"), F.first("v").alias("v"))
    classes = written(classes.withColumn("dim", F.size("v")), "vector-classes")
    n = classes.count()
    if not n:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    radius = 2 - 2 * threshold + 1e-9
    k = codes or int(min(256, max(2, math.isqrt(n) // 32)))
    books: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    taken = classes.orderBy("_key").limit(sample).select("v").toPandas()["v"]
    for dim in {len(x) for x in taken}:
        unit = np.array([x for x in taken if len(x) == dim])
        unit /= np.linalg.norm(unit, axis=1)[:, None]
        books[dim] = codebook(unit[:, : dim // 2], k), codebook(unit[:, dim // 2 :], k)

    def make():
        def run(batch):
            key, label, copies, v = (batch.column(i) for i in range(4))
            names = ("label", "dim", "cell", "home", "key", "copies")
            out: dict = {x: [] for x in names}
            for key_, label_, copies_, x in zip(key.to_pylist(), label.to_pylist(), copies.to_pylist(), v, strict=True):
                x = np.array(x.values.to_numpy() if hasattr(x, "values") else x.as_py(), float)
                x = x / np.abs(x).max()
                x /= np.linalg.norm(x)
                dim = len(x)
                if dim in books and dim > 1:
                    (p, q), half = books[dim], dim // 2
                    (i, a), (j, b) = bounds(x[None, :half], p), bounds(x[None, half:], q)
                    home, cells = (int(i[0]), int(j[0])), traverse(a[0], b[0], radius)
                else:
                    home, cells = (0, 0), [(0, 0)]
                for c in cells:
                    for name, value in zip(out, (label_, dim, c[0] << 32 | c[1], c == home, key_, copies_), strict=True):
                        out[name].append(value)
                if len(out["key"]) >= 8192:
                    yield out
                    out = {x: [] for x in names}
            yield out

        return run

    kind = vectors.schema["label"].dataType.simpleString()
    schema = f"label {kind}, dim int, cell long, home boolean, key binary, copies long"
    visits = written(map_batches(classes.select("_key", "label", "copies", "v"), make, schema), "vector-visits")
    place = F.abs(F.xxhash64("key") % 1_000_003)
    sizes = visits.groupBy("label", "dim", "cell").agg(F.ceil(F.count_if("home") / BLOCK).alias("rows_in"), F.ceil(F.count("*") / BLOCK).alias("calls"))
    sizes = sizes.where("rows_in > 0")
    placed = resharded_join(visits, sizes, ["label", "dim", "cell"]).withColumns({"r": place % F.col("rows_in"), "c": place % F.col("calls")})
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    names = ["label", "dim", "cell", "r", "c", "resident", "key", "copies"]
    visitors = placed.withColumn("resident", F.lit(False)).withColumn("r", F.explode(every("rows_in"))).select(names)
    residents = placed.where("home").withColumn("resident", F.lit(True)).withColumn("c", F.explode(every("calls"))).select(names)

    def meet(_, t):
        res = np.array(t.column("resident").to_pylist(), bool)
        if not res.any() or res.all():
            return
        dim = t.column("dim")[0].as_py()
        x = t.column("v").combine_chunks().flatten().to_numpy().astype(float).reshape(len(res), dim)
        x /= np.abs(x).max(1)[:, None]
        x /= np.linalg.norm(x, axis=1)[:, None]
        keys = np.array(t.column("key").to_pylist(), object)
        copies = np.array(t.column("copies").to_pylist())
        cos = x[~res] @ x[res].T
        near = (cos >= threshold) & (keys[~res][:, None] != keys[res])
        if not near.any():
            return
        names, at = np.unique(np.concatenate([keys[~res], keys[res]]), return_inverse=True)
        i, j = np.nonzero(near)
        root = roots(len(names), at[: (~res).sum()][i], at[(~res).sum() :][j])
        counts = near @ copies[res]
        seen = counts > 0
        mine = at[: (~res).sum()]
        yield {"a": keys[~res][seen], "n": counts[seen], "b": names[root[mine[seen]]]}

    # visits carry keys alone; the vectors join once, as they were given
    given = vectors.schema["embedding"].dataType.simpleString()
    calls = resharded_join(visitors.union(residents), classes.select(F.col("_key").alias("key"), F.col("v").cast(given).alias("v")), ["key"])
    met = map_groups(calls, ["label", "dim", "cell", "r", "c"], meet, "a binary, n long, b binary")
    met = written(met, "vector-links")
    counts = met.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "_key")
    comps = components(met.select("a", "b")).withColumnRenamed("node", "_key")
    own = classes.select("_key", "copies", "first").join(counts, "_key", "left").join(comps, "_key", "left")
    own = own.withColumns({"root": F.coalesce("root", "_key"), "n_links": F.coalesce("n", F.lit(0)) + F.col("copies") - 1})
    least = own.groupBy("root").agg(F.min("first").alias("component_id"))
    own = resharded_join(own, least, ["root"]).select("_key", "n_links", "component_id")
    out = resharded_join(usable_keys(vectors), own, ["_key"], "left")
    component = F.coalesce("component_id", F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


def usable_keys(vectors: DataFrame) -> DataFrame:
    """Every vec_id with the key of its vector, null where it cannot link."""
    rows = usable(vectors).select("vec_id", "_key")
    fine = F.col("label").isNotNull() & F.col("embedding").isNotNull()
    v = F.col("embedding").cast("array<double>")
    fine = fine & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.union(vectors.where(~F.coalesce(fine, F.lit(False))).select("vec_id", F.lit(None).cast("binary")))


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(table(spark, sf_dir, "embeddings"))


QUERIES = {"op2_near_vectors": op2_near_vectors}
ORACLES = {"op2_near_vectors": """
with recursive v as (select row_number() over () as r, vec_id, label, embedding::double[] as e from embeddings),
ok as (select r, vec_id, label, e from v where label is not null and e is not null and len(e) > 0
       and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and list_sum(list_transform(e, lambda x: abs(x))) > 0),
l as (select a.r as a, b.r as b, b.vec_id as id from ok a join ok b on a.label = b.label and a.r <> b.r and len(a.e) = len(b.e)
      and list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) as (select r, r from ok union select reach.a, l.b from reach join l on reach.b = l.a),
c as (select reach.a as r, min(ok.vec_id) as component_id from reach join ok on ok.r = reach.b group by 1),
n as (select a as r, count(*) as n_links from l group by 1)
select vec_id, coalesce(n_links, 0)::bigint as n_links, coalesce(component_id, vec_id)::bigint as component_id,
  coalesce(component_id, vec_id) is not distinct from vec_id as kept from v left join n using (r) left join c using (r)
"""}
