"""N-gram Jaccard join with Bayesian candidate pruning (operator 1)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.llm.common import SPACES, aside, map_batches, map_groups, release, roots, table, written
from formloom.llm.graph import components
from formloom.operators.skew import resharded_join

WORDS, THRESHOLD = 5, 0.8
#: MinHash values of a text, and how many of them make a band.
VALUES, BAND = 96, 4
#: A pair is dropped once its similarity reaches the threshold with less than this probability.
TOLERANCE = 1e-5
STEP = 8  # values at a time; VALUES stay below 256, as matches are counted in bytes
#: Rows of a bucket or cluster meet in blocks of these many.
BLOCK = 256
STORE_WORDS = 150_000
#: Bits of the filter in front of the texts' exact join.
FILTER_BITS = 1 << 26
_RNG = np.random.default_rng(20_111)
_A = _RNG.integers(1, 1 << 63, VALUES, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 1 << 63, VALUES, dtype=np.uint64)
_PLACE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


class Shingler:
    """Distinct hashed shingles of texts; word hashes are kept in each task."""

    def __init__(self, words: int = WORDS):
        import xxhash

        self.words, self.hash, self.store = words, xxhash.xxh3_64_intdigest, {}

    def of(self, text: str | None) -> np.ndarray:
        """Of the lower-case words; a text of fewer words than a shingle takes is one shingle, no word is none."""
        words, get = (text or "").lower().encode().split(), self.store.get
        if not words:
            return np.zeros(0, np.uint64)
        hashes = []
        for w in words:
            h = get(w)
            if h is None:
                if len(self.store) >= STORE_WORDS:
                    self.store.clear()
                h = self.store[w] = self.hash(w)
            hashes.append(h)
        h = np.array(hashes, np.uint64)
        k = min(self.words, len(h))
        s = np.full(len(h) - k + 1, k, np.uint64)
        for j in range(k):
            s = (s ^ (h[j : len(h) - k + 1 + j] * _PLACE[j])) * np.uint64(0x9E3779B97F4A7C15)
            s ^= s >> np.uint64(29)
        return np.unique(s)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The low 16 bits of VALUES MinHash values; two values agree by chance once in 65,536."""
    low = np.full(VALUES, (1 << 32) - 1, np.uint32)
    for a in range(0, len(shingles), 512):
        x = shingles[a : a + 512, None] * _A + _B
        low = np.minimum(low, (x >> np.uint64(32)).astype(np.uint32).min(0))
    return low.astype(np.uint16)


def least_matches(threshold: float, tolerance: float, values: int = VALUES) -> list[int]:
    """For n compared values, the fewest equal ones that keep a pair: entry n.

    With a uniform prior, m equal values of n leave a Beta(m + 1, n - m + 1)
    similarity, above the threshold with the probability that a binomial of
    n + 1 draws is at most m.
    """
    out = [0]
    for n in range(1, values + 1):
        total, m = 0.0, -1
        while total < tolerance and m < n:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def survivors(sig: np.ndarray, left: np.ndarray, right: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (left x right, each pair once) that are still alive after all values, compared STEP at a time.

    While many pairs are alive, whole rows of values are compared; the few left later are compared one by one.
    """
    a, b = np.ascontiguousarray(sig[left].T), np.ascontiguousarray(sig[right].T)
    same = np.zeros((len(left), len(right)), np.uint8)
    alive = np.triu(np.ones(same.shape, bool), 1) if left is right else np.ones(same.shape, bool)
    at = 0
    while at < len(a) and alive.mean() > 0.02:
        for k in range(at, at := min(at + STEP, len(a))):
            same += a[k][:, None] == b[k]
        alive &= same >= least[at]
    i, j = np.nonzero(alive)
    same = same[i, j].astype(np.int32)
    for at in range(at, len(a), STEP):
        if not len(i):
            break
        end = min(at + STEP, len(a))
        for k in range(at, end):
            same += a[k][i] == b[k][j]
        keep = same >= least[end]
        i, j, same = i[keep], j[keep], same[keep]
    return left[i], right[j]


def overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of the pairs."""
    if len(i) <= 2 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    names, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(counts > 1)
    place = np.full(len(names), -1)
    place[shared] = np.arange(len(shared))
    at = place[at]
    owner, at = owner[at >= 0], at[at >= 0]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for a in range(0, len(shared), 8192):
        inside = (at >= a) & (at < a + 8192)
        x = np.zeros((len(sets), min(8192, len(shared) - a)), np.float32)
        x[owner[inside], at[inside] - a] = 1
        total += x @ x.T
    return total[i, j].astype(np.int64)


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, key (md5 of the text), n (distinct shingles) and sig of each document with a word."""

    def make():
        release()
        shingler, last = Shingler(), {}

        def run(batch):
            n, sig = [], []
            for key, text in zip(batch.column(1), batch.column(2), strict=True):
                key = key.as_py()
                if key not in last:
                    if len(last) >= 4096:
                        last.clear()
                    s = shingler.of(text.as_py())
                    last[key] = len(s), signature(s).tobytes()
                n.append(last[key][0])
                sig.append(last[key][1])
            yield {"doc_id": batch.column(0), "key": batch.column(1), "n": n, "sig": sig}

        return run

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.where(F.length(F.trim("text", F.lit(SPACES))) > 0).select("doc_id", key_of_text().alias("key"), "text")
    return map_batches(rows, make, f"doc_id {kind}, key binary, n int, sig binary")


def key_of_text():
    return F.unhex(F.md5(F.col("text").cast("binary")))


def in_blocks(rows: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Deals each group's rows into blocks of about BLOCK; any two of its blocks meet as (i, j), i <= j.

    own tells which of the two a row is of.
    """
    rows = rows.withColumn("blocks", F.ceil(F.col(count) / BLOCK).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("cid"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("blocks", "other", count)


class Block:
    """The rows of two blocks that meet: their ids in ascending order, and which pairs are to be compared."""

    def __init__(self, key: tuple, t):
        ids = t.column("cid").to_numpy()
        order = np.argsort(ids)
        self.rows, self.ids = t.take(order), ids[order]
        own = self.rows.column("own").to_numpy()
        self.left = np.flatnonzero(own == key[-2])
        self.right = self.left if key[-2] == key[-1] else np.flatnonzero(own == key[-1])
        self.sig = np.frombuffer(b"".join(self.rows.column("sig").to_pylist()), np.uint16).reshape(len(ids), VALUES)

    def survivors(self, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs to verify: of one block, or between the two."""
        if not len(self.left) or not len(self.right):
            return self.left[:0], self.left[:0]
        return survivors(self.sig, self.left, self.right, least)

    def merges(self, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Links (row, smaller row) that connect what pairs alive connect.

        A block alone links each of its rows; two blocks link only the parts
        that they have by themselves, as the rows of each are linked elsewhere.
        """
        i, j = self.survivors(least)
        if not len(i):
            return i, j
        n = len(self.ids)
        if self.left is not self.right:
            parts = [survivors(self.sig, x, x, least) for x in (self.left, self.right)]
            part = roots(n, *(np.concatenate(x) for x in zip(*parts, strict=True)))
            i, j = part[i], part[j]
        root = roots(n, i, j)
        at = np.flatnonzero(root != np.arange(n))
        return at, root[at]


def clusters(classes: DataFrame, least: list[int]) -> DataFrame:
    """node and root: classes that pairs alive after pruning connect, from (cid, sig).

    Texts that share a band of MinHash values meet; of buckets with the same
    members one is kept. No pair leaves a task, only one link a text and block.
    """
    width = 2 * BAND
    bands = F.transform(F.sequence(F.lit(0), F.lit(VALUES // BAND - 1)), lambda b: F.xxhash64(b, F.substring("sig", b * width + 1, width)))
    members = classes.select("cid", F.explode(bands).alias("band"))
    shared = members.groupBy("band").agg(F.count("*").alias("c"), F.min("cid").alias("m"), F.bit_xor(F.xxhash64("cid")).alias("x")).where("c > 1")
    shared = shared.groupBy("c", "m", "x").agg(F.min("band").alias("band")).select("band", "c")
    met = in_blocks(resharded_join(members, shared, ["band"]), ["band"], "c")
    met = resharded_join(met, classes.select("cid", "sig"), ["cid"]).select("band", "i", "j", "own", "cid", "sig")

    def run(key, t):
        block = Block(key, t)
        at, to = block.merges(least)
        if len(at):
            yield {"a": block.ids[at], "b": block.ids[to]}

    return components(map_groups(met, ["band", "i", "j"], run, "a long, b long").distinct())


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """key and text of the wanted keys, one row each.

    A bitmap of the wanted keys' hashes, 8 MB at most whatever their number, is
    broadcast first: texts whose bit is not set are not shuffled. It decides
    nothing; the exact join follows.
    """
    place = F.pmod(F.xxhash64("key"), FILTER_BITS) + 1
    bits = wanted.groupBy(F.bitmap_bucket_number(place).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_bits"))
    texts = docs.where("text is not null").select(key_of_text().alias("key"), "text").withColumn("_bucket", F.bitmap_bucket_number(place))
    texts = texts.withColumn("_at", F.bitmap_bit_position(place)).join(F.broadcast(bits), "_bucket")
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(F.col("_at") / 8) + 1).cast("int"), 1)), 16, 10).cast("int")
    texts = texts.where(byte.bitwiseAND(F.expr("shiftleft(1, cast(_at % 8 as int))")) != 0).select("key", "text")
    return resharded_join(texts, wanted, ["key"], "leftsemi").groupBy("key").agg(F.first("text").alias("text"))


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """The documents that can link (doc_id, key), and a row for each distinct text: key, class_id, n_links, component_id, keeper."""
    least = least_matches(threshold, tolerance)
    each = written(signed(docs), "near-text")
    classes = each.groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("class_id"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "near-classes")
    groups = clusters(classes, least).withColumnRenamed("node", "cid")
    sizes = groups.groupBy("root").agg(F.count("*").alias("c"))
    inside = resharded_join(groups, sizes, ["root"]).join(classes.select("cid", "key", "copies", "sig"), "cid")
    inside = written(inside, "near-groups")
    rows = inside.join(texts_of(docs, inside.select("key")), "key").drop("key")
    met = in_blocks(rows, ["root"], "c").select("root", "i", "j", "own", "cid", "copies", "sig", "text")

    def run(key, t):
        block = Block(key, t)
        i, j = block.survivors(least)
        if not len(i):
            return
        n = len(block.ids)
        shingler, used = Shingler(), np.zeros(n, bool)
        used[i] = used[j] = True
        sets = [shingler.of(x.as_py()) if u else np.zeros(0, np.uint64) for u, x in zip(used, block.rows.column("text"), strict=True)]
        size = np.array([len(s) for s in sets])
        both = overlaps(sets, i, j)
        near = both >= threshold * (size[i] + size[j] - both) - 1e-9
        i, j = i[near], j[near]
        copies = block.rows.column("copies").to_numpy()
        links = np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
        root, at = roots(n, i, j), np.flatnonzero(links)
        yield {"a": block.ids[at], "n": links[at].astype(np.int64), "b": block.ids[root[at]]}

    links = written(map_groups(met, ["root", "i", "j"], run, "a long, n long, b long"), "near-links")
    counts = links.groupBy("a").agg(F.sum("n").alias("others")).withColumnRenamed("a", "cid")
    found = components(links.select("a", "b").distinct()).withColumnRenamed("node", "cid")
    out = classes.select("cid", "key", "class_id", "copies").join(counts, "cid", "left").join(found, "cid", "left")
    out = out.select("cid", "key", "class_id", F.coalesce("root", "cid").alias("root"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    first = out.groupBy("root").agg(F.min(F.struct(F.col("class_id").isNull(), "class_id", "cid")).alias("first"))
    out = resharded_join(out, first, ["root"]).select(
        "key", "class_id", "n_links", F.col("first.class_id").alias("component_id"), (F.col("cid") == F.col("first.cid")).alias("keeper"))
    return each.select("doc_id", "key"), written(out, "near-result")


def join(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, class_id, n_links, component_id and kept for each row of `docs` (doc_id, text; the rest is not read).

    Documents link at a Jaccard similarity of at least `threshold` of their sets
    of 5-word shingles (lower case; a shorter text is one shingle). class_id:
    smallest doc_id with the same text; n_links: other documents linked
    directly, copies included; component_id: smallest doc_id reachable by links.
    kept: doc_id = component_id. Texts without a word, and null ones, link with
    nothing. Copies are compared once, as their text; repeated rows count as
    copies; a null doc_id is never the smallest.

    A pair of similarity 0.8 shares a band with probability 1 - 3e-6. The posterior
    is tested after each STEP values, and a pair at 0.8 fails one of the tests
    with a probability of about ten times `tolerance` (9.6e-5 as it stands, 2e-6
    at 0.85); nothing else is cut.
    """
    each, result = near_classes(docs, threshold, tolerance)
    known = resharded_join(each, result, ["key"]).select("doc_id", "class_id", "n_links", "component_id")
    known = known.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    alone = docs.where(~F.coalesce(F.length(F.trim("text", F.lit(SPACES))) > 0, F.lit(False)))
    return known.unionByName(alone.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")))


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """The rows of `docs` that stay: one of each group of near-duplicates, all texts without a word.

    The row with the smallest doc_id stays; of rows equal in doc_id and text one.
    """
    _, result = near_classes(docs, threshold, tolerance)
    keep = result.where("keeper").select(F.col("key").alias("_key"), F.col("class_id").alias("_first"))
    rows, columns = aside(docs, ["_key", "_first"])
    rows = rows.withColumn("_key", key_of_text())
    worded = F.coalesce(F.length(F.trim("text", F.lit(SPACES))) > 0, F.lit(False))
    stay = resharded_join(rows.where(worded), keep, ["_key"]).where(F.col("doc_id").eqNullSafe(F.col("_first"))).dropDuplicates(["_key"])
    return stay.select(columns).unionByName(rows.where(~worded).select(columns))


def op1_near_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


QUERIES = {"op1_near_text": op1_near_text}
ORACLES = {"op1_near_text": r"""
with recursive t as (select text, min(doc_id) as class_id, count(*) as copies,
  list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents where text is not null group by text),
s as (select distinct class_id, unnest(case when len(w) < 5 then [array_to_string(w, ' ')]
      else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as g from t where len(w) > 0),
n as (select class_id, count(*) as n from s group by 1),
rare as (select g from s group by g having count(*) > 1),
p as (select a.class_id as a, b.class_id as b, count(*) as k from s a join s b on a.g = b.g and a.class_id <> b.class_id
      where a.g in (select g from rare) group by 1, 2),
l as (select p.a, p.b from p join n x on x.class_id = p.a join n y on y.class_id = p.b where k >= 0.8 * (x.n + y.n - k) - 1e-9),
reach(a, b) as (select class_id, class_id from t union select reach.a, l.b from reach join l on reach.b = l.a),
c as (select a as class_id, min(b) as component_id from reach group by 1),
m as (select l.a as class_id, sum(t.copies) as others from l join t on t.class_id = l.b group by 1)
select d.doc_id, case when len(t.w) > 0 then t.class_id else d.doc_id end as class_id,
  case when len(t.w) > 0 then coalesce(m.others, 0) + t.copies - 1 else 0 end::bigint as n_links,
  case when len(t.w) > 0 then c.component_id else d.doc_id end as component_id,
  d.doc_id is not distinct from (case when len(t.w) > 0 then c.component_id else d.doc_id end) as kept
from documents d left join t on t.text = d.text left join c using (class_id) left join m using (class_id)
"""}
