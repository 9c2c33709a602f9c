"""LM scoring with a log-frequency Bloom filter of quantised n-gram counts (operator 4)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formloom.llm.common import as_batch, map_batches, map_groups, remainder, table, work_path, written

#: Added to every count by the base score.
PRIOR = 0.1
#: Counts are kept as 1 + floor(log(count) / log(BASE)).
BASE = 1.5
#: Probes of a level, and bits for each of its entries. Every pair also sets a guard level below its
#: first, so an unknown pair passes only by two false positives in a row, about 0.4 % each.
PROBES, BITS = 5, 12
#: Weight of the pair's relative count; the rest is the base probability.
WEIGHT = 0.2
#: Fixed value: the seed of Spark's xxhash64, so that both sides hash a word alike.
HASH_SEED = 42
BLOCK_BYTES, SHARD_BYTES = 8 << 20, 32 << 20
#: The filter of texts up to this size is broadcast (it has at most twice their size); a larger one is probed where its shards are.
BROADCAST_BYTES = 32 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def pair_hash(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(history * np.uint64(0x9E3779B97F4A7C15) + mixed(word))


def levels(counts: np.ndarray) -> np.ndarray:
    return (1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(BASE) + 1e-9)).astype(np.int64)


def expected() -> np.ndarray:
    """For each level the middle of its counts; 0 for level 0."""
    at = np.arange(1, 256)
    low = np.ceil(BASE ** (at - 1.0) - 1e-9)
    return np.append(0.0, (low + np.maximum(low, np.ceil(BASE ** (1.0 * at) - 1e-9) - 1)) / 2)


EXPECTED = expected()
#: Pairs that are set, and tokens of a block that are scored, at a time.
SLICE = 1 << 20


class LogFrequencyFilter:
    """One shard: bits in which each n-gram sets PROBES places for the guard, level 0, and every level up to its own."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.size = bits, np.uint64(len(bits) * 8)

    @classmethod
    def of(cls, hashes: np.ndarray, counts: np.ndarray) -> LogFrequencyFilter:
        level = levels(counts)
        out = cls(np.zeros(max(64, int((level + 1).sum()) * BITS // 8 + 1), np.uint8))
        for a in range(0, len(hashes), SLICE):
            h, top = hashes[a : a + SLICE], level[a : a + SLICE]
            for j in range(int(top.max()) + 1):
                h, top = h[top >= j], top[top >= j]
                for k in range(PROBES):
                    at = out.place(h, j, k)
                    np.bitwise_or.at(out.bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        return out

    def place(self, hashes: np.ndarray, level: int, k: int) -> np.ndarray:
        h = mixed(hashes + np.uint64((level * 0xD1342543DE82EF95) & 0xFFFFFFFFFFFFFFFF))
        return (h + np.uint64(k) * (mixed(h) | np.uint64(1))) % self.size

    def probe(self, hashes: np.ndarray) -> np.ndarray:
        """The levels: how many successive levels are found above the guard."""
        out, alive, level = np.zeros(len(hashes), np.uint8), np.arange(len(hashes)), 0
        while len(alive):
            for k in range(PROBES):
                at = self.place(hashes[alive], level, k)
                alive = alive[((self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1) == 1]
            out[alive] = level
            level += 1
        return out


def shard_of(grams: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each pair, and its 32 bits there."""
    return (grams >> np.uint64(32)) % np.uint64(shards), grams & np.uint64(0xFFFFFFFF)


class TextBlock:
    """Documents of one task, with the codes of their words; code 0 is the end, and the start of a text."""

    def __init__(self):
        self.codes: dict[bytes, int] = {b"": 0}
        self.ids, self.held, self.texts, self.bytes = [], [], [], 0

    def add(self, doc_id, held: bool, text: str | None) -> None:
        words, find = (text or "").encode().lower().split(), self.codes.setdefault
        codes = [find(w, len(self.codes)) for w in words]
        codes.append(0)
        self.ids.append(doc_id)
        self.held.append(held)
        self.texts.append(np.array(codes, np.int32))
        self.bytes += len(text or "") + 64

    def rows(self, block: int):
        """One row with the texts, and rows with the words; more frequent words get smaller codes."""
        import xxhash

        codes = np.concatenate(self.texts)
        lengths = np.array([len(x) for x in self.texts])
        words = np.array(list(self.codes), object)
        order = np.argsort(-np.bincount(codes, minlength=len(words))[1:], kind="stable") + 1
        order = np.append(0, order)
        place = np.empty(len(words), np.int32)
        place[order] = np.arange(len(words))
        codes, words = place[codes], words[order].tolist()
        learned = np.repeat(~np.array(self.held), lengths)
        counts = np.bincount(codes[learned], minlength=len(words))
        hashes = np.array([xxhash.xxh64_intdigest(w, HASH_SEED) for w in words], np.uint64)
        empty = dict.fromkeys(("ids", "held", "lengths", "codes", "hashes", "first", "words", "counts"), [None])
        yield empty | {"kind": ["text"], "block": [block], "ids": [self.ids], "held": [self.held], "lengths": [lengths],
                       "codes": [planes(codes)], "hashes": [hashes.tobytes()]}
        for a in range(0, len(words), 1 << 15):
            yield empty | {"kind": ["words"], "block": [block], "first": [a], "words": [words[a : a + (1 << 15)]], "counts": [counts[a : a + (1 << 15)]]}


def planes(codes: np.ndarray) -> bytes:
    """The codes' bytes, all lowest ones first: the others are mostly zero and shrink when written."""
    return np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def gaps(pairs: np.ndarray) -> bytes:
    """Ascending pairs as byte planes of their differences, the upper ones of which are mostly zero."""
    return planes(np.diff(pairs, prepend=np.uint32(0)))


def from_gaps(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data).view(np.uint32), dtype=np.uint32)


def pairs_of(codes: np.ndarray, lengths: np.ndarray, held: np.ndarray, hashes: np.ndarray, shards: int):
    """(shard, distinct pairs in ascending order, how often each was learned) of one block."""
    learned = np.repeat(~held, lengths)
    shard, low = shard_of(grams_of(codes, hashes), shards)
    each = np.sort((shard << np.uint64(33)) | (low << np.uint64(1)) | learned.astype(np.uint64))
    first = np.flatnonzero(np.append(True, each[1:] >> np.uint64(1) != each[:-1] >> np.uint64(1)))
    seen = np.add.reduceat((each & np.uint64(1)).astype(np.int64), first).astype(np.uint32)
    pair = each[first] >> np.uint64(1)
    cut = np.flatnonzero(np.append(True, pair[1:] >> np.uint64(32) != pair[:-1] >> np.uint64(32)))
    for a, b in zip(cut, [*cut[1:], len(pair)], strict=True):
        yield int(pair[a] >> np.uint64(32)), pair[a:b].astype(np.uint32), seen[a:b]


def grams_of(codes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return pair_hash(hashes[before(codes)], hashes[codes])


def before(codes: np.ndarray) -> np.ndarray:
    """The code before each token; texts start after code 0, which also ends them."""
    return np.append(np.int32(0), codes[:-1])


BLOCKS = ("kind string, block long, ids array<{id}>, held array<boolean>, lengths array<int>, codes binary, hashes binary, "
          "first int, words array<binary>, counts array<long>")


def blocks(docs: DataFrame, held: Column) -> DataFrame:
    """The texts in blocks of bounded size: codes of their words, and the words with their counts."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = BLOCKS.format(id=docs.schema["doc_id"].dataType.simpleString())
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        from pyspark import TaskContext

        number, b = TaskContext.get().partitionId() << 32, TextBlock()
        for batch in batches:
            for doc_id, held_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                b.add(doc_id, held_, text.as_py())
                if b.bytes >= BLOCK_BYTES:
                    yield from (as_batch(x, arrow) for x in b.rows(number))
                    number, b = number + 1, TextBlock()
        if b.ids:
            yield from (as_batch(x, arrow) for x in b.rows(number))

    return docs.select("doc_id", F.coalesce(held, F.lit(False)), "text").mapInArrow(run, schema)


def hashed_pairs(text: DataFrame, shards: int) -> DataFrame:
    """block, shard, pairs and seen: the pairs of each block, hashed, by shard."""

    def make():
        def run(batch):
            for block, held, lengths, codes, hashes in zip(*batch.columns, strict=True):
                found = pairs_of(from_planes(codes.as_py()), np.array(lengths.as_py()), np.array(held.as_py(), bool), np.frombuffer(hashes.as_py(), np.uint64), shards)
                for shard, pairs, seen in found:
                    yield {"block": [block.as_py()], "shard": [shard], "pairs": [gaps(pairs)], "seen": [planes(seen)]}

        return run

    return map_batches(text.select("block", "held", "lengths", "codes", "hashes"), make, "block long, shard int, pairs binary, seen binary")


def filter_shards(pairs: DataFrame) -> DataFrame:
    """shard and bits of the filter of all pairs that were learned."""

    def build(key, t):
        pair, n = merged(t)
        learned = n > 0
        yield {"shard": [key[0]], "bits": [LogFrequencyFilter.of(pair[learned].astype(np.uint64), n[learned]).bits.tobytes()]}

    return map_groups(pairs.select("shard", "pairs", "seen"), ["shard"], build, "shard int, bits binary")


def merged(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    pair = np.concatenate([from_gaps(x.as_py()) for x in t.column("pairs")])
    seen = np.concatenate([from_planes(x.as_py()) for x in t.column("seen")])
    order = np.argsort(pair, kind="stable")
    pair, seen = pair[order], seen[order]
    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    return pair[first], np.add.reduceat(seen.astype(np.int64), first)


def levels_beside(pairs: DataFrame) -> DataFrame:
    """block, shard and level: for each pair of a block, in ascending order, the level that its shard's filter gives.

    The way for filters too large to broadcast: a shard's filter is made and
    probed where its pairs meet, which is once. A block knows its pairs, so only
    the levels travel back, most of them 0 to 2.
    """

    def look(key, t):
        pair, n = merged(t)
        learned = n > 0
        f = LogFrequencyFilter.of(pair[learned].astype(np.uint64), n[learned])
        for block, data in zip(t.column("block").to_pylist(), t.column("pairs"), strict=True):
            yield {"block": [block], "shard": [key[0]], "level": [f.probe(from_gaps(data.as_py()).astype(np.uint64)).tobytes()]}

    return map_groups(pairs, ["shard"], look, "block long, shard int, level binary")


def levels_of(grams: np.ndarray, shards: int, filters: dict[int, bytes] | None, found: dict[int, bytes]) -> np.ndarray:
    """The level of each pair, by probes of the broadcast filter or from the levels found beside the shards."""
    shard, low = shard_of(grams, shards)
    each, place = np.unique((shard << np.uint64(32)) | low, return_inverse=True)
    if filters is None:
        return np.concatenate([np.frombuffer(found[s], np.uint8) for s in sorted(found)])[place]
    level = np.zeros(len(each), np.uint8)
    ends = np.searchsorted(each >> np.uint64(32), np.arange(shards + 1).astype(np.uint64))
    for s in np.flatnonzero(np.diff(ends)).tolist():
        if s in filters:
            level[ends[s] : ends[s + 1]] = LogFrequencyFilter(np.frombuffer(filters[s], np.uint8)).probe(each[ends[s] : ends[s + 1]] & np.uint64(0xFFFFFFFF))
    return level[place]


def score(docs: DataFrame, held: Column, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of `docs`.

    `docs` needs doc_id and text; rows where `held` holds teach nothing. Tokens:
    words between ASCII white space with A-Z in lower case, then the end; null
    and empty texts are one end. score: log10 probability, a token w after v
    having WEIGHT * q / c(v) + (1 - WEIGHT) * base where v was learned, else
    base; q is the count the filter gives, at most c(v). Repeated
    rows count and are scored each; a null `held` learns. With nothing to learn
    from, scores are those of one unknown token among one.

    Texts are cut into blocks of bounded size. Words travel once for each block;
    pairs as sorted hashes, so a frequent one is one entry a block. The filter
    is made in shards. For texts of up to `broadcast_bytes`, which bound it, it is
    broadcast; beyond that the blocks' pairs are looked up beside the shards,
    with the same results.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    path = work_path(spark, "lm-blocks")
    made = blocks(docs, held)
    made.write.option("compression", "zstd").parquet(path)
    rows = lambda kind: spark.read.schema(made.schema).parquet(path).where(F.col("kind") == kind)
    words = rows("words").select("block", "first", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "x"))
    words = words.select("block", (F.col("first") + F.col("at")).alias("code"), F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    # a word has one row in each block, so even the most frequent one is a group far smaller than the text
    w = Window.partitionBy("word")
    known = words.select("block", "code", "n", F.sum("n").over(w).alias("c"), (F.min("block").over(w) == F.col("block")).alias("one")).where("c > 0")
    known = written(known, "lm-counts")
    total = known.agg(F.sum("n").alias("n"), F.count_if("one").alias("v")).first()
    n, v = total.n or 0, total.v
    text = rows("text").select("block", "ids", "held", "lengths", "codes", "hashes")
    none = {"shard": "int", "level": "binary"}
    left = text.select("*", *[F.lit(None).cast(t).alias(k) for k, t in none.items()])
    shared = None
    if size <= broadcast_bytes:
        shared = spark.sparkContext.broadcast({r.shard: bytes(r.bits) for r in filter_shards(hashed_pairs(rows("text"), shards)).collect()})
    else:
        found = levels_beside(hashed_pairs(rows("text"), shards))
        left = left.unionByName(found.select("block", *[F.lit(None).cast(text.schema[c].dataType).alias(c) for c in text.columns[1:]], "shard", "level"))
    known = known.select("block", "code", "c")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        one = next(i for i, x in enumerate(a.column("codes")) if x.is_valid)
        get = lambda name: a.column(name)[one].as_py()
        codes, lengths = from_planes(get("codes")), np.array(get("lengths"))
        hashes, c = np.frombuffer(get("hashes"), np.uint64), np.zeros(int(codes.max()) + 1, np.int64)
        c[b.column("code").to_numpy()] = b.column("c").to_numpy()  # a word that was never learned has none
        base, history = (c + PRIOR) / (n + PRIOR * (v + 1)), before(codes)
        kept = {s: x for s, x in zip(*(a.column(k).to_pylist() for k in none), strict=True) if s is not None}
        q = EXPECTED[levels_of(grams_of(codes, hashes), shards, shared.value if shared else None, kept)]
        logs = np.empty(len(codes))
        for at in range(0, len(codes), SLICE):
            here = slice(at, at + SLICE)
            x, y = codes[here], history[here]
            pair = np.where((c[x] > 0) & (c[y] > 0), q[here], 0.0)
            logs[here] = np.log10(np.where(c[y] > 0, WEIGHT * np.minimum(pair / np.maximum(c[y], 1), 1) + (1 - WEIGHT) * base[x], base[x]))
        first = np.cumsum(lengths) - lengths
        return pa.Table.from_batches([as_batch({
            "doc_id": get("ids"), "held_out": get("held"), "n_tokens": lengths, "n_known": np.add.reduceat((c[codes] > 0).astype(np.int64), first),
            "train_tokens": np.full(len(lengths), n), "base_score": np.add.reduceat(np.log10(base)[codes], first), "score": np.add.reduceat(logs, first),
        }, arrow)])

    return left.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(run, schema)


def op4_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), remainder("doc_id", 10) == 0)


QUERIES = {"op4_ngram_lm": op4_ngram_lm}
ORACLES: dict[str, str] = {}
