"""Target-distribution importance resampling with length-bucketed CRC matrices (operator 11)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.llm.common import aside, map_batches, table, written
from formloom.operators.skew import numbered

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 10, "2024"
#: Texts are worked on in slices of about this size (a longer text is one slice), distinct features in rows of this many bytes.
SLICE_BYTES, MATRIX_BYTES = 4 << 20, 4 << 20


def crc_table() -> np.ndarray:
    """The 256 steps of the reflected CRC-32 polynomial."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> 1) ^ np.uint32(0xEDB88320), x >> 1).astype(np.uint32)
    return x


TABLE = crc_table()
#: A-Z become lower case; bytes outside words become blanks. Characters beyond ASCII belong to words with all their bytes.
BYTES = np.arange(256, dtype=np.uint8)
BYTES[0x41:0x5B] += 32
BYTES[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 32


def crcs(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """CRC-32 of each byte string data[offsets[i]:offsets[i + 1]].

    Strings of one length form a matrix of uint8 whose columns update all their
    CRCs at once; the results are scattered back to the strings' places.
    """
    lengths = np.diff(offsets)
    out = np.zeros(len(lengths), np.uint32)
    order = np.argsort(lengths, kind="stable")
    ends = np.flatnonzero(np.append(np.diff(lengths[order]) != 0, True)) + 1 if len(order) else []
    begin = 0
    for end in ends:
        size = int(lengths[order[begin]])
        step = max(1, MATRIX_BYTES // max(size, 1))
        for a in range(begin, end, step):
            at = order[a : min(a + step, end)]
            crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
            if size > MATRIX_BYTES:  # one very long string: its columns in runs
                for c in range(size):
                    crc = TABLE[(crc ^ data[offsets[at] + c]) & 0xFF] ^ (crc >> 8)
            else:
                matrix = np.ascontiguousarray(data[offsets[at][:, None] + np.arange(size)].T)
                for column in matrix:
                    crc = TABLE[(crc ^ column) & 0xFF] ^ (crc >> 8)
            out[at] = ~crc
        begin = end
    return out


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.BinaryArray, np.ndarray]:
    """The words of the texts data[offsets[i]:offsets[i + 1]], and the number of each text's words."""
    first = int(offsets[0])
    flat, offsets = BYTES[data[first : int(offsets[-1])]], offsets.astype(np.int64) - first
    inside = flat != 32
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(flat)]
    start[cuts] = inside[cuts]
    places = np.flatnonzero(start)
    counts = np.diff(np.searchsorted(places, offsets))
    letters = np.cumsum(inside, dtype=np.int32)
    ends = np.append(letters[places] - 1, letters[-1] if len(letters) else 0).astype(np.int32)
    buffers = [None, pa.py_buffer(ends), pa.py_buffer(flat[inside])]
    return pa.BinaryArray.from_buffers(pa.binary(), len(places), buffers), counts


def bucketed(texts: pa.Array, orders: tuple[int, int], buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, words of each text, bucket of each feature, its text) for slices of whole texts."""
    texts = pc.fill_null(texts.cast(pa.binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE_BYTES, "right")) - 1)
        words, counts = words_of(data, offsets[a : b + 1])
        of = np.repeat(np.arange(b - a), counts)
        found, owner = [], []
        for k in range(orders[0], orders[1] + 1):
            n = max(0, len(words) - k + 1)
            same = of[:n] == of[k - 1 : k - 1 + n]
            runs = words if k == 1 else pc.binary_join_element_wise(*[words.slice(i, n).filter(pa.array(same)) for i in range(k)], b" ")
            coded = runs.dictionary_encode()
            distinct = coded.dictionary
            ends = np.frombuffer(distinct.buffers()[1], np.int32)[distinct.offset : distinct.offset + len(distinct) + 1] if len(distinct) else np.zeros(1, np.int32)
            crc = crcs(np.frombuffer(distinct.buffers()[2] or b"", np.uint8), ends.astype(np.int64))
            found.append((crc % np.uint32(buckets)).astype(np.int64)[coded.indices.to_numpy(zero_copy_only=False)])
            owner.append(of[:n][same])
        yield a, counts, np.concatenate(found), np.concatenate(owner)
        a = b


def bucket_counts(docs: DataFrame, orders: tuple[int, int] = (1, 1), buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket: one row a task and bucket is shuffled, `buckets` sums reach the driver."""

    def run(batches):
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, found, _ in bucketed(batch.column(0), orders, buckets):
                n += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["bucket", "n"])

    each = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in each.collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log ratio) of each bucket's smoothed share in the target to that in the source."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t))))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, orders: tuple[int, int] = (1, 1)) -> DataFrame:
    """The columns of `docs` with n_words, n_features and weight, the floored mean gain of its features (none: 0)."""

    def make():
        def run(batch):
            texts = batch.column(batch.schema.get_field_index("text"))
            words, n, total = (np.zeros(len(texts), np.int64) for _ in range(3))
            for a, counts, found, owner in bucketed(texts, orders, len(gain)):
                words[a : a + len(counts)] = counts
                n[a : a + len(counts)] = np.bincount(owner, minlength=len(counts))
                np.add.at(total, a + owner, gain[found])
            out = dict(zip(batch.schema.names, batch.columns, strict=True))
            yield out | {"n_words": words, "n_features": n, "weight": total // np.maximum(n, 1)}

        return run

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_batches(docs, make, f"{schema}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: str) -> Column:
    """floor(1000 * a Gumbel value) from a hash of the seed and the id; a null id is an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def drawn(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, orders: tuple[int, int] = (1, 1),
           buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """What `ranked` gives, with text_hash, a hash of each row's text."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    gain = gains(bucket_counts(docs, orders, buckets), bucket_counts(target, orders, buckets))
    scored = weights(docs, gain, orders).drop("text").withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = written(scored, "importance")
    fit = scored.where(F.col("n_words") >= least_words)
    above = sorted(((r.score, r.n) for r in fit.groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    most, seen, lowest = percent * sum(n for _, n in above) // 100, 0, None
    for score, n in above:
        if seen >= most:
            break
        seen, lowest = seen + n, score
    candidate = (F.col("n_words") >= least_words) & (F.col("score") >= F.lit(lowest)) if lowest is not None else F.lit(False)
    columns = ["doc_id", "text_hash", "n_features", "weight", "score"]
    order = F.struct((-F.col("score")).alias("s"), F.col("doc_id").isNull().alias("z"), "doc_id", F.monotonically_increasing_id().alias("i"))
    top = numbered(scored.where(candidate).select(*columns, order.alias("_order")), "_order", "rank")
    top = top.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    return top.select(*columns, "rank").unionByName(scored.where(~candidate).select(*columns, F.lit(None).cast("long").alias("rank")))


def ranked(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """doc_id, n_features, weight, score and rank of each row of `docs` (doc_id, text; the rest is not read).

    Features are the runs of orders[0] to orders[1] words (ASCII letters and
    digits, and all beyond ASCII, A-Z in lower case), joined by blanks, hashed
    into `buckets`. A bucket's gain is its log ratio of all features of
    `target` (text) to all of `docs`; a row's weight the floored mean gain of
    its features. score adds Gumbel noise from a hash of the doc_id, so that
    the highest scores are a draw without replacement in proportion to
    exp(weight / 1000). Of the N rows with at least `least_words` words the
    floor(percent * N / 100) highest are drawn, ties to the smaller doc_id
    (null last), and ranked 1, 2, 3...; other ranks are null. Options are those of `drawn`.

    Null and empty texts have no features and weight 0; repeated rows are scored
    and drawn each, equal ones in any order; empty tables give empty results, an
    empty target equal counts of 0. All texts are counted whole.

    Scores are whole numbers within a few tens of thousands, so a count by score
    is small; it gives the lowest score that is drawn, and only rows from there
    on are numbered, in ranges.
    """
    return drawn(docs, target, **options).drop("text_hash")


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that `ranked` draws, with all their columns; rows with a drawn row's doc_id and text come along."""
    rows, columns = aside(docs, ["_h"])
    top = drawn(docs, target, **options).where("rank is not null").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h")).distinct()
    rows = rows.withColumn("_h", F.xxhash64("text"))
    return rows.join(top, (rows["doc_id"].eqNullSafe(top["_id"])) & (rows["_h"] == top["_h"]), "left_semi").select(columns)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op11_importance": op11_importance}
ORACLES = {"op11_importance": r"""
with tab as materialized (select list(v order by i) as tab from (select i,
  list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as v from range(256) t(i))),
d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
dw as (select r, unnest(ws) as w from d),
bw as (select unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from benchmark),
sw as (select w, count(*) as s from dw group by w),
tw as (select w, count(*) as t from bw group by w),
v as materialized (select w, hex(encode(w)) as x, s, t from sw full join tw using (w)),
c as materialized (select w, coalesce(s, 0) as s, coalesce(t, 0) as t, xor(list_reduce(list_concat([4294967295],
  list_transform(range(0, length(x), 2), lambda i: ('0x' || substr(x, i + 1, 2))::bigint)), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 10000 as b from v, tab),
k as (select b, sum(s) as s, sum(t) as t from c group by b),
g as (select b, floor(1000 * ln(((t + 1)::double * (sum(s) over () + 10000)::double) / ((s + 1)::double * (sum(t) over () + 10000)::double)))::bigint as gain from k),
f as (select r, count(*) as n, sum(gain)::bigint as total from dw join c using (w) join g using (b) group by r),
x as (select doc_id, coalesce(n, 0) as n_features, coalesce(floor(total::double / n), 0)::bigint as weight,
  floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || coalesce(doc_id::varchar, '')), 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as noise from d left join f using (r)),
y as (select *, weight + noise as score, row_number() over (partition by n_features >= 20 order by weight + noise desc, doc_id nulls last) as k,
  count(*) filter (n_features >= 20) over () as m from x)
select doc_id, n_features::bigint as n_features, weight, score, case when n_features >= 20 and k <= 10 * m // 100 then k end as rank from y
"""}
