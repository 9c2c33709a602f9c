"""Joins and numbering that keep working when one key holds most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workdir import staged

def resharded_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi join whose two inputs are plain exchanges at run time.

    Adaptive skew splitting works only when both sides of a join are direct
    shuffle reads. A side that was just aggregated or ranked by `keys` would be
    reused without a new shuffle, and its hot key could not be split. Joining on
    a hash of the keys as well asks for a partitioning neither side has yet, so
    both are exchanged, and the adaptive rule can cut a hot key into pieces.
    Four bits of the hash do, as the keys themselves are hashed beside them.
    """
    h = "_reshard_hash"
    key_hash = F.hash(*[F.col(k) for k in keys]).bitwiseAND(15).cast("tinyint")
    joined = left.withColumn(h, key_hash).join(right.withColumn(h, key_hash), [h, *keys], how)
    return joined.drop(h)


def near_keys(rows: DataFrame, keys: DataFrame, key: str, slots: int = 1 << 18) -> DataFrame:
    """All rows whose `key` is among `keys`, and few others: for rows that are joined with the keys later on.

    The keys mark the slots of their hashes, at most `slots` numbers, so other
    rows drop out where they are read, however many keys or rows there are.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(slots)).cast("int").alias("_slot")
    marked = keys.where(F.col(key).isNotNull()).select(slot).distinct()
    return rows.where(F.col(key).isNotNull()).withColumn("_slot", slot).join(F.broadcast(marked), "_slot", "left_semi").drop("_slot")


def numbered(df: DataFrame, order: str, out: str, partition: list[str] | None = None) -> DataFrame:
    """row_number() by a column, for a whole table or inside hot keys.

    Rows are dealt into ranges of about equal size, whatever the values, and
    written with their range to the shared folder, so that both uses below see
    the same ranges. Inside a range rows are ranked; the ranges' offsets come
    from a running sum over one row per range. `order` must be unique inside
    each partition.
    """
    keys, r = list(partition or []), "_range"
    ranged = staged(df.repartitionByRange(*keys, order).withColumn(r, F.spark_partition_id()), "numbered")
    sizes = ranged.groupBy(*keys, r).agg(F.count(F.lit(1)).alias("_rows"))
    run = Window.partitionBy(*keys).orderBy(r).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, r, F.coalesce(F.sum("_rows").over(run), F.lit(0)).alias("_start"))
    cond = F.col("r._range") == F.col("s._range")
    for k in keys:
        cond = cond & F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}"))
    ranked = ranged.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, r).orderBy(order)))
    return (
        ranked.alias("r").join(starts.alias("s"), cond)
        .select(*[F.col(f"r.{c}").alias(c) for c in df.columns],
                (F.col("r._local") + F.col("s._start")).cast("bigint").alias(out))
    )


def newest_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the highest `order`; rank limits apply before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
