"""Helpers of the operators: reading tables, shared work tables, Arrow batches, sorted groups."""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: ASCII white space; every operator's words are the runs between these.
SPACES = " \t\n\x0b\x0c\r"


#: What a Python worker keeps between tasks: one operator's models and stores at a time.
_KEPT: dict = {}


def kept(name: str, key, make: Callable):
    """make()'s result for this worker, made anew when another operator or key was last."""
    if (name, key) not in _KEPT:
        release()
        _KEPT[name, key] = make()
    return _KEPT[name, key]


def release() -> None:
    """Frees what other operators kept in this worker."""
    _KEPT.clear()
    gc.collect()


def prepared(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package, whatever the driver's working folder is."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def work_path(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, or below the warehouse where that is unset: both are shared."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: cuts lineage, and outlives any executor."""
    path = work_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(id_column: str, by: int):
    """crc32 of the id as text, modulo `by`; null ids have no remainder."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % by


def aside(docs: DataFrame, names: list[str]) -> tuple[DataFrame, list]:
    """`docs` with its columns of these names moved out of an operator's way, and the columns that restore it."""
    taken = {n.lower() for n in names}
    moved = {c: f"_aside_{i}" for i, c in enumerate(docs.columns) if c.lower() in taken}
    return docs.withColumnsRenamed(moved), [F.col(f"`{moved.get(c, c)}`").alias(c) for c in docs.columns]


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[dict]]], schema: str) -> DataFrame:
    """Applies make()'s function to the Arrow batches of each task.

    `make` runs once in each task; its function yields dicts of columns.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for columns in f(batch):
                yield as_batch(columns, arrow)

    return df.mapInArrow(run, schema)


def as_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        columns[f.name].cast(f.type) if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type)
        for f in schema
    ], schema=schema)


def map_groups(df: DataFrame, keys: list[str], f: Callable, schema: str, partitions: int | None = None) -> DataFrame:
    """Applies f(key values, table of one group) to groups that callers keep bounded.

    Rows are dealt by key and sorted by it, and each task walks its rows once, so
    many tiny groups cost no call into Spark each. f yields dicts of columns.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    spread = df.repartition(partitions, *keys) if partitions else df.repartition(*keys)

    def flush(parts: list[pa.Table], key) -> Iterator[dict]:
        yield from f(key, pa.concat_tables(parts).combine_chunks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, out, size = [], None, [], 0
        for batch in batches:
            t = pa.Table.from_batches([batch])
            n = t.num_rows
            if not n:
                continue
            columns = [t.column(k).to_pylist() for k in keys]
            at = list(zip(*columns, strict=True))
            cuts = [0, *[i for i in range(1, n) if at[i] != at[i - 1]], n]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and at[a] != key:
                    for x in flush(held, key):
                        out.append(as_batch(x, arrow))
                        size += out[-1].num_rows
                    held = []
                key = at[a]
                held.append(t.slice(a, b - a))
                if size > 2000:
                    yield from pa.Table.from_batches(out, arrow).combine_chunks().to_batches()
                    out, size = [], 0
        if held:
            out += [as_batch(x, arrow) for x in flush(held, key)]
        if out:
            yield from pa.Table.from_batches(out, arrow).combine_chunks().to_batches()

    return spread.sortWithinPartitions(*keys).mapInArrow(run, schema)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n items, the smallest item its links a[i]-b[i] lead to."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            return root
        root = low
