"""Tables that micro-batches write: a folder for each batch, replaced when the batch is retried."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.ledger import latest_versions


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """The batch's own folder; a retried batch replaces what it wrote before."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def read_batch(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    return spark.read.parquet(f"{path}/batch={batch_id}").drop("batch")


def found(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame | None:
    """The rows of a folder, or None where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


class Running:
    """A running total over batches: batch n adds to what batch n - 1 left, however often n is retried."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def before(self, batch_id: int) -> int:
        rows = found(self.spark, f"{self.path}/batch={batch_id - 1}", "total long") if batch_id else None
        return rows.first().total if rows is not None else 0

    def after(self, batch_id: int, added: int) -> None:
        write_batch(self.spark.createDataFrame([(self.before(batch_id) + added,)], "total long"), self.path, batch_id)


class LedgerStore:
    """A ledger of versions: a snapshot of the rows as they stood, and the versions appended since.

    The current view ranks the tail alone; rows of the snapshot that the tail
    does not touch pass through. When the tail has `factor` times the rows of the
    snapshot, or `most` batches, the view becomes the next snapshot, so a row is
    copied a bounded number of times for each doubling. What a batch finds is
    noted in the batch's own folder, so a retry finds and writes the same.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, factor: float = 1.0, most: int = 64):
        self.spark, self.path, self.factor, self.most = spark, path, factor, most
        self.schema = StructType([f for f in schema.fields if f.name != "version"]).add("version", "integer")

    def mark(self, batch_id: int) -> tuple[int, int, int]:
        """After a batch: the last batch in the snapshot, rows of the snapshot, rows of the tail."""
        rows = found(self.spark, f"{self.path}/marks/batch={batch_id}", "upto long, kept long, tail long") if batch_id >= 0 else None
        return tuple(rows.first()) if rows is not None else (-1, 0, 0)

    def parts(self, before: int) -> tuple[DataFrame, DataFrame]:
        upto, _, _ = self.mark(before - 1)
        none = self.spark.createDataFrame([], self.schema)
        kept = found(self.spark, f"{self.path}/snapshot/upto={upto}", self.schema) if upto >= 0 else none
        paths = [f"{self.path}/tail/batch={i}" for i in range(upto + 1, before)]
        tail = self.spark.read.schema(self.schema).parquet(*paths) if paths else none
        return kept, tail

    def current(self, before: int | None = None) -> DataFrame:
        """The newest version of every row, as all batches, or those before `before`, left the ledger."""
        if before is None:
            marks = found(self.spark, f"{self.path}/marks", "batch long")
            before = 0 if marks is None else marks.agg(F.max("batch")).first()[0] + 1
        return latest_versions(*self.parts(before))

    def versions(self) -> DataFrame:
        """All versions ever appended."""
        rows = found(self.spark, f"{self.path}/tail", StructType([*self.schema.fields]).add("batch", "long"))
        return rows if rows is not None else self.spark.createDataFrame([], self.schema).withColumn("batch", F.lit(0).cast("long"))

    def append(self, rows: DataFrame, batch_id: int) -> None:
        """Adds a batch's versions, and compacts where the tail has grown enough."""
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields])
        write_batch(rows, f"{self.path}/tail", batch_id)
        upto, kept, tail = self.mark(batch_id - 1)
        tail += self.spark.read.parquet(f"{self.path}/tail/batch={batch_id}").count()
        if tail > self.factor * kept or batch_id - upto > self.most:
            at = [f"{self.path}/tail/batch={i}" for i in range(upto + 1, batch_id + 1)]
            old = self.parts(batch_id)[0]
            latest_versions(old, self.spark.read.schema(self.schema).parquet(*at)).write.mode("overwrite").parquet(f"{self.path}/snapshot/upto={batch_id}")
            upto, tail = batch_id, 0
            kept = self.spark.read.parquet(f"{self.path}/snapshot/upto={batch_id}").count()
        write_batch(self.spark.createDataFrame([(upto, kept, tail)], "upto long, kept long, tail long"), f"{self.path}/marks", batch_id)
