"""Stage tables: results written once to shared storage and read back column by column.

They cut lineage, survive lost executors, and let later passes read only the columns
they need.  The folder is the one the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows sent to Python at a time by a job that writes a stage table; Spark's own bounds are 64 MB and 10,000 rows.
BATCH_BYTES = 2 << 20


def checkpoint_root(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only in local mode when unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sitequarry-"))
    return context.getCheckpointDir()


@contextmanager
def batch_bytes(spark: SparkSession, size: int = BATCH_BYTES) -> Iterator[None]:
    """Arrow batches of about so many bytes, for jobs run inside."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Workspace:
    """A folder of stage tables that belongs to one run.

    Used as a context it is dropped at its end; results must be written elsewhere before that.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.id = uuid.uuid4().hex
        self.path = f"{checkpoint_root(spark)}/sitequarry-{self.id}"
        self._tables: list[str] = []

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *raised) -> None:
        self.drop()

    def table(self, df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
        """Write ``df`` and read it back; ``zstd`` makes tables of text about half as large."""
        path = f"{self.path}/{len(self._tables)}-{label}"
        self._tables.append(path)
        with batch_bytes(self.spark):
            df.write.option("compression", compression).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keyed_table(
        self, df: DataFrame, label: str, key: str, exchanged: bool = False
    ) -> DataFrame:
        """Write ``df`` bucketed by ``key``, so that joins on it need not shuffle it again.

        ``exchanged`` says that ``df`` comes out of a shuffle by ``key`` already.
        """
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        path = f"{self.path}/{len(self._tables)}-{label}"
        name = f"stage_{self.id}_{len(self._tables)}"
        self._tables.append(path)
        (
            (df if exchanged else df.repartition(buckets, key))
            .write.option("path", path)
            .bucketBy(buckets, key)
            .sortBy(key)
            .saveAsTable(name)
        )
        return self.spark.table(name)

    def drop(self) -> None:
        """Delete the stage tables; call it once the products are written."""
        for n in range(len(self._tables)):
            self.spark.sql(f"DROP TABLE IF EXISTS stage_{self.id}_{n}")
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        files.delete(folder, True)
