"""How the operators of this subpackage read tables and cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where the session names none (local tests)."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = sc.getCheckpointDir()
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: later steps survive the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that an operator writes on its way; they go when the block ends, so what it returns has to be written by then."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.views = spark, f"{shared_folder(spark)}/steps-{uuid.uuid4().hex}", []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.discard()

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        """As the function of this name; each name once a block."""
        path = f"{self.folder}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, name: str, n: int, key: str) -> DataFrame:
        """As stored, in n buckets by the key: grouping by it needs no further shuffle."""
        view = f"steps_{uuid.uuid4().hex}"
        df.repartition(n, key).write.option("path", f"{self.folder}/{name}").bucketBy(n, key).saveAsTable(view)
        self.views.append(view)
        return self.spark.table(view)

    def discard(self, *names: str) -> None:
        """Delete tables whose readers are done, or all."""
        if not names:
            for view in self.views:
                self.spark.sql(f"DROP TABLE IF EXISTS {view}")
        for path in [f"{self.folder}/{n}" for n in names] or [self.folder]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id: str = "doc_id"):
    """Rows kept for evaluation: crc32 of the id as text is divisible by 5."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 0


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from a stream of batches in which equal keys follow each other.

    Each table holds the complete groups of one batch (the last group waits for the next batch),
    so memory is bounded by one batch and one group."""
    rest: list[pa.Table] = []  # of one key, joined once it ends
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        keys = now.column(key).to_numpy()
        starts = cuts(keys)[:-1]
        if rest and rest[-1].column(key)[0].as_py() != keys[0]:
            yield pa.concat_tables(rest).combine_chunks()
            rest = []
        if len(starts) > 1:
            yield pa.concat_tables([*rest, now.slice(0, starts[-1])]).combine_chunks()
            rest = []
        rest.append(now.slice(starts[-1]))
    if rest:
        yield pa.concat_tables(rest).combine_chunks()


def cuts(keys: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal keys."""
    if not len(keys):
        return np.zeros(1, dtype=np.int64)
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
