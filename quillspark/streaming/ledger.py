"""A stream's rows, each batch once: accepted and rejected rows filed by batch, and a log of the batches that are whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

ACCEPTED, REJECTED = "accepted", "rejected"
LOG = "batch long, accepted long, rejected long"


class Ledger:
    """A folder with rows/batch=N/state=accepted|rejected and log/batch=N.

    A batch is written whole in place of what an attempt before left, then logged; readers see logged batches only, and a
    logged batch that comes again is passed over.  So a batch counts once, whenever a driver or executor is lost.  One stream writes
    to a ledger: batches are told apart by number.

    judge: a plan from a batch to rows to keep with a column `reason`, null where a row is accepted.  schema: that of its result."""

    def __init__(self, spark: SparkSession, path: str, judge: Callable[[DataFrame], DataFrame], schema: str):
        self.spark, self.path, self.judge, self.schema = spark, path, judge, schema

    def log(self) -> DataFrame:
        """A row for each batch that is whole: its number, accepted and rejected rows."""
        return self._read("log", LOG)

    def write(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch: one pass over the batch, and its counts from what was written."""
        if self.log().filter(F.col("batch") == number).limit(1).count():
            return
        folder = f"{self.path}/rows/batch={number}"
        rows = self.judge(batch).withColumn("state", F.when(F.col("reason").isNull(), ACCEPTED).otherwise(REJECTED))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("state").parquet(folder)
        states = self.spark.read.schema(f"{self.schema}, state string").parquet(folder)
        counts = states.agg(F.count_if(F.col("state") == ACCEPTED).alias("accepted"), F.count_if(F.col("state") == REJECTED).alias("rejected"))
        counts.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/batch={number}")

    def rows(self, state: str = ACCEPTED) -> DataFrame:
        """The rows of one state in all whole batches, with their batch; folders of other states and batches are not read."""
        whole = self.log().select("batch")
        return self._read("rows", f"{self.schema}, batch long, state string").filter(F.col("state") == state).drop("state").join(whole, "batch", "left_semi")

    def run(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """All that the stream has by now, in batches."""
        return stream.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def _read(self, part: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{part}")
