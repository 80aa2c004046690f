"""Written tables in the folder that all executors share, so that rendered inputs are made once a session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[tuple[str, str, str], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where none is set (local runs)."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = sc.getCheckpointDir()
    return found


def once(spark: SparkSession, name: str, sf_dir: str, make) -> DataFrame:
    """make() as a written table, the first time; later the table."""
    key = (spark.sparkContext.applicationId, name, sf_dir)
    if key not in _made:
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        # text rules cost far more CPU than their bytes suggest: as many files as there are cores at least
        make().repartition(4 * spark.sparkContext.defaultParallelism).write.parquet(path)
        _made[key] = path
    return spark.read.parquet(_made[key])


def dealt_once(spark: SparkSession, name: str, sf_dir: str, key: str, parts: int, make) -> DataFrame:
    """make(parts), rows that are dealt by key into so many parts, as a table in as many buckets, the first time; later the table.
    Joins and groups by the key move nothing."""
    at = (spark.sparkContext.applicationId, name, sf_dir)
    if at not in _made:
        table = f"{name}_{uuid.uuid4().hex}"
        make(parts).write.bucketBy(parts, key).option("path", f"{shared_folder(spark)}/{table}").saveAsTable(table)
        _made[at] = table
    return spark.table(_made[at])
